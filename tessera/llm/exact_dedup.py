"""Exact dedup through an extendible-hash index on shared files (DataFrame operations only)."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, materialize

#: Distinct hashes that a bucket holds before it splits, and leaves of the directory at most on average: the
#: directory goes to all executors, so a larger index has larger buckets instead of a larger directory.
BUCKET_ENTRIES, DIRECTORY_LEAVES = 20_000, 1 << 15


def normalised(text):
    """The text without its ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", "")


def _leaf(depth: int):
    return F.col("h").bitwiseAND((1 << depth) - 1)


def _directory(hashes: DataFrame, bucket_entries: int) -> tuple[DataFrame, int]:
    """(leaf, bucket, depth) for every occupied leaf of the directory, and the directory's depth.

    The directory starts at the depth at which all buckets would be full and doubles until no leaf is overfull.
    A bucket that holds too many hashes at depth d is split: its local depth is d + 1. As a child is never
    fuller than its parent, a leaf's local depth is one more than the deepest overfull prefix on its path.
    Doubling ends, as a bucket of two hashes or more can always be told apart by more bits.
    """
    count = hashes.count()
    bucket_entries = max(bucket_entries, ceil(count / DIRECTORY_LEAVES))
    first = max(0, int(log2(max(1, count / bucket_entries))) - 1)
    depth = first + 2
    while True:
        leaves = materialize(hashes.groupBy(_leaf(depth).alias("leaf")).agg(F.count("*").alias("n")), "dedup-leaves")
        if depth >= 63 or leaves.filter(F.col("n") > bucket_entries).isEmpty():
            break
        depth += 1
    paths = leaves.select("leaf", "n", F.explode(F.sequence(F.lit(first), F.lit(depth - 1))).alias("d"))
    paths = paths.withColumn("prefix", F.expr("leaf & (shiftleft(1L, d) - 1L)"))
    overfull = paths.groupBy("d", "prefix").agg(F.sum("n").alias("n")).filter(F.col("n") > bucket_entries).select("d", "prefix")
    local = paths.join(overfull, ["d", "prefix"]).groupBy("leaf").agg((F.max("d") + 1).alias("depth"))
    out = leaves.select("leaf").join(local, "leaf", "left").withColumn("depth", F.coalesce("depth", F.lit(first)))
    return materialize(out.withColumn("bucket", F.expr("leaf & (shiftleft(1L, depth) - 1L)")), "dedup-directory"), depth


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = BUCKET_ENTRIES, hash_bits: int = 64) -> DataFrame:
    """For every row its group of equal normalised texts and the row of the group that stays.

    Texts are equal if they are identical without ASCII white space. Of equal texts the one with the most code
    points in the original stays, then the smallest id.

    The index is addressed by an extendible-hash directory over the low bits of the text's hash; overfull buckets
    split. Every text finds its bucket in the directory; within a bucket equal hashes are told apart by comparing
    whole texts, byte by byte, and different texts of one hash become entries 1, 2, ... of a chain. An entry has
    the text's digest, the number of copies and the row that stays. Entries are written to the shared folder in
    ranges of buckets, a file per owner task; rows read theirs back by bucket, hash and digest. Copies are
    pre-aggregated before they are shuffled, so a text that a third of all rows share is one row per task.

    ``hash_bits`` shortens the hash, which makes chains long and changes no result.

    Defined cases: null or blank text is the empty text and equal to every other such text; a null id ranks
    after all ids; of repeated rows (same id and text) exactly one stays; an empty table gives no rows; columns
    other than the two are not read, so their names cannot clash. Ids may be of any type that can be ordered.

    Returns row_id, doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = base.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), normalised(F.col("text")).alias("norm"))
    h = F.xxhash64("norm") if hash_bits == 64 else F.xxhash64("norm").bitwiseAND((1 << hash_bits) - 1)
    keyed = base.select("doc_id", "n_chars", "norm", h.alias("h"))

    rows = materialize(keyed.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "n_chars", "h", F.sha2("norm", 256).alias("text_sha256")), "dedup-rows")
    directory, depth = _directory(rows.select("h").distinct(), bucket_entries)
    directory = F.broadcast(directory.select("leaf", "bucket"))  # DIRECTORY_LEAVES rows on average, some times that at most

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("leaf", _leaf(depth)).join(directory, "leaf").drop("leaf")

    texts = placed(keyed).groupBy("bucket", "h", "norm").agg(F.count("*").alias("group_size"), F.max("n_chars").alias("longest"))
    entries = materialize(texts.select("bucket", "h", F.sha2("norm", 256).alias("text_sha256"), "group_size", "longest"), "dedup-entries")

    key = ["bucket", "h", "text_sha256"]
    best = placed(rows).join(entries.select(*key, "longest"), key).filter(F.col("n_chars") == F.col("longest"))
    best = best.groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("stays"))
    chain = F.expr("row_number() over (partition by bucket, h order by text_sha256)")
    index = entries.join(best, key).withColumn("chain", chain)
    index = index.select(*key, "chain", "group_size", F.col("stays.row_id").alias("keep_row"), F.col("stays.doc_id").alias("keep_id"))
    index = materialize(index.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "chain"), "dedup-index")

    out = placed(rows).join(index, key)
    return out.select("row_id", "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256", "bucket", "chain")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are found again by (id, text digest); a repeated row is kept once, as the digest join runs on
    distinct keys and the repeated rows are reduced with ``dropDuplicates``.
    """
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    digest = F.sha2(normalised(F.col(text_col)), 256)
    hit = docs.withColumn("__sha", digest).withColumn("__n", F.coalesce(F.length(text_col), F.lit(0)))
    out = hit.join(kept, hit[id_col].eqNullSafe(kept["__id"]) & (hit["__sha"] == kept["__sha"])).drop(kept["__sha"]).drop("__id")
    # rows with one id and equal text may differ in other columns or in white space: the longest text, then any one row
    w = F.expr(f"row_number() over (partition by `{id_col}`, __sha order by __n desc)")
    return out.withColumn("__rn", w).filter("__rn = 1").drop("__rn", "__sha", "__n")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), k AS (
  SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY n) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM k
"""
