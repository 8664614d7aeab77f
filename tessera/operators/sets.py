"""Set operations on versioned records: merging, cumulating, drift, manifests, vouchers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pick_one(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def merge_drafts(drafts: DataFrame, key: str, ord_col: str = "ord", last_wins: bool = False) -> DataFrame:
    """One row per key of several drafts stacked in order: the first (versions) or the last (amendments) wins."""
    return pick_one(drafts, [key], [F.desc(ord_col) if last_wins else F.asc(ord_col)])


def cumulate(base: DataFrame, new: DataFrame, key: str, release_col: str, release: str) -> DataFrame:
    """The next release: all of ``new``, and of ``base`` what ``new`` does not replace, stamped with ``release``.

    ``new`` is deduplicated by key; the rest of ``base`` comes by an anti-join, so the large base is shuffled
    once on the key and, if it is bucketed by it, not at all.
    """
    fresh = new.dropDuplicates([key])
    kept = base.join(fresh.select(key), key, "left_anti")
    return fresh.unionByName(kept, allowMissingColumns=True).withColumn(release_col, F.lit(release))


def cumulate_reviews(base: DataFrame, new: DataFrame) -> DataFrame:
    """Review logs of both releases, each (target, reviewer, time) once."""
    return base.unionByName(new, allowMissingColumns=True).dropDuplicates(["target", "reviewed_by", "reviewed_at"])


def drift(published: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """CHANGED, MISSING and ADDED keys between two snapshots; unchanged ones give no row."""
    p = published.select(F.col(key).alias("key"), F.col(digest).alias("was"))
    c = current.select(F.col(key).alias("key"), F.col(digest).alias("now"))
    out = p.join(c, "key", "full_outer")
    kind = F.when(F.col("now").isNull(), "MISSING").when(F.col("was").isNull(), "ADDED").when(F.col("was") != F.col("now"), "CHANGED")
    return out.withColumn("drift", kind).filter("drift is not null").select(F.col("key").alias(key), "drift")


def verify_manifest(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Files (path, sha256, byte_length) that the manifest and the store do not agree on.

    MISSING, HASH_MISMATCH, SIZE_MISMATCH (only where the hash agrees) or UNREGISTERED.
    """
    m = manifest.select("path", F.col("sha256").alias("m_sha"), F.col("byte_length").alias("m_len"))
    a = actual.select("path", F.col("sha256").alias("a_sha"), F.col("byte_length").alias("a_len"))
    issue = (
        F.when(F.col("a_sha").isNull(), "MISSING").when(F.col("m_sha").isNull(), "UNREGISTERED")
        .when(F.col("a_sha") != F.col("m_sha"), "HASH_MISMATCH").when(F.col("a_len") != F.col("m_len"), "SIZE_MISMATCH")
    )
    return m.join(a, "path", "full_outer").withColumn("issue", issue).filter("issue is not null").select("path", "issue")


def compare_copies(source: DataFrame, copy: DataFrame) -> DataFrame:
    """State of each file of a backup: source_corrupt, missing, copy_corrupt or same.

    ``source`` has path, sha256 (found) and registered; ``copy`` has path and sha256.
    """
    c = copy.select("path", F.col("sha256").alias("copy_sha"))
    state = (
        F.when(F.col("sha256") != F.col("registered"), "source_corrupt").when(F.col("copy_sha").isNull(), "missing")
        .when(F.col("copy_sha") != F.col("sha256"), "copy_corrupt").otherwise("same")
    )
    return source.join(c, "path", "left").select("path", state.alias("state"))


def check_vouchers(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every record's voucher: ok, UNVOUCHED_RECORD or WRONG_VOUCHER.

    ``records`` has target and status, ``reviews`` target and method (null: human). A verified record needs a
    human's review, a machine-checked one a machine's.
    """
    methods = reviews.groupBy("target").agg(F.collect_set(F.coalesce("method", F.lit("human"))).alias("methods"))
    needed = F.when(F.col("status") == "verified", "human").when(F.col("status") == "machine_checked", "machine")
    out = records.join(methods, "target", "left").withColumn("needed", needed).filter("needed is not null")
    state = F.when(F.col("methods").isNull(), "UNVOUCHED_RECORD").when(F.array_contains("methods", F.col("needed")), "ok").otherwise("WRONG_VOUCHER")
    return out.select("target", "status", state.alias("voucher"))


def review_state(versions: DataFrame, release_col: str) -> DataFrame:
    """A release is as good as its weakest record: machine_checked if any is, else verified."""
    weakest = F.when(F.bool_or(F.col("status") == "machine_checked"), "machine_checked").otherwise("verified")
    return versions.groupBy(release_col).agg(weakest.alias("review_state"))


def route_documents(records: DataFrame, document: str, passed: str, refused: str) -> DataFrame:
    """Whole documents as clean, needs_review or refused."""
    per = records.groupBy(document).agg(F.bool_or(refused).alias("r"), F.bool_and(passed).alias("p"), F.count("*").alias("n_records"))
    return per.select(document, F.when(F.col("r"), "refused").when(F.col("p"), "clean").otherwise("needs_review").alias("route"), "n_records")


def seeded_draws(k, seed: int):
    """The k-th draw in [0, 1) of the review sample, as a column: each draw depends on k alone.

    The generator's state is seed + k * 0x6D2B79F5 modulo 2**32; products of 32-bit numbers are taken as
    decimals, which hold them exactly, and reduced.
    """
    word = F.lit(4294967296).cast("decimal(20,0)")

    def product(a, b):
        return ((a.cast("decimal(19,0)") * b.cast("decimal(19,0)")) % word).cast("long")

    s = product(k.cast("long"), F.lit(0x6D2B79F5)) + F.lit(seed)
    s = s.bitwiseAND(0xFFFFFFFF)
    v = product(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    v = v.bitwiseXOR((v + product(v.bitwiseXOR(F.shiftright(v, 7)), v.bitwiseOR(F.lit(61)))).bitwiseAND(0xFFFFFFFF))
    return v.bitwiseXOR(F.shiftright(v, 14)) / F.lit(4294967296.0)
