"""Source divergence audit: how the sources of a language differ in their words, by tiles of pairs of source groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import blocks, bounded_batches, documents, first_of_runs, materialize, terms_of, text_bytes

#: Documents of a language that have a term, at least, for the term to count.
MIN_DOCS = 3
#: Shares are numbers of parts in SCALE; UNIT * (SCALE // UNIT) is SCALE, so that shares need no number over 64 bits.
SCALE, UNIT = 1_000_000_000, 31_250
#: Sources of a block, and terms of a vocabulary chunk (powers of two).
BLOCK, CHUNK = 16, 1 << 12
#: Terms that are reported per source.
TOP = 200

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of each batch; the empty term stands for the group itself."""
    for batch in it:
        if not batch.num_rows:
            continue
        lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
        pair, owner = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
        langs, sources = lang.dictionary.take(pa.array(pair // len(source.dictionary))), source.dictionary.take(pa.array(pair % len(source.dictionary)))
        nothing = pa.array(np.zeros(len(pair), np.int64))
        yield pa.RecordBatch.from_arrays([langs, sources, pa.array([""] * len(pair)), nothing, nothing], schema=_COUNTS)
        raw, offsets = text_bytes(batch.column("text"))
        for i, j in blocks(offsets, 1 << 21):
            at = offsets[i : j + 1] - offsets[i]
            terms, start = terms_of(raw[offsets[i] : offsets[j]], at)
            if not len(terms):
                continue
            doc = np.searchsorted(at, start, "right") - 1
            coded = terms.dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            # occurrences per (document, term), then both numbers per (group, term)
            key, n = np.unique(doc * len(coded.dictionary) + code, return_counts=True)
            key = owner[i:j][key // len(coded.dictionary)] * len(coded.dictionary) + key % len(coded.dictionary)
            order = np.argsort(key, kind="stable")
            begin = np.flatnonzero(first_of_runs(key[order]))
            key = key[order][begin]
            g = pa.array(key // len(coded.dictionary))
            word = coded.dictionary.take(pa.array(key % len(coded.dictionary))).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pc.take(langs, g), pc.take(sources, g), word, pa.array(np.add.reduceat(n[order], begin)), pa.array(np.diff(np.append(begin, len(order))))], schema=_COUNTS)


def share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / total) of SQL expressions, exact up to totals of 2.8e14; null where the total is."""
    return F.expr(f"1L + (({count} + 1L) * {UNIT}L div {total}) * {SCALE // UNIT}L + (({count} + 1L) * {UNIT}L % {total}) * {SCALE // UNIT}L div {total}")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` for arrays; totals are over 0."""
    whole, rest = np.divmod((count + 1) * UNIT, total)
    return 1 + whole * (SCALE // UNIT) + rest * (SCALE // UNIT) // total


_VECTORS = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("chunk", pa.int64()), ("member", pa.binary()), ("place", pa.binary()), ("n", pa.binary())])
_VECTORS_DDL = "lang string, block int, chunk long, member binary, place binary, n binary"


def _pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The counts of one block of sources in one chunk of the vocabulary, a row for each source and term at most."""
    member, place, n = (rows.column(c).to_numpy() for c in ("member", "place", "n"))
    order = np.lexsort((place, member))
    packed = [member[order].astype(np.uint8).tobytes(), place[order].astype(np.uint16).tobytes(), n[order].astype(np.int64).tobytes()]
    return pa.Table.from_arrays([*(pa.array([k.as_py()], f.type) for k, f in zip(key, _VECTORS)), *(pa.array([x], pa.binary()) for x in packed)], schema=_VECTORS)


_PARTS = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("part", pa.int64()), ("n_seen", pa.int64())])
_PARTS_DDL = "lang string, a int, b int, part long, n_seen long"


def _gap_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum over the terms (columns) of floor((p - q)^2 / q) for each row of p with each row of q."""
    out = np.empty((len(p), len(q)), np.int64)
    for k, row in enumerate(p):
        out[k] = ((row - q) ** 2 // q).sum(axis=1)
    return out


def _tiles(block_size: int, chunk_size: int):
    """Over rows sorted by (lang, low, high, chunk): the sums of a tile's pairs over successive chunks of terms.

    A tile's chunk has the row of its low block or its high block or both. Only terms that some source of the
    two blocks has are looked at; all others add the same for a pair, whatever their number, and are added later.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, now, rows = None, None, []
        totals: list[np.ndarray] = []
        sums = seen = None

        def vectors(block: int, columns: np.ndarray, total: np.ndarray) -> np.ndarray:
            counts = np.zeros((len(total), chunk_size), np.int64)
            for r in rows:
                if r["block"] == block:
                    counts[np.frombuffer(r["member"], np.uint8), np.frombuffer(r["place"], np.uint16)] = np.frombuffer(r["n"], np.int64)
            return shares(counts[:, columns], total[:, None])

        def close_chunk():
            nonlocal sums, seen
            columns = np.unique(np.concatenate([np.frombuffer(r["place"], np.uint16) for r in rows]))
            p, q = (vectors(block, columns, total) for block, total in zip(tile[1:], totals))
            sums[0] += _gap_sums(p, q)
            if tile[1] != tile[2]:
                sums[1] += _gap_sums(q, p)
            seen += len(columns)

        def close_tile():
            lang, low, high = tile
            for (x, y), part in zip(((low, high), (high, low)), sums[: 1 + (low != high)]):
                a, b = np.indices(part.shape).reshape(2, -1)
                columns = [lang] * part.size, a + block_size * x, b + block_size * y, part.ravel(), np.full(part.size, seen)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTS)], schema=_PARTS)

        for batch in it:
            for r in batch.to_pylist():
                key = r["lang"], r["low"], r["high"]
                if (*key, r["chunk"]) != now and rows:
                    close_chunk()
                    rows = []
                if key != tile:
                    if tile is not None:
                        yield from close_tile()
                    tile, totals, seen = key, [np.array(r["low_totals"]), np.array(r["high_totals"])], 0
                    sums = [np.zeros((len(totals[0]), len(totals[1])), np.int64), np.zeros((len(totals[1]), len(totals[0])), np.int64)]
                now = (*key, r["chunk"])
                rows.append(r)
        if rows:
            close_chunk()
            yield from close_tile()

    return run


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, block_size: int = BLOCK, chunk_size: int = CHUNK) -> DataFrame:
    """How far the words of each (lang, source) group are from those of each other source of its language, and by
    which terms it stands out in its language.

    A language keeps the terms that ``min_docs`` of its documents have; with N occurrences of kept terms and V of
    them, a term that occurs c times has the share p = 1 + floor(SCALE * (c + 1) / (N + V)) of a group, and likewise
    of a language. Part ``pair``: for every other source of the language, with q its share, the sum over kept terms
    of floor((p - q)^2 / q). Part ``term``: the same value of single terms that the group has and p > q, q the language's share; the
    first ``top`` of them. All numbers are exact integers.

    Occurrences are added up per batch, per task and then per (lang, source, term). Kept terms get numbers, whose
    upper part is a vocabulary chunk; sources get places in blocks of ``block_size`` (256 at most). A block's counts in a chunk are packed
    into one row, which is sent to the tile of its block with every block of the language. Tiles walk through their
    chunks in order and are added up over tasks. So a pair's terms never meet in one place, a frequent term is a number per source,
    and no row grows with the corpus.

    Defined cases: null lang, source and text count as ''; groups without kept terms take part, with the share that terms of no
    occurrence have; a language without kept terms has value 0 for all pairs and no terms; an empty table gives
    no rows; repeated rows count each; other columns are not read.

    Returns lang, source, part, item, value, rank.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    counted = bounded_batches(docs).select(*text).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")

    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = kept.sortWithinPartitions("lang").select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("number"))
    kept = materialize(kept, "divergence-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total"))

    # one row per group: its place in its language and what its shares are parts of
    entries = materialize(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-entries")
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")
    groups = counts.filter("term = ''").select("lang", "source").withColumn("a", place)
    groups = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left")
    n_terms = F.coalesce("n_terms", F.lit(0)).cast("long")
    groups = materialize(groups.select("lang", "source", "a", n_terms.alias("n_terms"), (F.coalesce("n", F.lit(0)) + n_terms).alias("total"), (F.coalesce("lang_total", F.lit(0)) + n_terms).alias("lang_total")), "divergence-groups")
    # one row per block of sources: what its sources' shares are parts of, and the language's last block
    last = F.max("block").over(Window.partitionBy("lang")).alias("last")
    own_totals = F.transform(F.sort_array(F.collect_list(F.struct("a", "total"))), lambda r: r["total"]).alias("totals")
    of_block = F.expr(f"a div {block_size}").cast("int").alias("block")
    each = materialize(groups.groupBy("lang", of_block).agg(own_totals).select("lang", "block", "totals", last), "divergence-blocks")

    rows = entries.join(groups.select("lang", "source", "a", "total", "lang_total"), ["lang", "source"])
    packed = rows.select("lang", of_block, F.expr(f"number div {chunk_size}L").alias("chunk"), (F.col("a") % block_size).alias("member"), (F.col("number") % chunk_size).alias("place"), "n")
    packed = packed.groupBy("lang", "block", "chunk").applyInArrow(_pack, _VECTORS_DDL)
    sent = packed.join(each, ["lang", "block"]).withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    sent = sent.join(each.select("lang", F.col("block").alias("other"), F.col("totals").alias("other_totals")), ["lang", "other"])
    mine = F.col("block") <= F.col("other")
    sent = sent.withColumns({
        "low": F.least("block", "other"), "high": F.greatest("block", "other"),
        "low_totals": F.when(mine, F.col("totals")).otherwise(F.col("other_totals")), "high_totals": F.when(mine, F.col("other_totals")).otherwise(F.col("totals")),
    })
    tile = ["lang", "low", "high", "chunk"]
    tiles = sent.select(*tile, "block", "member", "place", "n", "low_totals", "high_totals").repartition(*tile).sortWithinPartitions(*tile)
    sums = tiles.mapInArrow(_tiles(block_size, chunk_size), _PARTS_DDL).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("n_seen").alias("n_seen"))

    # the report has a row for every ordered pair of a language's sources
    last_place = groups.groupBy("lang").agg(F.max("a").alias("last"))
    pairs = groups.join(last_place, "lang").withColumn("b", F.explode(F.sequence(F.lit(0), "last"))).filter("a <> b")
    pairs = pairs.join(groups.select("lang", F.col("a").alias("b"), F.col("source").alias("item"), F.col("total").alias("other_total")), ["lang", "b"])
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("p", share("0L", "nullif(total, 0L)")).withColumn("q", share("0L", "nullif(other_total, 0L)"))
    unseen = F.expr("(n_terms - coalesce(n_seen, 0L)) * (((p - q) * (p - q)) div q)")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("part", F.lit(0)) + F.coalesce(unseen, F.lit(0))).cast("long").alias("value"))

    own = rows.withColumn("p", share("n", "total")).withColumn("q", share("lang_n", "lang_total")).filter("p > q")
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(own)


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir).select("lang", "source", "text"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), occ AS (
  SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS c FROM occ GROUP BY lang, term HAVING count(DISTINCT k) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang
), grp AS (
  SELECT DISTINCT lang, source FROM d
), cnt AS (
  SELECT lang, source, term, count(*) AS c FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL
), tot AS (
  SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(cnt.c, 0) AS c, 1 + 1000000000 * (coalesce(cnt.c, 0)::HUGEINT + 1) // (coalesce(tot.n, 0) + l.v) AS p,
         1 + 1000000000 * (k.c::HUGEINT + 1) // (l.n + l.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), everyone AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM everyone
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
