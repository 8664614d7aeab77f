"""Periodic run detection: stretches of words that repeat with a period, found by probing harmonic grids."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, Words, blocks, bounded_batches, documents, joined, text_bytes

#: A run has at least this many words, and at least this many times its period.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words that an extension compares first; every further comparison takes twice as many.
CHUNK = 64

RUN = "struct<start: long, length: long, period: long>"
ADDED = f"n_words long, runs array<{RUN}>, strongest {RUN}, kept_text string"


def _extend(w: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The widest [low, high) around ``at`` in which every word equals the one ``p`` further on."""
    end, high, step = len(w) - p, at + 1, CHUNK
    while high < end:
        stop = min(end, high + step)
        off = w[high:stop] != w[high + p : stop + p]
        if off.any():
            high += int(off.argmax())
            break
        high, step = stop, 2 * step
    low, step = at, CHUNK
    while low > 0:
        start = max(0, low - step)
        off = (w[start:low] != w[start + p : low + p])[::-1]
        if off.any():
            low -= int(off.argmax())
            break
        low, step = start, 2 * step
    return low, high


def _probe(w: np.ndarray, room: np.ndarray, within: np.ndarray, p: int) -> Iterator[tuple[int, int]]:
    """Runs [start, end) of smallest period ``p``, if those of smaller periods are in ``within`` already.

    ``room[k]`` is how many words its document has from k on; ``within[k]`` is how far from k on, at least, some found run of which k is a word goes on; it is kept up here.
    A run of four periods or more holds four neighbouring points of the grid 0, p, 2p, ..., whose words are all the
    same. Points that lie in one found run are passed over, as are stretches that do: a run of period p that shares 3p + 1
    words with one of a smaller period q has the period gcd(p, q) throughout, so it has been found at that period.
    """
    grid = w[::p]
    same = grid[1:] == grid[:-1]
    points = np.flatnonzero(same[: len(same) - 2] & same[1 : len(same) - 1] & same[2:]) * p if len(same) > 2 else np.empty(0, np.int64)
    points = points[room[points] > 3 * p]  # grids go on into the next document
    seen = 0  # equality with the word p further on is known up to here
    for at in points:
        if at < seen or within[at] > 3 * p:
            continue
        low, high = _extend(w, int(at), p)
        seen = high
        end = high + p
        if end - low >= max(MIN_LENGTH, MIN_EXPONENT * p) and within[low] < end - low:
            within[low:end] = np.maximum(within[low:end], np.arange(end - low, 0, -1))
            yield low, end


def find_runs(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs of the documents of a block, as rows (document, start, length, period), in that order.

    ``ids`` tells words apart; document k has the words bounds[k] .. bounds[k + 1]. Documents stand one after the
    other with one id of its own between them: equality at distance p never goes on across it for 3p words. For each
    doubling of the period the documents that are too short for it are taken out. There are n / p points for each
    period p, n log n of them in all.
    """
    n = np.diff(bounds)
    docs = np.flatnonzero(n >= MIN_LENGTH)
    found = []
    code = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    rest = np.zeros(len(code), np.int64)
    p = 1
    while len(docs):
        size = n[docs] + 1
        begin = np.cumsum(size) - size
        at = np.repeat(bounds[docs] - begin, size) + np.arange(size.sum())  # the last of each document is the separator
        last = begin + n[docs]
        at[last] = 0
        w = code[at] if len(code) else code
        w[last] = -1 - np.arange(len(docs))
        within = rest[at]
        within[last] = 0
        room = np.repeat(begin + size - 1, size) - np.arange(len(at))
        longest = int(n[docs].max()) // MIN_EXPONENT
        for q in range(p, min(2 * p, longest + 1)):
            for low, end in _probe(w, room, within, q):
                k = int(np.searchsorted(begin, low, "right")) - 1
                found.append((docs[k], low - begin[k], end - low, q))
        inner = np.ones(len(at), bool)
        inner[last] = False
        rest[at[inner]] = within[inner]
        p *= 2
        docs = docs[n[docs] >= MIN_EXPONENT * p]
    out = np.array(found, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _lists(rows: np.ndarray, n_docs: int) -> pa.Array:
    offsets = np.searchsorted(rows[:, 0], np.arange(n_docs + 1)).astype(np.int32)
    fields = [pa.array(rows[:, k]) for k in (1, 2, 3)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))


def _repeats(words: Words, rows: np.ndarray) -> np.ndarray:
    """Which words some run contains after its first period."""
    first = words.bounds[rows[:, 0]] + rows[:, 1]
    change = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(change, first + rows[:, 3], 1)
    np.add.at(change, first + rows[:, 2], -1)
    return np.cumsum(change)[:-1] > 0


def _strongest(rows: np.ndarray) -> tuple[int, int, int]:
    """Start, length and period of a document's run of greatest length / period; ties: smallest start, then period."""
    ratio = rows[:, 2] / rows[:, 3]  # rounding keeps the order, so the greatest is among those of the greatest quotient
    near = rows[ratio == ratio.max()].tolist()
    _, start, length, period = max(near, key=lambda r: (Fraction(r[2], r[3]), -r[1], -r[3]))
    return start, length, period


def _scan(text: pa.Array) -> list[pa.Array]:
    """The columns ADDED for texts."""
    raw, offsets = text_bytes(text)
    counts, runs, best, kept = [], [], [], []
    for i, j in blocks(offsets):
        words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        rows = find_runs(words.hash, words.bounds)
        counts.append(pa.array(words.counts, pa.int64()))
        runs.append(_lists(rows, j - i))
        at = np.searchsorted(rows[:, 0], np.arange(j - i + 1))
        best += [dict(zip(("start", "length", "period"), _strongest(rows[a:b]))) if b > a else None for a, b in zip(at, at[1:])]
        kept.append(joined(words, ~_repeats(words, rows)))
    return [pa.concat_arrays(counts), pa.concat_arrays(runs), pa.array(best, runs[0].type.value_type), pa.concat_arrays(kept)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The periodic runs of every document, a row per row of ``docs``.

    A run is a stretch of consecutive words with smallest period q (words q apart are the same) and at least
    max(MIN_LENGTH, MIN_EXPONENT * q) words that no neighbouring word extends. ``runs`` has all of a document's, by
    start, then period, ``strongest`` the one of the greatest length / period (ties: smallest start, then period).
    ``kept_text`` has the words that no run contains after its first period, joined by one space.

    Every period is probed on the grid of its own multiples: where words at neighbouring points are the same, the
    stretch is extended to both sides by comparing chunks of doubling size. Points in runs found before are
    skipped. No document needs another one, so nothing is shuffled; a document is worked on as a whole.

    Defined cases: null and blank text have no words, no runs (an empty list and a null ``strongest``) and an empty
    ``kept_text``; ids of any type, null ones and repeated rows come back as they are; an empty table gives no rows;
    other columns are not read. Words are compared by 64-bit hashes.

    Returns doc_id, n_words, runs, strongest, kept_text.
    """
    docs = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_scan(batch.column("text"))], names=["doc_id", "n_words", "runs", "strongest", "kept_text"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {ADDED}")


def planted(text: Column, doc_id: Column) -> Column:
    """The text, repeated from some word on in one of ten documents, as a crc of the id decides."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        return F.transform(w, lambda _, i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p)))

    # the list of words is an element of a list, so that it is made once per text
    again = F.array_join(F.get(F.transform(F.array(words), repeated), F.lit(0)), " ")
    return F.when((h % 10 == 0) & F.coalesce(text, F.lit("")).rlike(WORD), again).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         -- crc32 of the id, byte after byte and bit after bit
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
           lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)))) AS h
  FROM documents
), g AS (
  SELECT doc_id, w, h, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
), m AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g
), base AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS k, CASE WHEN h % 10 = 0 THEN a ELSE n END AS a, p FROM m
), words AS (
  SELECT b.doc_id, b.k, s.x FROM base b JOIN base s ON s.doc_id = b.doc_id AND s.k = CASE WHEN b.k < b.a THEN b.k ELSE b.a + (b.k - b.a) % b.p END
), periods AS (
  SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS p FROM m
), grid AS (
  SELECT doc_id, p, p * unnest(range((n - 1) // p + 1)) AS k FROM periods
), cand AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, p, x, lead(x) OVER g AS y, lead(x, 2) OVER g AS z, lead(x, 3) OVER g AS u
    FROM grid JOIN words USING (doc_id, k) WINDOW g AS (PARTITION BY doc_id, p ORDER BY k)
  ) WHERE x = y AND x = z AND x = u
), same AS (
  SELECT c.doc_id, c.p, a.k, a.k - row_number() OVER (PARTITION BY c.doc_id, c.p ORDER BY a.k) AS island
  FROM cand c JOIN words a ON a.doc_id = c.doc_id JOIN words b ON b.doc_id = c.doc_id AND b.k = a.k + c.p WHERE (b.x = a.x) IS TRUE
), stretch AS (
  SELECT doc_id, p, min(k) AS s, count(*) + p AS l FROM same GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)
), runs AS (
  SELECT doc_id, s, l, min(p) AS p FROM stretch GROUP BY doc_id, s, l
), per_doc AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM runs GROUP BY doc_id
), best AS (
  SELECT DISTINCT ON (doc_id) doc_id, s, l, p FROM runs ORDER BY doc_id, l / p DESC, s, p
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + p, s + l)) AS k FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(w.x, ' ' ORDER BY w.k) AS t FROM words w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.k = w.k WHERE gone.k IS NULL GROUP BY w.doc_id
)
SELECT m.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM m LEFT JOIN per_doc USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
