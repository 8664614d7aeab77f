"""Substring dedup: repeated runs of words found through difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, arrow_batches, blocks, bounded_batches, first_of_runs, materialize, mix64, ragged, record_batch, text_bytes

#: Words of the shortest match that counts.
WINDOW = 13
#: {0, 1, 3} has every residue modulo 7 as a difference, so for positions i and j of two copies of a passage
#: there is one shift s < 7 that puts both i + s and j + s on the cover.
PERIOD, COVER = 7, (0, 1, 3)
#: An anchor of this many words at that shift still lies within any match of WINDOW words.
ANCHOR = WINDOW - PERIOD + 1

#: Id that stands for null: such documents come after all others.
NULL_ID = (1 << 63) - 1

#: How a row takes part: it asks whether a smaller document has its key, asks and has later company in its own
#: batch, or was told within its batch already.
ASK, ASK_SHARED, TOLD = 0, 1, 2

#: A place is position << 32 | kind << 29 | tag. Rows are (doc, place, key...): neighbouring rows then differ only
#: where the position and the key stand, side by side, and shuffle files compress well.
_TAG = (1 << 29) - 1
_HITS = pa.schema([("doc", pa.int64()), ("place", pa.int64())])
_HITS_DDL = "doc long, place long"


def _schema(keys: int) -> tuple[pa.Schema, str]:
    names = ["doc", "place", *(f"key{k}" for k in range(keys))]
    return pa.schema([(c, pa.int64()) for c in names]), ", ".join(f"{c} long" for c in names)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, text): tag tells apart rows that share an id but not their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.crc32(text.cast("binary")).bitwiseAND(_TAG).alias("tag"), text.alias("text"))


def _rows(keys: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows for the exchange, after the part of the comparison that needs none.

    Within a block of documents only the smallest document of each key has to ask the others. The rest know
    that a smaller document has their key; they travel under hashes of their own. So a key that a third of all
    documents have becomes one row per block.
    """
    order = np.lexsort((doc, *reversed(keys)))
    begins = first_of_runs(*(k[order] for k in keys))
    run = np.cumsum(begins) - 1
    by_key = doc[order]
    late = by_key != by_key[begins][run]
    shared = np.zeros(run[-1] + 1 if len(run) else 0, bool)
    shared[run[late]] = True
    kind = np.empty(len(doc), np.int64)  # back in the order of the text
    kind[order] = np.where(late, TOLD, np.where(shared[run], ASK_SHARED, ASK))
    told = kind == TOLD
    own = mix64(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)).view(np.int64)
    schema, _ = _schema(len(keys))
    return record_batch(schema, doc, place | (kind << 29), np.where(told, own, keys[0]), *(np.where(told, 0, k) for k in keys[1:]))


def _find(keys: int, first_too: bool):
    """Over rows sorted by (keys, doc): the places whose key a smaller document has.

    With ``first_too`` also the places of the smallest document itself, if another document has the key. What is
    carried from batch to batch is one row, or the rows of one key of one document, whatever a run's length.
    """
    names = _schema(keys)[0].names

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.empty(0, np.int64) for _ in names]
        for batch in arrow_batches(it, names):
            told = (batch[1] >> 29) & 3 == TOLD
            done = batch[0][told], batch[1][told]
            doc, place, *key = (np.concatenate([c, x[~told]]) for c, x in zip(carry, batch))
            if len(doc):
                begins = first_of_runs(*key)
                no = np.cumsum(begins) - 1
                later = doc > doc[begins][no]
                shared = np.zeros(no[-1] + 1, bool)
                shared[no[later | ((place >> 29) & 3 == ASK_SHARED)]] = True
                hit = (later | shared[no] if first_too else later) & (place >= 0)
                done = np.concatenate([done[0], doc[hit]]), np.concatenate([done[1], place[hit]])
                open_run = np.flatnonzero(no == no[-1])
                if shared[-1] or not first_too:  # one row, of no place, stands for the run from here on
                    open_run = open_run[:1]
                    place = place.copy()
                    place[open_run] = (-1 << 32) | ((ASK_SHARED if shared[-1] else ASK) << 29)
                carry = [x[open_run] for x in (doc, place, *key)]
            if len(done[0]):
                yield record_batch(_HITS, *done)

    return run


def _exchange(rows: DataFrame, keys: int, first_too: bool) -> DataFrame:
    """Places that share their key with another document, grouped by document row."""
    hits = rows.repartition("key0").sortWithinPartitions(*(f"key{k}" for k in range(keys)), "doc").mapInArrow(_find(keys, first_too), _HITS_DDL)
    hits = hits.select("doc", F.col("place").bitwiseAND(_TAG).alias("tag"), F.shiftright("place", 32).cast("int").alias("pos"))
    return hits.groupBy("doc", "tag").agg(F.collect_list("pos").alias("places"))


def _batches(it: Iterator[pa.RecordBatch]):
    """For each block of documents: words, ids, tags and, if there, the lists of places as (bounds, values)."""
    for batch in it:
        doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
        raw, offsets = text_bytes(batch.column("text"))
        bounds = values = None
        if "places" in batch.schema.names:
            lists = batch.column("places")
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in blocks(offsets):
            words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if bounds is None:
                yield words, doc[i:j], tag[i:j], None
            else:  # places count from the document's first word; here from the block's
                at = np.repeat(words.bounds[:-1], np.diff(bounds[i : j + 1])) + values[bounds[i] : bounds[j]]
                yield words, doc[i:j], tag[i:j], at


def _locate(words: Words, doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and place of the words with indices ``at``."""
    own = words.doc[at]
    return doc[own], ((at - words.bounds[own]) << 32) | tag[own].astype(np.int64)


def _anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, doc, tag, _ in _batches(it):
        key, at = words.windows(ANCHOR)
        position = at - words.bounds[words.doc[at]]
        on = np.isin(position % PERIOD, COVER) & (words.counts[words.doc[at]] >= WINDOW)
        key, at = key[on].view(np.int64), at[on]
        if len(at):
            yield _rows([key], *_locate(words, doc, tag, at))


def _candidates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that contain a shared anchor at one of the shifts 0 .. PERIOD - 1, under 128 bits of hash."""
    for words, doc, tag, anchors in _batches(it):
        key, at = words.windows(WINDOW)
        if not len(at):
            continue
        mark = np.zeros(len(words.hash) + 1, np.int64)
        mark[anchors + 1] = 1
        mark = np.cumsum(mark)
        on = mark[np.minimum(at + PERIOD, len(mark) - 1)] > mark[at]
        low = words.windows(WINDOW, seed=0x5DEECE66D)[0]
        if on.any():
            yield _rows([key[on].view(np.int64), low[on].view(np.int64)], *_locate(words, doc, tag, at[on]))


def _cut(words: Words, starts: np.ndarray) -> np.ndarray:
    """Which words the windows that begin at ``starts`` cover."""
    change = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return np.cumsum(change)[:-1] > 0


_OUT = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _remove(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, doc, _, starts in _batches(it):
        gone = _cut(words, starts)
        keep = np.flatnonzero(~gone)
        # a kept word and the space after it, copied with one index array; the last space of a document is left out
        length = words.end[keep] - words.start[keep] + 1
        n_kept = np.diff(np.searchsorted(keep, words.bounds))
        ends = np.cumsum(n_kept)[n_kept > 0] - 1
        length[ends] -= 1
        raw = np.append(words.raw, np.uint8(32))
        index = ragged(words.start[keep], length)
        data = raw[np.minimum(index, len(raw) - 1)]
        stop = np.cumsum(length)
        inner = np.ones(len(keep), bool)
        inner[ends] = False
        data[stop[inner] - 1] = 32
        offsets = np.zeros(len(doc) + 1, np.int64)
        np.cumsum(np.bincount(words.doc[keep], weights=length, minlength=len(doc)).astype(np.int64), out=offsets[1:])
        text = pa.LargeStringArray.from_buffers(len(doc), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())
        removed = np.bincount(words.doc[gone], minlength=len(doc))
        yield record_batch(_OUT, doc, words.counts, removed, text)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every run of WINDOW or more words that a document with a smaller id also has.

    1. Anchors (ANCHOR words) are hashed at the cover positions of each document, 3 of 7, and compared by hash
       across documents. 2. Only windows of WINDOW words around a shared anchor are hashed, with 128 bits, and
       compared; any two equal windows hold an aligned shared anchor, so none is missed. 3. Windows whose
       sequence a smaller document has remove the words that they cover. Windows are judged on the input.

    Comparison is a sort by hash and one streaming pass with constant state; keys with many copies are reduced
    within each batch first (see ``_rows``), and no pairs of copies are made.

    Defined cases: null or blank text has no words; repeated ids are one document for the order, so neither
    removes the other's words, and each row is judged on its own text; a null id comes after all ids; an empty
    table gives no rows; other columns are not read. A text may have up to 2**31 words.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space).
    """
    keyed = _keyed(bounded_batches(docs), id_col, text_col)
    anchors = materialize(_exchange(keyed.mapInArrow(_anchors, _schema(1)[1]), 1, True), "substring-anchors")
    near = keyed.join(anchors, ["doc", "tag"]).select("doc", "tag", "text", "places")
    windows = materialize(_exchange(near.mapInArrow(_candidates, _schema(2)[1]), 2, False), "substring-windows")
    cut = keyed.join(windows, ["doc", "tag"], "left").select("doc", "tag", "text", "places")
    out = cut.mapInArrow(_remove, "doc long, n_words long, n_removed long, kept_text string")
    return out.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_text")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM later
), words AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d
), kept AS (
  SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.k) FILTER (WHERE gone.k IS NULL) AS t, count(gone.k) AS n_removed
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY words.doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(kept.n_removed, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
