"""Helpers that several operators share: shared storage, deterministic row sampling, word arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a Java/RE2 character class; ASCII white space only.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs within one machine's process (tests), a temporary folder is used; on a cluster
    that would be a folder of the driver alone, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Spark's own setting by which an execution removes its shuffle files as soon as it has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, a lost executor costs nothing.

    The shuffle files of the write go as soon as it has ended; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: Spark's own setting for the bytes of an Arrow batch that goes to a Python worker, and ours.
BATCH_BYTES, OUR_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; from now on its session sends Arrow batches of about OUR_BATCH_BYTES, unless it was told a
    size. A batch of 10,000 long texts would be held by the JVM and the worker at once."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, str(OUR_BATCH_BYTES))
    return df


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` that nothing will read any more."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column's decimal text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


# ---------------------------------------------------------------- text as byte arrays

#: Documents are joined into blocks of about this many bytes before numpy works on them.
BLOCK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer (splitmix64) on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    have = 1
    while have < n:  # doubling: out[have:2*have] = out[:have] * base**have
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


_POW, _POW_INV = np.empty(0, np.uint64), np.empty(0, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as (all bytes, n + 1 offsets); nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about ``limit`` bytes each; a longer single document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of a block of documents: 64-bit hash, owner and byte span of each, in order."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(raw)
        if lower:
            raw = _LOWER[raw]
        word = ~_SPACE[raw]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = word
        start = np.flatnonzero(word & (first[:n] | ~before[:n]))
        after = np.zeros(n + 1, bool)
        after[:n] = word
        end = np.flatnonzero(word & (first[1:] | ~after[1:])) + 1
        global _POW, _POW_INV
        if len(_POW) < n + 1:
            _POW, _POW_INV = _powers(_R, n + 1), _powers(_R_INV, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POW[:n], out=sums[1:])
        self.start, self.end, self.raw, self.offsets = start, end, raw, offsets
        self.hash = mix64((sums[end] - sums[start]) * _POW_INV[start] + (end - start).astype(np.uint64))
        #: word range of document k: bounds[k] .. bounds[k + 1]
        self.bounds = np.searchsorted(start, offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words within a document, and the index of each run's first word."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        acc = np.full(n, seed, np.uint64)
        for k in range(size):
            acc = (acc + self.hash[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
            acc ^= acc >> np.uint64(32)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return mix64(acc[at]), at


def stable_hash(column: Column) -> Column:
    """A uniform double in (0, 1) that depends on the column's value alone."""
    return (F.shiftrightunsigned(F.xxhash64(column, F.lit(20240229)), 11).cast("double") + 0.5) / float(1 << 53)


# ---------------------------------------------------------------- streams of rows sorted by key


def arrow_batches(it: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Each Arrow batch as numpy columns (nulls are not expected)."""
    for batch in it:
        if batch.num_rows:
            yield [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Boolean array: True where a run of equal keys begins."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ..., lengths[i] of them, for all i in turn."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64 if max(total, int(starts.max(initial=0))) > 1 << 30 else np.int32)
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    if total:
        ends = np.cumsum(lengths)
        out[0] = starts[0]
        out[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out, out=out)


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """For each document of a block its words that ``keep`` marks, joined by one space."""
    keep = np.flatnonzero(keep)
    n_docs = len(words.bounds) - 1
    # a word and the space after it, copied with one index array; the last space of a document is left out
    length = words.end[keep] - words.start[keep] + 1
    n_kept = np.diff(np.searchsorted(keep, words.bounds))
    ends = np.cumsum(n_kept)[n_kept > 0] - 1
    length[ends] -= 1
    index = ragged(words.start[keep], length)
    data = np.append(words.raw, np.uint8(32))[np.minimum(index, len(words.raw))]
    inner = np.ones(len(keep), bool)
    inner[ends] = False
    data[np.cumsum(length)[inner] - 1] = 32
    offsets = np.zeros(n_docs + 1, np.int64)
    np.cumsum(np.bincount(words.doc[keep], weights=length, minlength=n_docs).astype(np.int64), out=offsets[1:])
    return pa.LargeStringArray.from_buffers(n_docs, pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def terms_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a block of documents in order, and where each begins.

    A term is a longest run of ASCII letters and characters beyond ASCII, with A-Z in lower case; in UTF-8 these are
    the letters' bytes and all bytes from 128 on.
    """
    inside = _IN_TERM[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    start = cuts[:-1][inside[cuts[:-1]]] if len(raw) else np.empty(0, np.int64)
    length = np.diff(cuts)[inside[cuts[:-1]]] if len(raw) else start
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=at[1:])
    terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(_LOWER[raw[inside]]))
    return terms, start
