"""Language ID by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import blocks, bounded_batches, crc_mod, documents, stable_hash, text_bytes

#: Bytes of context at most.
ORDER = 3
#: Rows that are learned from per language at most (chosen by a hash of id and text).
MAX_ROWS = 20_000
#: Bytes of text whose code lengths are computed at once.
PORTION = 1 << 20
UNKNOWN = "und"

_SPACE = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All documents of a block with ORDER spaces before each, and the positions of the real bytes."""
    at = np.arange(len(raw)) + ORDER * (1 + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)))
    out = np.full(len(raw) + ORDER * len(offsets), _SPACE, np.uint8)
    out[at] = raw
    return out, at


def _codes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the ORDER bytes before it and itself, the latest lowest."""
    text, at = _padded(raw, offsets)
    code = np.zeros(len(at), np.uint32)
    for k in range(ORDER, -1, -1):
        code = (code << np.uint32(8)) | text[at - k]
    return code


def _grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (ORDER + 1)-byte sequences, most recent byte lowest, per language and batch."""
    for batch in it:
        lang = batch.column("lang")
        for name in lang.unique().to_pylist():
            raw, offsets = text_bytes(batch.column("text").filter(pa.compute.equal(lang, name)))
            for i, j in blocks(offsets):
                code, count = np.unique(_codes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(count)], names=["lang", "code", "n"])


@dataclass
class Tree:
    """A language's byte context tree with frozen code lengths, in bits.

    For each order 0 .. ORDER: ``keys`` are the sorted (context, byte) that occur, ``bits`` their code lengths;
    ``contexts`` are the sorted contexts, ``escapes`` what a byte that never followed costs besides its length in
    the context that is one byte shorter.
    """

    keys: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def lengths(self, code: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each code after the bytes before it."""
        out, left = np.zeros(len(code)), np.arange(len(code))
        for order in range(ORDER, -1, -1):
            key = code[left] & np.uint32((1 << 8 * (order + 1)) - 1)
            where, hit = _found(self.keys[order], key)
            out[left[hit]] += self.bits[order][where[hit]]
            left, key = left[~hit], key[~hit]
            where, hit = _found(self.contexts[order], key >> np.uint32(8))
            out[left[hit]] += self.escapes[order][where[hit]]
        out[left] += 8
        return out


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether the wanted ones are there."""
    where = np.searchsorted(keys, wanted)
    return where, keys[np.minimum(where, len(keys) - 1)] == wanted if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class ContextTrees:
    """The trees of all languages."""

    langs: list[str]
    trees: list[Tree]

    def code_lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Total bits of each document of a block under each language's tree."""
        code, where = np.unique(_codes(raw, offsets), return_inverse=True)
        out = np.empty((len(offsets) - 1, len(self.trees)))
        total = np.zeros(len(raw) + 1)
        for i, tree in enumerate(self.trees):
            np.cumsum(tree.lengths(code)[where], out=total[1:])
            out[:, i] = total[offsets[1:]] - total[offsets[:-1]]
        return out


def _tree(code: np.ndarray, count: np.ndarray) -> Tree:
    """Prediction by partial matching with full exclusion, frozen: a byte seen n times in a context of ``total``
    bytes, ``distinct`` different ones, has probability n / (total + distinct); the rest goes to the other bytes in
    proportion to their probabilities in the context that is one byte shorter, where all bytes are alike at last."""
    tree, before = Tree([], [], [], []), None
    for order in range(ORDER + 1):
        keys, where = np.unique(code & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
        n = np.bincount(where, weights=count)
        contexts, node = np.unique(keys >> np.uint32(8), return_inverse=True)
        total, distinct = np.bincount(node, weights=n), np.bincount(node)
        # what the shorter context gives the bytes seen here: each was seen there, too
        shorter = np.full(len(keys), 1 / 256) if before is None else before[np.searchsorted(tree.keys[-1], keys & np.uint32((1 << 8 * order) - 1))]
        left = 1 - np.bincount(node, weights=shorter)
        escape = np.where(left > 1e-9, distinct / (total + distinct), 0)
        here = n / total[node] * (1 - escape[node])
        tree.keys.append(keys)
        tree.bits.append(-np.log2(here))
        tree.contexts.append(contexts)
        tree.escapes.append(np.where(left > 1e-9, -np.log2(np.where(escape > 0, escape, 1) / np.maximum(left, 1e-9)), 1000.0))
        before = here
    return tree


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> ContextTrees:
    """Context trees of every language of ``docs``, from at most about ``max_rows`` rows of each.

    Rows without language or text are left out. The driver gets byte sequences and their counts, whose number is
    bounded by ``max_rows`` and the languages' spelling and not by the corpus.
    """
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.broadcast(sizes.select("lang", (F.lit(float(max_rows)) / F.col("n")).alias("share")))  # a row per language
    picked = rows.join(share, "lang").filter(stable_hash(F.concat_ws("|", F.col("id").cast("string"), F.xxhash64("text").cast("string"))) < F.col("share")).select("lang", "text")
    grams = picked.mapInArrow(_grams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    lang, code, n = (grams.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "code", "n"))
    langs = sorted(set(lang))
    return ContextTrees(langs, [_tree(code[lang == name].astype(np.uint32), n[lang == name].astype(float)) for name in langs])


def _letters(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents have a letter: an ASCII one, or any other that Unicode calls a letter."""
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_ASCII_LETTER[raw], out=total[1:])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for k in np.flatnonzero(~out):
        out[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "ignore"))
    return out


def identify(docs: DataFrame, model: ContextTrees, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (posterior of that language, all alike before) added.

    The language is the one whose tree gives the whole text the shortest code. Defined cases: a null text and a
    text without a letter are ``und`` with score 0, as is everything if no language was learned; ties go to the
    first name; an empty table gives no rows. Columns named lang_pred or score are replaced.
    """
    frozen = docs.sparkSession.sparkContext.broadcast(model)  # 20 bytes a sequence that the learned rows have

    @arrow_udf("struct<lang_pred: string, score: double>")
    def predict(text: pa.Array) -> pa.Array:
        trees = frozen.value
        raw, offsets = text_bytes(text)
        names, scores = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
        for i, j in blocks(offsets, PORTION) if trees.langs else ():
            own, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            bits = trees.code_lengths(own, at)
            best = bits.argmin(axis=1)
            score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            known = _letters(own, at)
            names[i:j] = np.where(known, np.array(trees.langs, object)[best], UNKNOWN)
            scores[i:j] = np.where(known, score, 0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    out = bounded_batches(docs).withColumn("__p", predict(F.col(text_col)))
    return out.withColumn("lang_pred", F.col("__p.lang_pred")).withColumn("score", F.col("__p.score")).drop("__p")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = learn(docs.filter(crc_mod("doc_id", 5) != 0))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
