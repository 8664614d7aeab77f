"""Comparing texts: line differences and word similarity."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.functions.text import bound, nfc, words

#: Lines of a side at most; longer texts are refused, not cut.
MAX_LINES = 2_000


def line_chunks(a: list[str], b: list[str]) -> list[tuple[str, list[str]]]:
    """Runs of unchanged, removed and added lines by a longest common subsequence; on a tie lines are removed first."""
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(s, len(ids)) for s in side], np.int64) for side in (a, b))
    n, m = len(x), len(y)
    # row i has the longest common length of a[i:] and b[j:]; a row depends on the one below it by running maxima
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        take = np.where(y == x[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(take[::-1])[::-1]
    out: list[tuple[str, list[str]]] = []

    def put(op, line):
        if out and out[-1][0] == op:
            out[-1][1].append(line)
        else:
            out.append((op, [line]))

    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            put("unchanged", a[i])
            i, j = i + 1, j + 1
        elif i < n and (j == m or table[i + 1, j] >= table[i, j + 1]):
            put("removed", a[i])
            i += 1
        else:
            put("added", b[j])
            j += 1
    return out


def diff_lines(left: Column, right: Column) -> Column:
    """Chunks of a line difference, null where a side has more than MAX_LINES lines; a null text is empty."""

    @arrow_udf("array<struct<operation: string, lines: array<string>>>")
    def diff(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist()):
            a, b = (a or "").split("\n"), (b or "").split("\n")
            out.append(None if max(len(a), len(b)) > MAX_LINES else [{"operation": o, "lines": x} for o, x in line_chunks(a, b)])
        return pa.array(out, pa.list_(pa.struct([("operation", pa.string()), ("lines", pa.list_(pa.string()))])))

    return diff(left, right)


def chunk_counts(chunks: Column) -> Column:
    """(unchanged, removed, added) line counts of a difference."""

    def total(op):
        return F.aggregate(F.filter(chunks, lambda c: c["operation"] == op), F.lit(0), lambda s, c: s + F.size(c["lines"]))

    return F.struct(*(total(op).alias(op) for op in ("unchanged", "removed", "added")))


#: Runs of letters and digits, as ``words`` has them.
_WORD = re.compile(r"[^\W_]+")


def dice(a: Column, b: Column, where: Column | None = None) -> Column:
    """Multiset similarity of two texts' words, in normal form and lower case: 2 * common / (all of both); 1 if both have none.

    Words are counted in Arrow batches, so the cost grows with the number of words and there is neither explode nor
    join. Null where ``where`` does not hold: such rows' texts are not looked at. Callers bound the size of
    batches by ``bounded_batches``.
    """

    @arrow_udf("double")
    def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for sides in zip(a, b):
            if not all(t.is_valid for t in sides):
                out.append(None)
                continue
            x, y = (_WORD.findall(unicodedata.normalize("NFC", t.as_py()).lower()) for t in sides)
            out.append(1.0 if x == y else 2.0 * (Counter(x) & Counter(y)).total() / (len(x) + len(y)))
        return pa.array(out, pa.float64())

    sides = (F.coalesce(t, F.lit("")) for t in (a, b))
    return similarity(*(t if where is None else F.when(where, t) for t in sides))


def dice_by_counts(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, similarity) for long texts: words are exploded and counted, cost linear in the number of words."""
    side = lambda c, name: pairs.select(key, F.explode(words(F.lower(nfc(F.coalesce(F.col(c), F.lit("")))))).alias("w")).groupBy(key, "w").agg(F.count("*").alias(name))
    both = side(a, "na").join(side(b, "nb"), [key, "w"], "full_outer")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    sums = both.groupBy(key).agg(F.sum(F.least(na, nb)).alias("common"), F.sum(na + nb).alias("total"))
    out = pairs.select(key).join(sums, key, "left")
    return out.select(key, F.when(F.coalesce("total", F.lit(0)) == 0, F.lit(1.0)).otherwise(2.0 * F.col("common") / F.col("total")).alias("similarity"))
