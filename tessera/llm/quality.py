"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import Words, blocks, bounded_batches, crc_mod, documents, first_of_runs, text_bytes

#: Least weight of the pooled covariance, and of its diagonal, in a class's covariance.
SHRINK, RIDGE = 0.5, 0.01
#: Log-density differences are divided by this before they become a score: statistics are not Gaussian, so
#: the raw posterior would be far too sure of itself.
TEMPERATURE = 4.0
#: Scores from here on predict label 1.
THRESHOLD = 0.7
#: Words of a segment; the worst segment of a document counts on its own, so that long documents cannot hide junk.
SEGMENT = 64

_CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "stop": b".!?",
    "comma": b",;:'\"-()",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~",
    "newline": b"\n",
    "high": range(128, 256),
}
_LUT = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}

FEATURES = ("length", "word_mean", "word_sd", "distinct", "repeat", "top", *_CLASSES, "line", "segment_repeat", "segment_distinct", "segment_symbol", "segment_word")


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per document of a block; a text without words gives finite values too."""
    words = Words(raw, offsets, lower=True)
    n_docs = len(offsets) - 1
    n = words.counts.astype(float)
    n1 = np.maximum(n, 1)
    size = np.maximum(np.diff(offsets).astype(float), 1)

    def per_doc(values):
        return np.bincount(words.doc, weights=values, minlength=n_docs)

    length = (words.end - words.start).astype(float)
    mean = per_doc(length) / n1
    sd = np.sqrt(np.maximum(per_doc(length**2) / n1 - mean**2, 0))

    def tally(owner, n_owners):
        """Distinct words and the count of the commonest word of each owner."""
        key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (words.hash >> np.uint64(24)))
        start = np.flatnonzero(first_of_runs(key))
        run = np.diff(np.append(start, len(key)))
        who = (key[start] >> np.uint64(40)).astype(np.int64)
        most = np.zeros(n_owners)
        np.maximum.at(most, who, run)
        return np.bincount(who, minlength=n_owners).astype(float), most

    distinct, most = tally(words.doc, n_docs)
    again = np.zeros(len(words.hash))
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])

    shares = []
    sums = {}
    for name, lut in _LUT.items():
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(lut[raw], out=total[1:])
        if name == "symbol":
            sums[name] = total
        shares.append(np.log((total[offsets[1:]] - total[offsets[:-1]]) / size + 1e-3))
    lines = np.exp(shares[list(_CLASSES).index("newline")]) - 1e-3

    # the worst of each document's segments of SEGMENT words (a short rest joins the one before)
    index = np.arange(len(words.hash)) - words.bounds[words.doc]
    last = np.maximum(words.counts // SEGMENT, 1) - 1
    base = np.concatenate([[0], np.cumsum(last + 1)])
    seg = base[words.doc] + np.minimum(index // SEGMENT, last[words.doc])
    n_seg = int(base[-1])
    in_seg = np.maximum(np.bincount(seg, minlength=n_seg), 1).astype(float)
    seg_distinct, _ = tally(seg, n_seg)
    seg_again = np.bincount(seg, weights=again, minlength=n_seg) / in_seg
    symbols = (sums["symbol"][words.end] - sums["symbol"][words.start]) > 0
    seg_symbol = np.bincount(seg, weights=symbols, minlength=n_seg) / in_seg
    seg_word = np.bincount(seg, weights=length, minlength=n_seg) / in_seg
    start = base[:-1]

    def worst(values, low=False):
        return (np.minimum if low else np.maximum).reduceat(values, start) if n_seg else np.zeros(n_docs)

    return np.column_stack([
        np.log(n + 1), np.log(mean + 1), np.log(sd + 0.1), np.log(distinct + 1) / np.log(n + 2),
        np.log(per_doc(again) / n1 + 1e-3), np.log(most / n1 + 1e-3), *shares, np.log(lines * size / n1 + 1e-3),
        np.log(worst(seg_again) + 1e-2), np.log(worst(np.where(np.bincount(seg, minlength=n_seg) > 0, seg_distinct / in_seg, 1.0), low=True) + 1e-2),
        np.log(worst(seg_symbol) + 1e-2), np.log(worst(seg_word) + 1),
    ])


def _statistics_of(column: pa.Array) -> np.ndarray:
    raw, offsets = text_bytes(column)
    parts = [statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets)]
    return np.concatenate(parts) if parts else np.empty((0, len(FEATURES)))


@dataclass
class Discriminant:
    """Per class: mean, inverse Cholesky factor and log normaliser, with the log prior in it."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, from the difference of the two log densities."""
        if not len(self.means):
            return np.full(len(x), self.prior)
        log = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        gap = np.clip((log[1] - log[0]) / TEMPERATURE, -700, 700)
        return 1 / (1 + np.exp(-gap))


def fit(count: np.ndarray, total: np.ndarray, outer: np.ndarray) -> Discriminant:
    """From each class's number of rows, sum and sum of outer products.

    A class of fewer than two rows leaves no covariance to learn: every score is then the smoothed share of
    class 1.
    """
    prior = float((count[1] + 1) / (count.sum() + 2))
    if count.min() < 2:
        return Discriminant(np.empty((0, 0)), np.empty((0, 0, 0)), np.empty(0), prior)
    mean = total / count[:, None]
    scatter = outer - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(axis=0) / count.sum()
    diagonal = np.diag(np.diag(pooled) + 1e-6)
    factors, offsets = [], []
    for c in (0, 1):
        shrink = max(SHRINK, len(pooled) / (count[c] + len(pooled)))
        cov = (1 - shrink - RIDGE) * scatter[c] / count[c] + shrink * pooled + RIDGE * diagonal
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        offsets.append(-np.log(np.diag(low)).sum() + np.log(count[c] / count.sum()))
    return Discriminant(mean, np.array(factors), np.array(offsets), prior)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Discriminant:
    """Fit on all rows of ``docs`` that ``labels`` marks 0 or 1.

    Statistics are computed where the texts are; only their numbers meet the labels. Sums are added up by
    Spark, the driver gets one number per class and entry of the moments.
    """
    d = len(FEATURES)

    def numbers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = _statistics_of(batch.column("text"))
            flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * d, x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id"), flat], names=["id", "x"])

    def moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, 1 + d, 1 + d))
        for batch in it:
            x = np.column_stack([np.ones(batch.num_rows), batch.column("x").flatten().to_numpy().reshape(-1, d)])
            y = batch.column("y").to_numpy()
            for c in (0, 1):
                acc[c] += x[y == c].T @ x[y == c]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(acc.size)), pa.array(acc.ravel())], names=["k", "v"])

    x = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(numbers, "id long, x array<double>")
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)")
    # a merge join: the two Python steps then lie in stages of their own, so a task never has two workers at once
    sums = x.join(y.hint("merge"), "id").select("x", "y").mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    acc = np.zeros(2 * (1 + d) ** 2)
    acc[sums.column("k").to_numpy()] = sums.column("v").to_numpy()
    acc = acc.reshape(2, 1 + d, 1 + d)
    return fit(acc[:, 0, 0], acc[:, 0, 1:], acc[:, 1:, 1:])


def classify(docs: DataFrame, model: Discriminant, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (1 from THRESHOLD on) added.

    Defined cases: null text is scored as the empty text; texts of any length are scored whole; an empty table
    gives no rows. Columns named score or predicted are replaced.
    """
    @arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(_statistics_of(text)))

    return bounded_batches(docs).withColumn("score", score(F.coalesce(F.col(text_col), F.lit("")))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = (crc_mod("doc_id", 4) == 2).alias("held_out")
    model = learn(docs.filter(crc_mod("doc_id", 4) != 2), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", held, "score", "predicted")
