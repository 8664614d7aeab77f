"""Toxicity: a logistic classifier that is held to the same score when identity terms are swapped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import blocks, bounded_batches, crc_mod, documents, materialize, stable_hash, terms_of, text_bytes

#: Labelled rows of each label that are learned from, at most about (chosen by a hash of the id).
MAX_ROWS = 10_000
#: Features chosen at most, documents that must have one, and the least evidence (likelihood ratio statistic) for it.
MAX_FEATURES, MIN_DOCS, MIN_EVIDENCE = 256, 5, 24.0
#: Weights of the squared weights to choose from, by the log loss of FOLDS parts that were left out in turn.
RIDGES, FOLDS = (1.0, 0.1, 0.01), 3
#: Weight of the squared change of log-odds of a swapped mention.
SWAP = 50.0
#: Scores from here on predict label 1.
THRESHOLD = 0.7

#: Terms that name groups of people, in classes of which any may stand for another; the first of each is neutral.
IDENTITY = (
    ("people", "women", "men", "girls", "boys", "mothers", "fathers", "wives", "husbands"),
    ("person", "woman", "man", "girl", "boy", "mother", "father", "wife", "husband"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("residents", "immigrants", "refugees", "migrants", "foreigners", "africans", "americans", "asians", "europeans", "mexicans", "arabs"),
    ("local", "african", "american", "asian", "european", "mexican", "arab", "latino", "black", "white", "indigenous"),
    ("adult", "gay", "lesbian", "bisexual", "transgender", "queer", "straight", "heterosexual", "homosexual"),
    ("patients", "disabled", "blind", "deaf", "autistic", "elderly"),
    ("menschen", "frauen", "männer", "mädchen", "jungen", "christen", "muslime", "juden", "ausländer", "flüchtlinge"),
    ("gens", "femmes", "hommes", "filles", "garçons", "chrétiens", "musulmans", "juifs", "étrangers", "réfugiés"),
    ("personas", "mujeres", "hombres", "niñas", "niños", "cristianos", "musulmanes", "judíos", "extranjeros", "refugiados"),
)
_CLASS_OF = {t: c for c, terms in enumerate(IDENTITY) for t in terms}
_TERMS = pa.array(sorted(_CLASS_OF))

_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?\n")] = True


class Sentences:
    """The terms of a block of documents: ``code`` of each in ``names``, its document and its sentence."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        terms, start = terms_of(raw, offsets)
        coded = terms.dictionary_encode()
        self.names = coded.dictionary.cast(pa.string())
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.doc = np.searchsorted(offsets, start, "right") - 1
        edges = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_BREAK[raw], out=edges[1:])
        sentence = edges[start] + self.doc  # no two documents share one
        self.same = np.append(sentence[1:] == sentence[:-1], False) if len(start) else np.empty(0, bool)
        self.sentence = sentence
        identity = pc.is_in(self.names, _TERMS).to_numpy(zero_copy_only=False)
        self.identity = identity[self.code] if len(start) else np.empty(0, bool)

    def features(self) -> tuple[np.ndarray, pa.Array]:
        """(document, feature) pairs, with repeats: all terms, and pairs of neighbours in a sentence of which one
        is an identity term."""
        near = self.identity.copy()
        near[:-1] |= self.identity[1:]
        at = np.flatnonzero(near & self.same)
        names = self.names.take(pa.array(self.code))
        pairs = pc.binary_join_element_wise(names.take(pa.array(at)), names.take(pa.array(at + 1)), " ")
        return np.concatenate([self.doc, self.doc[at]]), pa.concat_arrays([names, pairs])


def _distinct(doc: np.ndarray, index: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(doc * width + index)
    return key // width, key % width


def _spans(column: pa.Array):
    raw, offsets = text_bytes(column)
    for i, j in blocks(offsets):
        yield i, j, Sentences(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _evidence(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the documents of label 0 and 1 that have a feature."""
    for batch in it:
        y = batch.column("y").to_numpy()
        for i, j, sentences in _spans(batch.column("text")):
            doc, names = sentences.features()
            coded = names.dictionary_encode()
            doc, index = _distinct(doc, coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary)))
            n = [np.bincount(index[y[i:j][doc] == k], minlength=len(coded.dictionary)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([coded.dictionary, *(pa.array(x, pa.int64()) for x in n)], names=["feature", "n0", "n1"])


def _vectors(features: pa.Array):
    """The features that each text has, by number, with its label and fold."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, sentences in _spans(batch.column("text")):
                doc, index = present(sentences, features)
                offsets = pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(index, pa.int32())), batch.column("y").slice(i, j - i), batch.column("fold").slice(i, j - i)], names=["x", "y", "fold"])

    return run


def present(sentences: Sentences, features: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, number of a feature that it has), sorted, each once."""
    doc, names = sentences.features()
    index = pc.index_in(names, features).fill_null(-1).to_numpy().astype(np.int64)
    return _distinct(doc[index >= 0], index[index >= 0], max(1, len(features)))


def swaps(terms: list[str], at: int, known: dict[str, int]) -> list[dict[int, int]]:
    """How the features of a sentence change when its identity term ``at`` gives way to each other of its class."""

    def bag(words: list[str]) -> set[int]:
        pairs = (f"{a} {b}" for a, b in zip(words, words[1:]) if a in _CLASS_OF or b in _CLASS_OF)
        return {known[f] for f in (*words, *pairs) if f in known}

    before, out = bag(terms), []
    for other in IDENTITY[_CLASS_OF[terms[at]]]:
        if other != terms[at]:
            after = bag([*terms[:at], other, *terms[at + 1 :]])
            out.append({f: 1 for f in after - before} | {f: -1 for f in before - after})
    return out


def _changes(features: pa.Array):
    """Entries (i, j, v) of the sum over swapped mentions of d d', d the change of features, averaged over its swaps."""
    known = {f: k for k, f in enumerate(features.to_pylist())}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for _, _, s in _spans(batch.column("text")):
                total: dict[tuple[int, int], float] = {}
                begin = np.flatnonzero(np.append(True, ~s.same[:-1])) if len(s.same) else []
                for k in np.flatnonzero(s.identity):
                    low = begin[np.searchsorted(begin, k, "right") - 1]
                    high = k + 1 + int(s.same[k:].argmin())
                    terms = s.names.take(pa.array(s.code[low:high])).to_pylist()
                    found = swaps(terms, int(k - low), known)
                    for d in found:
                        for a, x in d.items():
                            for b, y in d.items():
                                total[a, b] = total.get((a, b), 0.0) + x * y / len(found)
                if total:
                    i, j = zip(*total)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(list(total.values()))], names=["i", "j", "v"])

    return run


@dataclass
class Model:
    """Log-odds of label 1: ``bias`` plus the weights of the features that a text has."""

    features: list[str]
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        features, out = pa.array(self.features, pa.string()), np.full(len(column), self.bias)
        for i, j, sentences in _spans(column):
            doc, index = present(sentences, features)
            out[i:j] += np.bincount(doc, weights=self.weights[index], minlength=j - i)
        return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, changes: np.ndarray, ridge: float, swap: float = SWAP) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the weighted log loss + ridge / 2 |w|^2 + swap / 2 w' changes w, by Newton steps.

    ``rows`` are the numbers of the features that each row has. ``changes`` sums d d' over swapped mentions, d being how a swap
    changes the features, so that the last part is the squared change of the log-odds.
    """
    d = len(changes)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    index = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    penalty = np.zeros((d + 1, d + 1))
    penalty[:d, :d] = ridge * np.eye(d) + swap * changes
    penalty[d, d] = 1e-6
    theta = np.zeros(d + 1)

    def loss(t: np.ndarray) -> tuple[float, np.ndarray]:
        z = t[d] + np.bincount(owner, weights=t[index], minlength=len(rows))
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + t @ penalty @ t / 2), z

    now, z = loss(theta)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z))
        off, curve = weight * (p - y), weight * p * (1 - p)
        gradient = np.append(np.bincount(index, weights=off[owner], minlength=d), off.sum()) + penalty @ theta
        hessian = penalty.copy()
        for i in range(0, len(rows), 1024):  # rows as 0 and 1, some at a time
            x = np.zeros((min(1024, len(rows) - i), d + 1))
            mine = (owner >= i) & (owner < i + 1024)
            x[owner[mine] - i, index[mine]] = 1
            x[:, d] = 1
            hessian += (x * curve[i : i + 1024, None]).T @ x
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(theta - size * step)[0] > now:
            size /= 2
        theta = theta - size * step
        before, (now, z) = now, loss(theta)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return theta[:d], float(theta[d])


def choose(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, changes: np.ndarray, fold: np.ndarray, ridges: tuple[float, ...], swap: float) -> float:
    """The ridge whose fits to all but one fold have the least log loss on that fold."""
    losses = []
    for ridge in ridges if len(ridges) > 1 else ():
        total = 0.0
        for k in np.unique(fold):
            learned, left = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            w, bias = fit([rows[i] for i in learned], y[learned], weight[learned], changes, ridge, swap)
            z = np.array([bias + w[rows[i]].sum() for i in left])
            total += float((weight[left] * (np.logaddexp(0, z) - y[left] * z)).sum())
        losses.append(total)
    return ridges[int(np.argmin(losses))] if losses else ridges[0]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, ridges: tuple[float, ...] = RIDGES, swap: float = SWAP) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` marks 0 or 1, at most about ``max_rows`` of each label.

    Features are counted over these rows by Spark; those that tell the labels apart stay, and all identity terms that
    occur. Identity terms are swapped within their sentences, and the changes of features that this makes
    are added up by Spark. The driver gets the features' numbers of ``max_rows`` rows a label at most. Rows of
    a label weigh as much as all of its rows. Without rows of both labels every score is the share of label 1.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)").join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    counted = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    n = np.array([counted.get(0, 0), counted.get(1, 0)], float)
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 1:
        return Model([], np.empty(0), prior)
    share = F.when(F.col("y") == 1, max_rows / n[1]).otherwise(max_rows / n[0])
    picked = F.broadcast(marked.filter(stable_hash(F.col("id").cast("string")) < share))  # about 2 * max_rows pairs of numbers
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(picked, "id")
    rows = rows.select("text", "y", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = materialize(rows, "toxicity-rows")

    of = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    m = np.array([of.get(0, 0), of.get(1, 0)], float)
    if m.min() < 1:
        return Model([], np.empty(0), prior)
    stats = rows.mapInArrow(_evidence, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def part(k: str, seen: str, of_all: float) -> str:  # k ln(k / expected) of one cell
        return f"CASE WHEN {k} > 0 THEN {k} * ln({k} * {m.sum()}D / (({seen}) * {of_all}D)) ELSE 0D END"

    cells = [part("n0", "n0 + n1", m[0]), part("n1", "n0 + n1", m[1]), part(f"({m[0]}D - n0)", f"{m.sum()}D - n0 - n1", m[0]), part(f"({m[1]}D - n1)", f"{m.sum()}D - n0 - n1", m[1])]
    stats = stats.withColumn("evidence", 2 * F.expr(" + ".join(f"({c})" for c in cells)))
    told = stats.filter((F.col("n0") + F.col("n1") >= MIN_DOCS) & (F.col("evidence") >= MIN_EVIDENCE)).orderBy(F.desc("evidence"), "feature").limit(MAX_FEATURES).select("feature")
    named = stats.filter(F.col("feature").isin(_TERMS.to_pylist())).select("feature")
    features = sorted({r["feature"] for r in told.union(named).collect()})  # MAX_FEATURES and the identity terms at most
    table = pa.array(features, pa.string())

    data = rows.mapInArrow(_vectors(table), "x array<int>, y int, fold int").toArrow()
    y = data.column("y").to_numpy().astype(float)
    changes = np.zeros((len(features), len(features)))
    if any(f in _CLASS_OF for f in features):
        for r in rows.mapInArrow(_changes(table), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            changes[r["i"], r["j"]] = r["v"]
    x, weight = [r.values.to_numpy() for r in data.column("x")], (n / m)[y.astype(int)]
    weights, bias = fit(x, y, weight, changes, choose(x, y, weight, changes, data.column("fold").to_numpy(), ridges, swap), swap)
    return Model(features, weights, bias)


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (1 from THRESHOLD on) added.

    Defined cases: null text is scored as the empty text, whose score is that of a text without any feature; texts of
    any length are scored whole; an empty table gives no rows. Columns named score or predicted are replaced.
    """

    @arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(text))

    return bounded_batches(docs).withColumn("score", score(F.coalesce(F.col(text_col), F.lit("")))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = learn(docs.filter(crc_mod("doc_id", 3) != 1), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
