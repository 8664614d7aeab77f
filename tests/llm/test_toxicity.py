"""The toxicity classifier: features and swaps against plain Python, the fit against its gradient, behaviour of swaps."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import toxicity
from tessera.llm.common import text_bytes
from tests.llm.test_operators import DDL, texts

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def sentences_of(t):
    return [[w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(s)] for s in re.split(r"[.!?\n]", t or "")]


def features_of(sentence):
    names = {x for terms in toxicity.IDENTITY for x in terms}
    return set(sentence) | {f"{a} {b}" for a, b in zip(sentence, sentence[1:]) if a in names or b in names}


def test_features_of_blocks():
    ts = [*texts(4), "Women vote. men\nsleep! The gay men of ÉPÉE", "muslims", "a.women"]
    raw, offsets = text_bytes(pa.array(ts))
    got = [set() for _ in ts]
    doc, names = toxicity.Sentences(raw, offsets).features()
    for k, f in zip(doc.tolist(), names.to_pylist()):
        got[k].add(f)
    assert got == [set().union(*map(features_of, sentences_of(t))) for t in ts]


def test_changes_equal_brute_force():
    ts = ["women talk. They meet women and jews here\nno one", "jews jews", None, "", "the frauen"]
    features = ["women", "men", "people", "jews", "christians", "women talk", "men talk", "and jews", "and muslims", "frauen", "the frauen", "the menschen"]
    want = Counter()
    for t in ts:
        for s in sentences_of(t):
            for k, w in enumerate(s):
                group = next((c for c in toxicity.IDENTITY if w in c), ())
                for other in group:
                    if other != w:
                        after = features_of([*s[:k], other, *s[k + 1 :]])
                        d = {f: (f in after) - (f in features_of(s)) for f in features}
                        for a in features:
                            for b in features:
                                want[a, b] += d[a] * d[b] / (len(group) - 1)
    got = Counter()
    batch = pa.RecordBatch.from_arrays([pa.array(ts), pa.array([0] * len(ts), pa.int32())], names=["text", "y"])
    for b in toxicity._changes(pa.array(features))(iter([batch])):
        for r in b.to_pylist():
            got[features[r["i"]], features[r["j"]]] += r["v"]
    assert {k: pytest.approx(v) for k, v in want.items() if v} == {k: v for k, v in got.items() if v}


def test_fit_meets_its_condition():
    """At the least loss the gradient is zero; computed here from whole matrices."""
    rng = np.random.default_rng(7)
    x = (rng.random((300, 6)) < 0.3).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(1 - 2 * x[:, 0] - x[:, 1]))).astype(float)
    weight = rng.random(300) + 0.5
    d = rng.integers(-1, 2, (40, 6)).astype(float)
    changes = d.T @ d
    w, bias = toxicity.fit([np.flatnonzero(r) for r in x], y, weight, changes, ridge=0.5, swap=0.1)
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    gradient = x.T @ (weight * (p - y)) + 0.5 * w + 0.1 * changes @ w
    assert np.abs(gradient).max() < 1e-5 and abs((weight * (p - y)).sum()) < 1e-4


def corpus(n=900, seed=1):
    """Insults make a document toxic; a group is named in most toxic documents and in few others."""
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(60)]
    docs, labels = [], []
    for k in range(n):
        toxic = k % 3 == 0
        body = [rng.choice(words) for _ in range(rng.randint(3, 40))]
        if toxic and rng.random() < 0.8:
            body.insert(rng.randrange(len(body)), rng.choice(["idiot", "scum"]))
        if rng.random() < (0.7 if toxic else 0.05):
            body.insert(rng.randrange(len(body)), "immigrants")
        if not toxic and rng.random() < 0.3:
            body.insert(rng.randrange(len(body)), "residents")
        docs.append((k, " ".join(body)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_swaps_lower_scores_of_neutral_mentions(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, fair = (toxicity.learn(d, y, ridges=(0.1,), swap=s) for s in (0.0, 50.0))
    asked = pa.array(["immigrants opened a shop", "residents opened a shop", "you idiot", "idiot immigrants", "word1 word2", None, ""])
    a, b = plain.score(asked), fair.score(asked)
    assert a[0] - a[1] > 0.2 and abs(b[0] - b[1]) < 0.02 and b[0] < a[0] / 2, (a, b)
    assert min(b[2], b[3]) > 0.7 > max(b[4:]) and b[5] == b[6]
    assert np.allclose(fair.score(asked), toxicity.learn(d.repartition(7), y, ridges=(0.1,), swap=50.0).score(asked), atol=1e-6)


def test_classify_defined_cases(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame([*docs, (None, "idiot"), (1, "again")], "doc_id long, text string")
    y = spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    model = toxicity.learn(d, y)
    rows = [(k, t, "en", "s", None, "x", 1, 0.5, "y", "z", "w", None) for k, t in enumerate(texts())]
    rows += [rows[2], (None, "you idiot scum", *rows[0][2:])]
    got = toxicity.classify(spark.createDataFrame(rows, DDL), model)
    assert sorted(got.columns) == sorted([c.split()[0] for c in DDL.split(", ")] + ["predicted"])
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert next(r for r in out if r["doc_id"] is None)["predicted"] == 1
    assert toxicity.classify(spark.createDataFrame([], DDL), model).count() == 0
    one = toxicity.learn(d, y.filter("toxic = 0"))  # one label only: the smoothed share of label 1
    assert 0 < one.score(pa.array(["idiot"]))[0] < 0.05
    assert toxicity.learn(d.limit(0), y).features == []
    # a bound on the rows: still both labels
    few = toxicity.learn(d, y, max_rows=60)
    assert few.score(pa.array(["idiot idiot scum"]))[0] > few.score(pa.array(["word1"]))[0]


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    scored = toxicity.op12_toxicity(spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").toPandas()
    order = scored["score"].rank()
    one = scored["toxic"] == 1
    assert (order[one].mean() - order[~one].mean()) / len(scored) + 0.5 > 0.93
    assert scored["predicted"][~one].mean() < 0.01 and scored["predicted"][one].mean() > 0.6
