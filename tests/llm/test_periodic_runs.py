"""Periodic runs against a search over all starts and periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import periodic_runs
from tests.llm.test_operators import frame, texts, words_of


def brute(w):
    """All runs (start, length, period): for every period every longest stretch, kept at its smallest period."""
    best = {}
    for p in range(len(w) // 4, 0, -1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                best[i, j - i + p] = p
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in best.items())


def collapse(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def random_texts():
    rng = random.Random(5)
    out = []
    for k in range(400):
        letters = "abc"[: 1 + k % 3]
        out.append(" ".join(rng.choice(letters) for _ in range(rng.randint(0, 60))))
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        inner = (unit * 9)[: rng.randint(1, 9 * len(unit))]
        out.append(" ".join([*"xyz"[: k % 4], *inner, *inner[: k % 7], "q", *(unit * 5)]))
    return out


def test_runs_equal_brute_force(spark):
    rows = [(k, t, "s") for k, t in enumerate([*texts(), *random_texts(), " ".join(["so"] * 30_000), " ".join("ab ab ab".split() * 5_000)])]
    rows += [rows[3], (None, "a b a b a b a b", "s"), (None, None, "s")]
    got = periodic_runs.periodic_runs(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["n_words"]) for r in got if r["doc_id"] is not None) == sorted((i, len(words_of(t))) for i, t, _ in rows if i is not None)
    by_id = {i: words_of(t) for i, t, _ in rows if i is not None}
    for r in got:
        if r["doc_id"] is None:
            continue
        w = by_id[r["doc_id"]]
        want = [(0, len(w), 1)] if len(w) > 10_000 and len(set(w)) == 1 else [] if len(set(w)) > 10_000 else brute(w)
        assert [tuple(x) for x in r["runs"]] == want, w
        assert r["kept_text"] == collapse(w, want)
        best = max(want, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (tuple(r["strongest"]) if r["strongest"] else None) == best
    assert periodic_runs.periodic_runs(frame(spark, [])).count() == 0
    named = spark.createDataFrame([("x", "a a a a a a", 1)], "doc_id string, body string, runs int")
    assert [tuple(x) for x in periodic_runs.periodic_runs(named, text_col="body").first()["runs"]] == [(0, 6, 1)]


def test_runs_of_neighbours_do_not_meet():
    """Runs that stand at the end of one document and at the start of the next stay apart."""
    w = [1, 2] * 4 + [1, 2] * 4
    got = periodic_runs.find_runs(np.array(w, np.uint64), np.array([0, 8, 8, 16]))
    assert got.tolist() == [[0, 0, 8, 2], [2, 0, 8, 2]]


def test_planted_repeats(spark):
    rows = [(k, " ".join(f"w{(7 * k + j * j) % 50}" for j in range(k % 90)), "s") for k in range(600)] + [(9_000_000_000, None, "s")]
    got = {r["doc_id"]: r["t"] for r in frame(spark, rows).select("doc_id", periodic_runs.planted(F.col("text"), F.col("doc_id")).alias("t")).collect()}
    for i, t, _ in rows:
        w, h = words_of(t), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            assert got[i] == " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(len(w)))
        else:
            assert got[i] == t
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256).alias("s")).first()["s"]
