"""Source divergence against exact arithmetic over all groups and terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import source_divergence
from tessera.llm.common import terms_of, text_bytes
from tests.llm.test_operators import texts

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms(t):
    return TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    out, by_lang = [], defaultdict(list)
    for lang, source, text in rows:
        by_lang[lang].append((source, terms(text)))
    for lang, docs in by_lang.items():
        have = Counter(t for _, ts in docs for t in set(ts))
        kept = {t for t, n in have.items() if n >= 3}
        counts = defaultdict(Counter)
        for source, ts in docs:
            counts[source].update(t for t in ts if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for a in counts:
            for part, found in (
                ("pair", [(b, sum((p[a][t] - p[b][t]) ** 2 // p[b][t] for t in kept)) for b in counts if b != a]),
                ("term", [(t, (p[a][t] - q[t]) ** 2 // q[t]) for t in kept if counts[a][t] and p[a][t] > q[t]]),
            ):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, a, part, item, value, k) for k, (item, value) in enumerate(found, 1) if part == "pair" or k <= top]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2.5) for r in rows], "lang string, source string, text string, term string, rank int, value double")


def sample():
    rng = random.Random(3)
    rows = [(("en", "de", None)[k % 3], f"s{k % 7}" if k % 5 else None, t) for k, t in enumerate(texts())]
    rows += [("en", f"many{rng.randrange(40)}", " ".join(rng.choice("Alpha BETA gamma delta épée 漢字 x1y o'clock".split()) for _ in range(rng.randint(0, 30)))) for _ in range(300)]
    return [*rows, rows[0], rows[0], ("xx", "lonely", None), ("xx", "other", "once only"), ("yy", "single", "a a a"), ("yy", "single", "a"), ("yy", "single", "A b")]


def test_divergence_equals_brute_force(spark):
    rows = sample()
    want = sorted(brute(rows))
    got = source_divergence.source_divergence(frame(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert {r[1] for r in want if r[0] == "xx"} == {"lonely", "other"} and all(r[4] == 0 for r in want if r[0] == "xx")
    assert source_divergence.source_divergence(frame(spark, [])).count() == 0
    # other ranks, small blocks and chunks: more tiles, the same numbers
    tiled = source_divergence.source_divergence(frame(spark, rows), top=5, block_size=3, chunk_size=8)
    assert sorted(tuple(r) for r in tiled.collect()) == sorted(brute(rows, 5))


@pytest.mark.parametrize("count, total", [(0, 1), (7, 8), (10**10, 3 * 10**10), (2 * 10**14, 280_000_000_000_000), (0, 280_000_000_000_000)])
def test_shares_are_exact(spark, count, total):
    want = 1 + 10**9 * (count + 1) // total
    assert source_divergence.shares(np.array([count]), np.array([total])).tolist() == [want]
    assert spark.range(1).select(F.lit(count).cast("long").alias("c"), F.lit(total).cast("long").alias("t")).select(source_divergence.share("c", "t").alias("p")).first()["p"] == want


def test_terms_of_blocks():
    ts = [*texts(2), "ÄÖ\x7fÜ", "\x00a\x00", "ends", "Zed"]
    raw, offsets = text_bytes(pa.array(ts))
    got, start = terms_of(raw, offsets)
    doc = np.searchsorted(offsets, start, "right") - 1
    want = [(k, t) for k, text in enumerate(ts) for t in terms(text)]
    assert list(zip(doc.tolist(), got.to_pylist())) == want
