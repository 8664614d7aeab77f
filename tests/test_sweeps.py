"""As-of answers and overlapping versions against nested loops, over several types of time, with and without tiles."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import temporal

DAY = dt.date(2020, 1, 1)
KINDS = {
    "date": ("date", lambda k: DAY + dt.timedelta(k)),
    "timestamp_ntz": ("timestamp_ntz", lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(hours=7 * k)),
    "text": ("string", lambda k: (DAY + dt.timedelta(k)).isoformat()),
    "number": ("long", lambda k: k),
}
STATUS = ("verified", "machine_checked", "under_review", None)


def versions_of(rng, n, spell):
    out = []
    for i in range(n):
        start, known = rng.randint(0, 60), rng.randint(0, 40)
        end = None if rng.random() < 0.15 else start + rng.randint(-2, 12)
        gone = None if rng.random() < 0.5 else known + rng.randint(0, 20)
        at = lambda x: None if x is None else spell(x)
        out.append((rng.choice(["a", "b", "c", None]), rng.randint(1, 2), f"v{i}", at(None if rng.random() < 0.03 else start), at(end), at(known), at(gone), rng.choice(STATUS), rng.choice([0, 1, 2, None])))
    return out


def holds(v, valid_at, known_at):
    if None in (v[0], v[3], v[5], valid_at, known_at):
        return False
    return v[3] <= valid_at and (v[4] is None or valid_at < v[4]) and v[5] <= known_at and (v[6] is None or known_at < v[6])


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("crowded, hot", [(10**6, 10**6), (5, 10**6), (5, 5)])
def test_answers_equal_nested_loops(spark, kind, crowded, hot):
    ddl, spell = KINDS[kind]
    rng = random.Random(kind)
    versions = versions_of(rng, 300, spell)
    questions = [(k, rng.choice(["a", "b", "c", "d", None]), rng.randint(1, 2), None if k % 29 == 5 else spell(rng.randint(-5, 80)), None if k % 31 == 7 else spell(rng.randint(-5, 70))) for k in range(200)]
    v = spark.createDataFrame(versions, f"p string, r int, version_id string, valid_from {ddl}, valid_to {ddl}, known_from {ddl}, known_to {ddl}, status string, n_evidence int")
    q = spark.createDataFrame(questions, f"question_id long, p string, r int, valid_at {ddl}, known_at {ddl}").withColumn("at", F.lit("x"))
    got = temporal.resolve(q, v, keys=("p", "r"), crowded_versions=crowded, hot_versions=hot)
    assert got.columns == ["question_id", "p", "r", "valid_at", "known_at", "status", "version_id", "reason", "candidates"]
    want = []
    for i, p, r, valid, known in questions:
        hits = [x for x in versions if x[:2] == (p, r) and holds(x, valid, known)]
        good = sorted(x[2] for x in hits if x[7] in STATUS[:2] and (x[8] or 0) > 0)
        status = "resolved" if len(good) == 1 else "conflict" if good else "unknown"
        reason = None if good else "MATCH_ONLY_UNVERIFIED" if hits else "NO_MATCHING_VERSION"
        want.append((i, p, r, valid, known, status, good[0] if len(good) == 1 else None, reason, good or sorted(x[2] for x in hits)))
    assert sorted((tuple(x) for x in got.collect()), key=lambda x: x[0]) == want
    assert {x[5] for x in want} == {"resolved", "conflict", "unknown"}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("hot", [10**6, 5])
def test_overlaps_equal_nested_loops(spark, kind, hot):
    ddl, spell = KINDS[kind]
    versions = versions_of(random.Random(kind + "!"), 250, spell)
    v = spark.createDataFrame(versions, f"p string, r int, version_id string, valid_from {ddl}, valid_to {ddl}, known_from {ddl}, known_to {ddl}, status string, n int")
    want = set()
    meet = lambda a, b, c, d: (d is None or a < d) and (b is None or c < b)
    for x in versions:
        for y in versions:
            if x[2] < y[2] and x[:2] == y[:2] and None not in (x[0], x[3], y[3]) and meet(x[3], x[4], y[3], y[4]) and meet(x[5], x[6], y[5], y[6]):
                want.add((x[0], x[1], x[2], y[2]))
    got = [tuple(r) for r in temporal.collisions(v, ("p", "r"), hot_versions=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_one_key_of_many_versions_costs_its_rows(spark):
    """Successive versions of one key: nothing is joined, and no version is compared with another."""
    n = 60_000
    v = spark.range(n).select(F.lit("only").alias("provision_id"), F.col("id").alias("version_id"), F.col("id").alias("valid_from"), (F.col("id") + 1).alias("valid_to"), F.lit(0).cast("long").alias("known_from"), F.lit(None).cast("long").alias("known_to"))
    q = spark.range(n).select(F.col("id").alias("question_id"), F.lit("only").alias("provision_id"), F.col("id").alias("valid_at"), F.lit(1).cast("long").alias("known_at"))
    out = temporal.resolve(q, v)
    assert "Join" not in out._jdf.queryExecution().toString()
    assert out.filter("status = 'resolved' and version_id = question_id").count() == n
    met = temporal.collisions(v)
    assert "Join" not in met._jdf.queryExecution().toString() and met.count() == 0
