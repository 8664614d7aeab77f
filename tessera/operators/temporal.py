"""Bitemporal resolution: which version held at a date, as known at an instant."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.window import Window

from tessera.functions.checks import contains, servable


#: Where a key has more versions than the first number, questions are answered in one sorted pass and not by a join on
#: the key; a key with more than the second is cut into time tiles, at TILES - 1 quantiles of its versions' starts.
CROWDED_VERSIONS, HOT_VERSIONS, TILES = 1_000, 1_000_000, 64


def _tiles(versions: DataFrame, keys: tuple[str, ...], hot_versions: int):
    """How to cut time for each key, as two functions: versions go to all tiles that they reach into (``own`` is true in
    that of their start), points to theirs.

    Only keys with more than ``hot_versions`` versions are cut; looking for them is one aggregation by key. Where
    there is none, all is one tile and nothing is joined. Starts must be dates, timestamps or numbers to be cut.
    """

    def whole(df: DataFrame, *_) -> DataFrame:
        return df.withColumn("tile", F.lit(0)).withColumn("own", F.lit(True))

    hot = versions.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > hot_versions).select(*keys)
    if versions.schema["valid_from"].dataType.typeName() == "string" or hot.isEmpty():
        return whole, whole
    cuts = F.percentile_approx("valid_from", [k / TILES for k in range(1, TILES)], 1000)
    bounds = versions.join(hot, list(keys), "left_semi").groupBy(*keys).agg(F.array_distinct(cuts).alias("bounds"))

    def tile(at):
        return F.when(F.col("bounds").isNull(), F.lit(0)).otherwise(F.size(F.filter("bounds", lambda b: b <= at)))

    def spread(df: DataFrame) -> DataFrame:
        last = F.when(F.col("valid_to").isNull(), F.coalesce(F.size("bounds"), F.lit(0))).otherwise(tile(F.col("valid_to")))
        first = tile(F.col("valid_from"))
        every = F.posexplode(F.sequence(first, F.greatest(first, last))).alias("nth", "tile")
        return df.join(bounds, list(keys), "left").select(*df.columns, every).withColumn("own", F.col("nth") == 0).drop("nth")

    def place(df: DataFrame, at: str) -> DataFrame:
        return df.join(bounds, list(keys), "left").withColumn("tile", tile(F.col(at))).drop("bounds")

    return spread, place


def _comparable(column: pa.Array) -> list:
    """Values in an order of their own: days and microseconds as numbers, texts as they are, nulls above all others."""
    if pa.types.is_date32(column.type):
        column = column.cast(pa.int32())
    if not pa.types.is_string(column.type):
        column = column.cast(pa.int64() if not pa.types.is_floating(column.type) else pa.float64())
    top = "\U0010ffff" if pa.types.is_string(column.type) else float("inf")
    return [top if x is None else x for x in column.to_pylist()]


def _new_groups(batch: pa.RecordBatch, keys: list[str], before: list | None) -> tuple[list[bool], list]:
    """Where a row has other keys than the one before it, the last row of the batch before included; its keys. Null
    is like nothing, not even null."""
    now = [batch.column(k) for k in keys]
    n = batch.num_rows
    first = before is None or any(x is None or x != c[0].as_py() for x, c in zip(before, now))
    other = [pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_pylist() for c in now]
    return [first, *(any(x) for x in zip(*other))], [c[n - 1].as_py() for c in now]


def _sweep_questions(keys: list[str], answer: list[str], id_type: pa.DataType):
    """Over starts of versions and questions, sorted by keys and time: the answer to each question.

    Versions that are still open are carried along; those that have ended go when the next question comes, as
    later questions ask for later times. So a question looks at the versions that hold at its time and no others.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, active = None, []
        for batch in it:
            if not batch.num_rows:
                continue
            group, before = _new_groups(batch, keys, before)
            at, end, known, known_end = (_comparable(batch.column(c)) for c in ("at", "valid_to", "known", "known_to"))
            asks, none = batch.column("asks").to_pylist(), [a or b for a, b in zip(batch.column("at").is_null().to_pylist(), batch.column("known").is_null().to_pylist())]
            good, ids = batch.column("good").to_pylist(), batch.column("version_id").to_pylist()
            status, version, reason, candidates = [], [], [], []
            for k in range(batch.num_rows):
                if group[k]:
                    active = []
                if not asks[k]:
                    active.append((end[k], known[k], known_end[k], good[k], ids[k]))
                    continue
                hits = []
                if not none[k]:
                    active = [v for v in active if v[0] > at[k]]
                    hits = sorted({(v[4], v[3]) for v in active if v[1] <= known[k] < v[2]})
                served = [i for i, good_one in hits if good_one]
                status.append("resolved" if len(served) == 1 else "conflict" if served else "unknown")
                version.append(served[0] if len(served) == 1 else None)
                reason.append(None if served else "MATCH_ONLY_UNVERIFIED" if hits else "NO_MATCHING_VERSION")
                candidates.append(served or [i for i, _ in hits])
            asked = batch.filter(batch.column("asks"))
            out = [pa.array(status, pa.string()), pa.array(version, id_type), pa.array(reason, pa.string()), pa.array(candidates, pa.list_(id_type))]
            yield pa.RecordBatch.from_arrays([*(asked.column(c) for c in answer), *out], names=[*answer, "status", "version_id", "reason", "candidates"])

    return run


def resolve(questions: DataFrame, versions: DataFrame, question_id: str = "question_id", keys: tuple[str, ...] = ("provision_id",), crowded_versions: int = CROWDED_VERSIONS, hot_versions: int = HOT_VERSIONS) -> DataFrame:
    """Answer each question (keys, valid_at, known_at): resolved, conflict or unknown, never a guess.

    ``versions`` has the keys, version_id, valid_from, valid_to, known_from, known_to and, optionally, status and
    n_evidence. A version matches if both its intervals contain the question's points; it counts if it may be
    served and has evidence. One that counts: resolved. Several: conflict, with their ids. None: unknown,
    with the ids of those that match but do not count. A null key, date or instant matches nothing; repeated
    questions are one, and so are repeated versions.

    Where no key has more than ``crowded_versions`` versions, they meet their questions in an equi-join on the keys with
    the intervals as residual. Else versions and questions are dealt by key together, once, sorted by time and read in one
    pass that carries the versions still open; nothing is joined, so a key of many versions costs its rows and its
    answers. Keys with more than ``hot_versions`` versions are cut into tiles of time first.
    """
    counts = F.coalesce(F.col("n_evidence") > 0, F.lit(False)) if "n_evidence" in versions.columns else F.lit(True)
    if "status" in versions.columns:
        counts = counts & servable(F.col("status"))
    v = versions.filter("valid_from is not null and known_from is not null").select(*keys, "version_id", "valid_from", "valid_to", "known_from", "known_to", counts.alias("good"))
    answer = list(dict.fromkeys((question_id, *keys, "valid_at", "known_at")))
    crowded = v.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > crowded_versions)
    if not crowded.isEmpty():
        return _resolve_by_sweep(questions.select(*answer).distinct(), v, answer, keys, hot_versions)
    on = contains(F.col("valid_from"), F.col("valid_to"), F.col("valid_at")) & contains(F.col("known_from"), F.col("known_to"), F.col("known_at"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"v_{k}"))
    hit = questions.select(*answer).join(v.withColumnsRenamed({k: f"v_{k}" for k in keys}), on, "left")
    out = hit.groupBy(*answer).agg(F.sort_array(F.collect_set(F.when(F.col("version_id").isNotNull(), F.struct("version_id", "good")))).alias("hits"))
    good = F.transform(F.filter("hits", lambda h: h["good"]), lambda h: h["version_id"])
    out = out.select(*answer, good.alias("served"), F.transform("hits", lambda h: h["version_id"]).alias("all"))
    n = F.size("served")
    status = F.when(n == 1, "resolved").when(n > 1, "conflict").otherwise("unknown")
    reason = F.when(n > 0, None).when(F.size("all") > 0, "MATCH_ONLY_UNVERIFIED").otherwise("NO_MATCHING_VERSION")
    return out.select(*answer, status.alias("status"), F.when(n == 1, F.col("served")[0]).alias("version_id"), reason.alias("reason"), F.when(n > 0, F.col("served")).otherwise(F.col("all")).alias("candidates"))


def _resolve_by_sweep(questions: DataFrame, v: DataFrame, answer: list[str], keys: tuple[str, ...], hot_versions: int) -> DataFrame:
    spread, place = _tiles(v, keys, hot_versions)
    extra = [c for c in answer if c not in keys]
    none = [F.lit(None).cast(questions.schema[c].dataType).alias(c) for c in extra]
    starts = spread(v).select(*keys, "tile", F.col("valid_from").alias("at"), F.lit(False).alias("asks"), "valid_to", F.col("known_from").alias("known"), "known_to", "good", "version_id", *none)
    blank = {c: F.lit(None).cast(v.schema[c].dataType).alias(c) for c in ("valid_to", "known_to", "good", "version_id")}
    asked = place(questions, "valid_at")
    asked = asked.select(*keys, "tile", F.col("valid_at").alias("at"), F.lit(True).alias("asks"), blank["valid_to"], F.col("known_at").alias("known"), blank["known_to"], blank["good"], blank["version_id"], *extra)
    rows = starts.union(asked).repartition(*keys, "tile").sortWithinPartitions(*keys, "tile", "at", "asks")
    id_type = v.schema["version_id"].dataType
    ddl = StructType([rows.schema[c] for c in answer]).add("status", "string").add("version_id", id_type).add("reason", "string").add("candidates", ArrayType(id_type))
    return rows.mapInArrow(_sweep_questions([*keys, "tile"], answer, to_arrow_type(id_type)), ddl)


def snapshot(versions: DataFrame, valid_at, known_at=None) -> DataFrame:
    """The versions in force at one date (as known at an instant): a plain filter that reaches the scan."""
    out = versions.filter(contains(F.col("valid_from"), F.col("valid_to"), F.lit(valid_at)))
    return out if known_at is None else out.filter(contains(F.col("known_from"), F.col("known_to"), F.lit(known_at)))


def _sweep_overlaps(keys: list[str], id_type: pa.DataType):
    """Over versions sorted by keys and start: pairs that overlap on both axes, each once, at the later start.

    What is carried are the versions still open, as arrays; the other axis is compared with all of them at once.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, active = None, []
        for batch in it:
            if not batch.num_rows:
                continue
            group, before = _new_groups(batch, [*keys, "tile"], before)
            at, end, known, known_end = (_comparable(batch.column(c)) for c in ("valid_from", "valid_to", "known_from", "known_to"))
            ids, own = batch.column("version_id").to_pylist(), batch.column("own").to_pylist()
            row, first, second = [], [], []
            for k in range(batch.num_rows):
                active = [] if group[k] else [v for v in active if v[0] > at[k]]
                if own[k]:
                    for _, start, low, high, other in active:
                        # an interval that ends before it starts may not reach the other's start
                        if start < end[k] and low < known_end[k] and known[k] < high and other != ids[k]:
                            row.append(k)
                            first.append(min(other, ids[k]))
                            second.append(max(other, ids[k]))
                active.append((end[k], at[k], known[k], known_end[k], ids[k]))
            taken = batch.take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in keys), pa.array(first, id_type), pa.array(second, id_type)], names=[*keys, "first_id", "second_id"])

    return run


def collisions(versions: DataFrame, keys: tuple[str, ...] = ("provision_id",), hot_versions: int = HOT_VERSIONS) -> DataFrame:
    """Pairs of versions of one provision that overlap on both axes: (keys, first_id, second_id), ids in order.

    Versions are dealt by key once and sorted by start. One that starts when all before it have ended, and ends
    before the next one starts, meets no other: a running maximum of ends and the next start show that in a
    window, so in orderly data next to nothing is left. The rest is swept in the same order. Nothing is joined.
    Versions without a start or key are left out. Keys with more than ``hot_versions`` versions are cut into tiles of time.
    """
    v = versions.filter("valid_from is not null and known_from is not null").select(*keys, "version_id", "valid_from", "valid_to", "known_from", "known_to")
    for k in keys:
        v = v.filter(F.col(k).isNotNull())
    spread, _ = _tiles(v, keys, hot_versions)
    in_tile = Window.partitionBy(*keys, "tile").orderBy("valid_from", "version_id")
    so_far = in_tile.rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.coalesce(F.max(F.col("valid_to").isNull()).over(so_far), F.lit(False))
    late = open_before | (F.col("valid_from") < F.max("valid_to").over(so_far))
    early = F.lead("valid_from").over(in_tile).isNotNull() & (F.col("valid_to").isNull() | (F.lead("valid_from").over(in_tile) < F.col("valid_to")))
    met = spread(v).withColumn("meets", F.coalesce(late, F.lit(False)) | F.coalesce(early, F.lit(False))).filter("meets")
    met = met.select(*keys, "tile", "version_id", "valid_from", "valid_to", "known_from", "known_to", "own").sortWithinPartitions(*keys, "tile", "valid_from", "version_id")
    id_type = v.schema["version_id"].dataType
    ddl = StructType([v.schema[k] for k in keys]).add("first_id", id_type).add("second_id", id_type)
    return met.mapInArrow(_sweep_overlaps(list(keys), to_arrow_type(id_type)), ddl)


def versions_by_succession(facts: DataFrame, keys: list[str], id_col: str, at_col: str) -> DataFrame:
    """Versions of a fact table: each row holds from its time to that of the next row of its key."""
    w = Window.partitionBy(*keys).orderBy(at_col, id_col)
    return facts.withColumn("valid_from", F.col(at_col)).withColumn("valid_to", F.lead(at_col).over(w)).withColumn("version_id", F.col(id_col))


def catalog(versions: DataFrame) -> DataFrame:
    """Documents with their provisions and the provisions' versions by start, nested; no filter on status or time.

    A provision's heading is that of its first version, by load order ``ord``, that has one.
    """
    version = F.struct("valid_from", "ord", "version_id", "valid_to", "status")
    per = versions.groupBy("document_id", "provision_id").agg(
        F.min("ord").alias("ord"),
        F.min_by("heading", F.when(F.col("heading").isNotNull(), F.col("ord"))).alias("heading"),
        F.sort_array(F.collect_list(version)).alias("versions"),
    )
    nested = F.struct("ord", "provision_id", "heading", "versions")
    return per.groupBy("document_id").agg(F.sort_array(F.collect_list(nested)).alias("provisions"))


def gaps(numbers: DataFrame, keys: list[str], number: str, order: str | None = None) -> DataFrame:
    """Breaks of a numbering that should go 1, 2, 3 ...: (keys, expected, found)."""
    w = Window.partitionBy(*keys).orderBy(order or number)
    out = numbers.withColumn("expected", F.coalesce(F.lag(number).over(w) + 1, F.lit(1)))
    return out.filter(F.col(number) != F.col("expected")).select(*keys, "expected", F.col(number).alias("found"))
