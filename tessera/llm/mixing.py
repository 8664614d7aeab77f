"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, materialize, stable_hash

#: Documents that are sorted at the budget's edge at most, unless their keys are all alike, and buckets of keys
#: into which a source is cut to find that edge.
EDGE_DOCS, BUCKETS = 2_000, 64


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Weight in (0, 1] from statistics of the whole text; 1 where it has no words.

    Three factors, each 1 for usual prose and less the further a text is from it: mean word length of 3 to 9
    characters, at most 0.4 characters in one that are neither letter nor space, and at least size ** 0.7 different words.
    """
    n = F.greatest(size, F.lit(1))
    mean = F.length(text) / n
    off = F.greatest(F.lit(4.0) - mean, mean - F.lit(10.0), F.lit(0.0))
    other = F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    letters = 1 - other / F.length(text)
    words = F.size(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+")))
    weight = F.least(F.lit(1.0), letters / 0.6) * F.least(F.lit(1.0), words / F.pow(n.cast("double"), 0.7)) / (1.0 + off * off / 4.0)
    return F.when(size > 0, F.greatest(weight, F.lit(1e-6))).otherwise(F.lit(1.0))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add ``target`` to (source, source_size): words that the mix wants from each source.

    Sources in code-point order, null last, weigh ``weights``, repeating. They share ``total`` times all sizes;
    no target exceeds ``cap`` times its source's size, and the excess is shared again by weight until none does.
    That fixed point is target = min(limit, level * weight): ordered by limit / weight, capped sources form a
    prefix, so prefix sums give the level in one pass. One row per source: a small table by nature.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    k = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("w", F.get(k, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    everyone = Window.partitionBy()
    s = s.withColumn("pool", F.sum("source_size").over(everyone) * F.lit(float(total))).withColumn("all_w", F.sum("w").over(everyone))
    fullness = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    before_limit, before_w = F.coalesce(F.sum("limit").over(fullness), F.lit(0.0)), F.coalesce(F.sum("w").over(fullness), F.lit(0.0))
    s = s.withColumn("level_here", (F.col("pool") - before_limit) / (F.col("all_w") - before_w))
    # level_here grows while sources are capped and falls after that: its maximum is the level at the fixed point
    s = s.withColumn("level", F.max("level_here").over(everyone))
    return s.select("source", "source_size", F.least(F.col("limit"), F.col("level") * F.col("w")).alias("target"))


def _edges(base: DataFrame, goal: DataFrame, edge_docs: int) -> DataFrame:
    """(s, low, high, before): for each source the range (low, high] of keys that holds the end of its budget, and the
    words of all keys up to ``low``. A row per source.

    Ranges are cut at approximate quantiles of the keys in them; where these lie is free, totals are exact.
    """
    budget = goal.select(F.col("source").alias("s"), "budget")
    edges = materialize(budget.select("s", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).cast("long").alias("before"), F.lit(1 << 62).alias("docs")), "mix-edges")
    cuts = F.percentile_approx("key", [k / BUCKETS for k in range(1, BUCKETS)], 10_000)
    while True:
        inside = base.join(F.broadcast(edges), F.col("source").eqNullSafe(F.col("s")) & (F.col("key") > F.col("low")) & (F.col("key") <= F.col("high")))
        bounds = inside.groupBy("s", "low", "high", "before", "docs").agg(F.array_distinct(cuts).alias("cuts"), F.count("*").alias("now"))
        # cut only what is still too large and was made smaller by the last cut
        bounds = materialize(bounds.filter((F.col("now") > edge_docs) & (F.col("now") < F.col("docs"))), "mix-cuts")
        if bounds.isEmpty():
            return edges.drop("docs")
        cut = base.join(F.broadcast(bounds), F.col("source").eqNullSafe(F.col("s")) & (F.col("key") > F.col("low")) & (F.col("key") <= F.col("high")))
        cut = cut.withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("key"))))
        totals = cut.groupBy("s", "bucket").agg(F.sum("size").alias("words"), F.first("cuts").alias("cuts"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("before").alias("before"), F.first("now").alias("now"))
        upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # BUCKETS rows
        totals = totals.withColumn("through", F.col("before") + F.sum("words").over(upto)).alias("t").join(budget.alias("b"), F.col("t.s").eqNullSafe(F.col("b.s"))).select("t.*", "b.budget")
        # the first range that reaches the budget; all keys are below it if none does
        at = F.when(F.col("through") >= F.col("budget"), F.col("bucket"))
        low, high = F.get("cuts", F.col("bucket") - 1), F.get("cuts", F.col("bucket"))
        found = totals.groupBy("s").agg(
            F.min_by(F.struct(F.when(F.col("bucket") > 0, low).otherwise(F.col("low")).alias("low"), F.coalesce(high, "high").alias("high"), (F.col("through") - F.col("words")).alias("before"), F.col("now").alias("docs")), at).alias("to"),
            F.struct(F.max("high").alias("low"), F.max("high").alias("high"), F.max("through").alias("before"), F.max("now").alias("docs")).alias("past"),
        )
        found = found.select(F.col("s").alias("f"), F.coalesce("to", "past").alias("to"))
        edges = edges.join(found, F.col("s").eqNullSafe(F.col("f")), "left").select("s", *(F.coalesce(F.col(f"to.{c}"), F.col(c)).alias(c) for c in ("low", "high", "before", "docs")))
        edges = materialize(edges, "mix-edges")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, cap: float = 2.0, seed: int = 17, weight: Column | None = None, edge_docs: int = EDGE_DOCS) -> DataFrame:
    """How often the mix takes each document, one row per row of ``docs``.

    A source's target is ``epochs`` complete passes over it plus a remainder. Complete passes take every
    document; the remainder goes to documents in order of their Efraimidis-Spirakis keys -ln(u) / quality
    weight, u a uniform hash of id, text and seed, until a prefix sum of sizes meets it (a document is taken
    if the midpoint of its words lies within the budget, so the error is at most half a document).

    A source may hold most rows, so its keys are never sorted as a whole: it is cut into BUCKETS ranges at
    quantiles of its own keys, range totals are prefix-summed, ranges below the budget are taken, those above are
    left, and the one at the edge is cut again until it has at most ``edge_docs`` documents, which are sorted.

    ``weight`` is the documents' quality weight, over 0; by default ``quality_weight`` of the text.

    Defined cases: null text has size 0 and is taken as often as its source has complete epochs; a null source
    is a source of its own, after the others; ties of keys go by id, size and row; repeated rows count as
    separate documents; an empty table gives no rows; other columns are not read.

    Returns row_id, doc_id, text_hash, source, size, source_size, target, copies, taken.
    """
    weight = F.lit(None).cast("double") if weight is None else weight
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), word_count(F.col(text_col)).alias("size"), weight.alias("weight"))
    base = base.withColumn("weight", F.coalesce("weight", quality_weight(F.col("text"), F.col("size"))))
    u = stable_hash(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string")))
    base = base.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.xxhash64("text").alias("text_hash"), "source", "size", (-F.log(u) / F.col("weight")).alias("key"))
    base = materialize(base, "mix-sizes")

    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = materialize(sources, "mix-sources")
    targets = source_targets(sources.select("source", "source_size"), weights, total, cap)
    goal = targets.alias("t").join(sources.alias("n"), F.col("t.source").eqNullSafe(F.col("n.source"))).select("t.*", "n.n_docs")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = materialize(goal, "mix-goal")  # a row per source

    edges = _edges(base, goal, edge_docs)
    d = base.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.*", "g.source_size", "g.target", "g.epochs", "g.budget")
    d = d.join(edges, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    on_edge = (F.col("key") > F.col("low")) & (F.col("key") <= F.col("high"))
    inside = d.filter(on_edge)
    running = Window.partitionBy("source").orderBy("key", F.col("doc_id").isNull(), "doc_id", "size", "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("mid", F.col("before") + F.sum("size").over(running) - F.col("size") / 2).withColumn("extra", (F.col("mid") <= F.col("budget")).cast("long"))
    outside = d.filter(~on_edge).withColumn("extra", (F.col("key") <= F.col("low")).cast("long"))
    keep = ["row_id", "doc_id", "text_hash", "source", "size", "source_size", "target", "epochs", "extra"]
    out = outside.select(*keep).unionByName(inside.select(*keep))
    out = out.withColumn("copies", F.col("epochs") + F.when(F.col("size") > 0, F.col("extra")).otherwise(F.lit(0)))
    return out.select("row_id", "doc_id", "text_hash", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every row as often as ``mix`` takes it, all columns kept.

    Rows are found again by id and text; rows that repeat both are numbered on either side, so each is taken as
    often as one of them is.
    """
    often = mix.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("copies").alias("__copies"), F.expr("row_number() over (partition by doc_id, text_hash order by row_id)").alias("__n"))
    rows = docs.withColumn("__text", F.xxhash64(docs[text_col]))
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy(F.col(id_col), "__text").orderBy(F.monotonically_increasing_id())))
    same = rows[id_col].eqNullSafe(often["__id"]) & (rows["__text"] == often["__hash"]) & (rows["__k"] == often["__n"])
    out = rows.join(often.filter("__copies > 0"), same)
    out = out.withColumn("__take", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return out.drop("__id", "__hash", "__copies", "__n", "__k", "__text", "__take")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
