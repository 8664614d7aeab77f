"""Amendment edges: tracing them and linking them to provisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import own_article_number, referenced_article_number
from tessera.operators.sets import pick_one


def trace(questions: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """Edges that touch each question's provision, as source or target; with depth 2 also those that touch the
    source of such an edge. One row per (question_id, edge_id), with the depth at which it was met first.

    ``edges`` has edge_id, source_id, target_id; an id names one edge and each has a source; rows that repeat one
    whole count once. With depth 2 an edge that touches the provision touches its own source, too, so all answers come from the sources met:
    an edge is answered through its own source where that was met and else through its target, which makes each answer
    once, at its right depth, and no answer is shuffled again to be told from its copies.
    """
    asked = questions.select("question_id", F.col("provision_id").alias("end_id")).distinct()
    edges = edges.select("edge_id", "source_id", "target_id").repartition("source_id").distinct()
    if depth == 1:
        ends = edges.select("edge_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("end_id"))
        return asked.join(ends, "end_id").select("question_id", "edge_id").distinct().withColumn("depth", F.lit(1))
    # sources of touching edges, with the provisions that led there (one, unless a question names several)
    touching = edges.select("source_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("end_id")).distinct()
    met = asked.join(touching, "end_id").groupBy("question_id", "source_id").agg(F.collect_set("end_id").alias("provisions"))
    near = F.array_contains("provisions", F.col("source_id")) | F.coalesce(F.array_contains("provisions", F.col("target_id")), F.lit(False))
    through_source = met.join(edges, "source_id").select("question_id", "edge_id", F.when(near, 1).otherwise(2).alias("depth"))
    # an edge between two sources that were met has been answered; both of its ends may be met, so pairs count once
    at_target = met.select("question_id", F.col("source_id").alias("target_id")).join(edges.filter("source_id <> target_id"), "target_id")
    through_target = at_target.join(met.select("question_id", "source_id"), ["question_id", "source_id"], "left_anti").select("question_id", "edge_id", F.lit(2).alias("depth"))
    return through_source.union(through_target)


def link_amendments(amending: DataFrame, targets: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges from amending provisions to the articles that their headings name, or why there is none.

    ``amending`` and ``targets`` have document_id, provision_id, heading, ord; ``relations`` has document_id,
    target_document_id, relation, effective_from. Of several provisions with one article number the first is
    the target. Status: linked, duplicate (an edge with the same id came before), NO_ARTICLE, NOT_FOUND.
    """
    first = pick_one(targets.withColumn("no", own_article_number(F.col("heading"))).filter("no is not null"), ["document_id", "no"], [F.asc("ord")])
    first = first.select(F.col("document_id").alias("target_document_id"), "no", F.col("provision_id").alias("target_id"))
    wanted = amending.withColumn("no", referenced_article_number(F.col("heading"))).join(relations, "document_id")
    out = wanted.join(first, ["target_document_id", "no"], "left")
    tail = lambda c: F.substring_index(F.col(c), "_", -1)
    out = out.withColumn("edge_id", F.when(F.col("target_id").isNotNull(), F.concat(F.lit("amd_"), tail("provision_id"), F.lit("_"), tail("target_id"))))
    rank = F.expr("row_number() over (partition by edge_id order by ord, provision_id)")
    status = F.when(F.col("no").isNull(), "NO_ARTICLE").when(F.col("target_id").isNull(), "NOT_FOUND").when(rank > 1, "duplicate").otherwise("linked")
    return out.withColumn("status", status).select("provision_id", F.col("no").alias("article"), "target_id", "relation", "effective_from", "edge_id", "status")
