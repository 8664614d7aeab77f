"""Looking provisions up by citation, and checking what a citation says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.batches import bounded_batches
from tessera.functions.text import citation_key, heading_article_number, match_band
from tessera.operators.compare import dice
from tessera.operators.temporal import resolve


def locate(citations: DataFrame, provisions: DataFrame) -> DataFrame:
    """The provision that each citation (question_id, document_number, article) names, or why there is none.

    ``provisions`` has provision_id, document_number, heading. Numbers meet in one spelling. Reasons:
    DOCUMENT_NOT_IN_CORPUS, ARTICLE_NOT_IN_DOCUMENT, ARTICLE_AMBIGUOUS.
    """
    p = provisions.select("provision_id", citation_key(F.col("document_number")).alias("key"), heading_article_number(F.col("heading")).alias("no")).distinct()
    c = citations.withColumn("key", citation_key(F.col("document_number")))
    documents = p.select("key").distinct().withColumn("in_corpus", F.lit(True))
    found = c.select("question_id", "key", "article").join(p, "key").filter(F.col("no") == F.col("article"))
    found = found.groupBy("question_id").agg(F.count_distinct("provision_id").alias("n"), F.min("provision_id").alias("provision_id"))
    out = c.join(documents, "key", "left").join(found, "question_id", "left")
    reason = F.when(F.col("in_corpus").isNull(), "DOCUMENT_NOT_IN_CORPUS").when(F.col("n").isNull(), "ARTICLE_NOT_IN_DOCUMENT").when(F.col("n") > 1, "ARTICLE_AMBIGUOUS")
    out = out.withColumn("reason", reason).withColumn("provision_id", F.when(F.col("reason").isNull(), F.col("provision_id")))
    return out.drop("key", "in_corpus", "n")


def lookup(citations: DataFrame, versions: DataFrame) -> DataFrame:
    """``locate``, then the version in force at valid_at as known at known_at."""
    at = locate(citations, versions.select("provision_id", "document_number", "heading"))
    asked = at.filter("reason is null").select("question_id", "provision_id", "valid_at", "known_at")
    answer = resolve(asked, versions, "question_id").select("question_id", "status", "version_id", F.col("reason").alias("why"))
    out = at.drop("provision_id").join(answer, "question_id", "left").join(at.select("question_id", "provision_id"), "question_id")
    return out.withColumn("reason", F.coalesce("reason", "why")).drop("why")


def check(citations: DataFrame, versions: DataFrame) -> DataFrame:
    """Whether each citation exists, is in force and quotes its text: question_id, exists, in_force, similarity, band.

    An ambiguous article exists; a conflict of versions counts as not existing, one not in force as existing.
    ``quote`` may be null: then nothing is compared.
    """
    found = lookup(citations, versions)
    texts = versions.select("version_id", "text")
    out = bounded_batches(found.join(texts, "version_id", "left"))
    in_force = F.coalesce(F.col("status") == "resolved", F.lit(False))
    exists = in_force | (F.col("reason") == "ARTICLE_AMBIGUOUS") | F.coalesce(F.col("status") == "unknown", F.lit(False))
    similarity = dice(F.col("quote"), F.col("text"), in_force & F.col("quote").isNotNull())
    out = out.withColumn("similarity", similarity)
    return out.select("question_id", F.coalesce(exists, F.lit(False)).alias("exists"), in_force.alias("in_force"), "version_id", "similarity", match_band(F.col("similarity")).alias("band"), "reason")
