"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.temporal import versions_by_succession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or, where that is unset and all
    runs in one process, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new shared folder and read back, for results that are used more than once."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


STATUS = "element_at(array('verified', 'machine_checked', 'under_review', 'unverified'), cast(event_id % 4 as int) + 1)"


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of (user, type), known up to four days late; every 50th holds a day too long."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    v = versions_by_succession(e, ["user_id", "event_type"], "event_id", "ts")
    late = F.expr("valid_to + make_dt_interval(1)")
    return v.select(
        "user_id", "event_type", "version_id", "valid_from", F.when(F.col("event_id") % 50 == 0, late).otherwise(F.col("valid_to")).alias("valid_to"),
        F.expr("valid_from + make_dt_interval(cast(event_id % 5 as int))").alias("known_from"), F.lit(None).cast("timestamp_ntz").alias("known_to"), F.expr(STATUS).alias("status"), F.col("event_id").alias("ord"),
    )


VERSIONS_SQL = """
ver AS (
  SELECT user_id, event_type, event_id AS version_id, ts AS valid_from,
    CASE WHEN event_id % 50 = 0 THEN nxt + INTERVAL 1 DAY ELSE nxt END AS valid_to,
    ts + (event_id % 5) * INTERVAL 1 DAY AS known_from,
    ['verified', 'machine_checked', 'under_review', 'unverified'][event_id % 4 + 1] AS status
  FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nxt FROM events)
)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per event: what held for its user and type half a day later, as known two days after that."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("question_id"), "user_id", "event_type", F.expr("ts + make_dt_interval(0, 12)").alias("valid_at"), F.expr("ts + make_dt_interval(2, 12)").alias("known_at"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a review state from their labels: good ones verified, bad ones under review, others neither."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang").join(labels, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "under_review").otherwise("unverified")
    return d.withColumn("status", status)


def referring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and a sentence for each that refers to an article or a document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 50 + 1).alias("a"))
    same = F.concat(F.lit("theo khoản 2 Điều "), "a", F.lit(" của Nghị định này."))
    numbered = F.concat(F.lit("theo Nghị định số "), "doc_id", F.lit("/2019/NĐ-CP của Chính phủ"))
    named = F.concat(F.lit("điểm a khoản 1 Điều "), "a", F.lit(" Luật An ninh mạng và các luật khác"))
    return d.withColumn("sentence", F.when(F.col("doc_id") % 3 == 0, same).when(F.col("doc_id") % 3 == 1, numbered).otherwise(named)).drop("a")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order to part edges of line items, both ends in one id space (parts from a thousand million on)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return li.select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("edge_id"), F.col("l_orderkey").alias("source_id"), (F.col("l_partkey") + 1_000_000_000).alias("target_id"))


EDGES_SQL = "edge AS (SELECT DISTINCT l_orderkey || '-' || l_partkey AS edge_id, l_orderkey AS source_id, l_partkey + 1000000000 AS target_id FROM lineitem)"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation and the one two turns later: the same speaker's two texts."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    b = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("later"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", "text", "later")
