"""Incremental crawling: which discovered pages are new or changed, as a batch step and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATE = "url string, last_checked_at string, retrieved_at string, lastmod string, sha256 string"


def crawl_step(discovered: DataFrame, state: DataFrame, fetched: DataFrame, budget: int, now: str) -> tuple[DataFrame, DataFrame]:
    """Outcome of each discovered page and the state afterwards.

    ``discovered`` has url, ord, lastmod; ``fetched`` url and sha256 of what a fetch would give (no row: the
    fetch fails). A page whose date is the one in the state is skipped without a fetch. Of the rest the first
    ``budget`` in order are fetched, the others are over budget. The same digest: unchanged, the state's check
    time and date move on. Another: fetched, the entry is replaced. A failed fetch changes nothing.

    Outcomes: skipped_lastmod, skipped_budget, unchanged, fetched, failed.
    """
    d = discovered.groupBy("url").agg(F.min("ord").alias("ord"), F.min_by("lastmod", F.when(F.col("lastmod").isNotNull(), F.col("ord"))).alias("lastmod"))
    s = state.select("url", F.col("lastmod").alias("old_lastmod"), F.col("sha256").alias("old_sha"), "retrieved_at")
    t = d.join(s, "url", "left").withColumn("same_date", F.col("lastmod").isNotNull() & F.coalesce(F.col("lastmod") == F.col("old_lastmod"), F.lit(False)))
    # the budget goes by place among the pages that need a fetch: only those are ordered, and only by number
    need = t.filter(~F.col("same_date")).select("url", "ord")
    chosen = need.orderBy("ord", "url").limit(budget).select("url", F.lit(True).alias("chosen"))
    t = t.join(chosen, "url", "left").join(fetched.select("url", F.col("sha256").alias("new_sha")), "url", "left")
    outcome = (
        F.when(F.col("same_date"), "skipped_lastmod").when(F.col("chosen").isNull(), "skipped_budget").when(F.col("new_sha").isNull(), "failed")
        .when(F.col("new_sha") == F.col("old_sha"), "unchanged").otherwise("fetched")
    )
    out = t.withColumn("outcome", outcome)
    touched = out.filter("outcome in ('unchanged', 'fetched')").select(
        "url", F.lit(now).alias("last_checked_at"), F.when(F.col("outcome") == "unchanged", F.col("retrieved_at")).otherwise(F.lit(now)).alias("retrieved_at"),
        F.coalesce("lastmod", F.when(F.col("outcome") == "unchanged", F.col("old_lastmod"))).alias("lastmod"), F.col("new_sha").alias("sha256"),
    )
    kept = state.join(touched.select("url"), "url", "left_anti")
    return out.select("url", "ord", "outcome"), touched.unionByName(kept)


def crawl_stream(discovered: DataFrame, state_path: str, fetch, budget: int, checkpoint: str, now: str):
    """The crawl as a stream: every micro-batch of discovered pages is one step, its state a new version.

    ``fetch`` turns a frame of urls into (url, sha256). State versions are written under
    ``state_path/version=<batch>``, so a batch that runs again after a failure starts from the same state and
    overwrites its own version only.
    """
    spark = discovered.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        state = spark.read.parquet(f"{state_path}/version={batch_id - 1}") if batch_id else spark.createDataFrame([], STATE)
        outcomes, after = crawl_step(batch, state, fetch(batch.select("url").distinct()), budget, now)
        after.write.mode("overwrite").parquet(f"{state_path}/version={batch_id}")
        outcomes.write.mode("overwrite").parquet(f"{state_path}/outcomes/batch={batch_id}")

    return discovered.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_outcomes(documents: DataFrame, ledger: DataFrame, max_documents: int | None, transient: tuple[str, ...] = ("HTTP_ERROR", "TIMEOUT")) -> tuple[DataFrame, DataFrame]:
    """The next batch and the ledger kept: documents (url, ord) that the ledger does not have, first come, and the
    ledger's rows whose reason is not a passing one. Without ``max_documents`` the batch is all of them."""
    kept = ledger.filter(~F.coalesce(F.col("reason").isin(*transient), F.lit(False)))
    w = documents.join(kept.select("url"), "url", "left_anti")
    return w if max_documents is None else w.orderBy("ord", "url").limit(max_documents), kept


def batch_outcomes(batch: DataFrame, results: DataFrame, ledger: DataFrame, at: str, transient: tuple[str, ...] = ("HTTP_ERROR", "TIMEOUT")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What became of a batch (url): (outcomes, the ledger after it, tallies).

    ``results`` has url, error (null: records came out) and all_passed. A whole document is ingested if all its
    records passed and else needs_review; a passing error is transient and does not enter the ledger, so that the
    document comes again; other errors, and documents without a result (NO_RESULT), are refused. ``ledger`` has
    url, status, reason and at. Tallies are (status, n).
    """
    t = batch.select("url").join(results.withColumn("__found", F.lit(True)), "url", "left")
    error = F.when(F.col("__found").isNull(), "NO_RESULT").otherwise(F.col("error"))
    status = F.when(error.isin(*transient), "transient").when(error.isNotNull(), "refused").when(F.coalesce("all_passed", F.lit(False)), "ingested").otherwise("needs_review")
    out = t.select("url", status.alias("status"), error.alias("reason"))
    new = out.filter("status <> 'transient'").withColumn("at", F.lit(at))
    kept = ledger.join(new.select("url"), "url", "left_anti").select("url", "status", "reason", "at")
    return out, kept.unionByName(new), out.groupBy("status").agg(F.count("*").alias("n"))


def rounds_until_idle(run_round, is_transient, pause=lambda: None) -> int:
    """Run rounds until one does nothing; a round with passing failures only is tried once more after a pause.

    ``run_round`` gives a round's counts of done and failed; ``is_transient`` tells whether its failures pass.
    """
    rounds, grace = 0, True
    while True:
        done, failed = run_round()
        rounds += 1
        if done:
            grace = True
        elif failed and grace and is_transient():
            grace = False
            pause()
        else:
            return rounds


def windowed_counts(events: DataFrame, ts: str, keys: list[str], size: str, late: str = "1 hour") -> DataFrame:
    """Extension: counts per tumbling window; on a stream, state is dropped ``late`` after the newest event."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, ts: str, user: str, gap_seconds: int) -> DataFrame:
    """Extension: sessions of each user: runs of events with gaps under ``gap_seconds``. Times count in whole seconds,
    rounded to the nearest one, halves to the even one."""
    w = Window.partitionBy(user).orderBy(ts)
    seconds = F.rint(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).cast("long")
    t = events.withColumn("__s", seconds)
    t = t.withColumn("__new", F.coalesce(F.col("__s") - F.lag("__s").over(w) >= gap_seconds, F.lit(True)).cast("int"))
    t = t.withColumn("session", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return t.groupBy(user, "session").agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
