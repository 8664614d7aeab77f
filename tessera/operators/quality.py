"""Cross-checks of extracted records against their sources, and the gate before publishing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.functions.batches import bounded_batches
from tessera.functions.checks import host_allowed, servable
from tessera.functions.text import collapse, collapse_lines, compact, iso_from_spoken_date
from tessera.operators.compare import dice
from tessera.operators.temporal import collisions

#: The letters by which points are numbered, in order (fixed value).
POINT_LETTERS = "abcdđeghiklmnopqrstuvxy"
#: Similarity from which a second reading agrees.
SECOND_READING = 0.97


def _result(df: DataFrame, check: str, status) -> DataFrame:
    return df.select("doc_id", F.lit(check).alias("check"), status.alias("status"))


def check_number(preambles: DataFrame, references: DataFrame) -> DataFrame:
    """The document's number stands in its preamble. ``preambles`` has doc_id, ord, text."""
    joined = preambles.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("ord", "text")))["text"], " ").alias("text"))
    t = references.join(joined, "doc_id", "left")
    hit = compact(F.coalesce("text", F.lit(""))).contains(compact(F.col("document_number")))
    return _result(t, "DOCUMENT_NUMBER", F.when(hit, "pass").otherwise("flag"))


def check_issue_date(preambles: DataFrame, references: DataFrame) -> DataFrame:
    """The first date of the preamble is the date of issue."""
    dated = preambles.withColumn("date", iso_from_spoken_date(F.col("text"))).filter("date is not null")
    t = references.join(dated.groupBy("doc_id").agg(F.min_by("date", "ord").alias("date")), "doc_id", "left")
    return _result(t, "ISSUE_DATE", F.when(F.col("date").isNull(), "not_available").when(F.col("date") == F.col("issued_on"), "pass").otherwise("flag"))


def check_effective_date(lines: DataFrame, references: DataFrame) -> DataFrame:
    """A line that says when the text takes effect agrees with the page. ``lines`` has doc_id, text."""
    t = lines.filter(F.col("text").rlike("(?iu)có hiệu lực")).withColumn("date", iso_from_spoken_date(F.col("text")))
    t = t.join(references, "doc_id").groupBy("doc_id", "issued_on", "effective_from").agg(
        F.bool_or(F.col("date") == F.col("effective_from")).alias("agrees"), F.count("date").alias("dated"), F.bool_or(F.col("text").rlike("(?iu)ngày ký")).alias("signing")
    )
    status = (
        F.when(F.col("agrees"), "pass").when(F.col("dated") > 0, "flag")
        .when(F.col("signing"), F.when(F.col("effective_from") == F.col("issued_on"), "pass").otherwise("flag")).otherwise("not_available")
    )
    found = _result(t, "EFFECTIVE_DATE", status)
    return found.union(_result(references.join(t, "doc_id", "left_anti"), "EFFECTIVE_DATE", F.lit("not_available")))


def numbering_breaks(lines: DataFrame) -> DataFrame:
    """Clauses and points that break their numbering: doc_id, article, ord, expected, found.

    ``lines`` has doc_id, article, ord, text. After a break counting goes on from what was found, so the value
    expected is the one before plus one. Points start anew at every clause; a letter that is no point's counts
    as place 0. "2.1" numbers no clause.
    """
    clause = F.nullif(F.regexp_extract("text", r"^\s*([0-9]+)[.](?![0-9])", 1), F.lit("")).try_cast("int").cast("long")
    point = F.nullif(F.regexp_extract("text", r"^\s*([a-zđ])[)]", 1), F.lit(""))
    t = lines.select("doc_id", "article", "ord", clause.alias("clause"), point.alias("point")).withColumn("point", F.when(F.col("clause").isNull(), F.col("point")))
    # other lines end here, so that no text is sorted
    t = t.filter("clause is not null or point is not null").withColumn("at", F.expr(f"locate(point, '{POINT_LETTERS}')"))
    article, before = Window.partitionBy("doc_id", "article").orderBy("ord"), (Window.unboundedPreceding, -1)
    t = t.withColumn("group", F.count("clause").over(article.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("last", F.last("clause", ignorenulls=True).over(article.rowsBetween(*before)))
    group = Window.partitionBy("doc_id", "article", "group").orderBy("ord").rowsBetween(*before)
    is_clause = F.col("clause").isNotNull()
    t = t.withColumn("last", F.when(is_clause, F.col("last")).otherwise(F.last("at", ignorenulls=True).over(group)))
    t = t.withColumn("e", F.coalesce(F.col("last") + 1, F.lit(1))).filter(F.coalesce("clause", "at") != F.col("e"))
    letter = F.expr(f"substring('{POINT_LETTERS}', cast(e as int), 1)")
    return t.select("doc_id", "article", "ord", F.when(is_clause, F.col("e").cast("string")).otherwise(letter).alias("expected"), F.coalesce(F.col("clause").cast("string"), "point").alias("found"))


def check_numbering(lines: DataFrame, references: DataFrame) -> DataFrame:
    broken = numbering_breaks(lines).select("doc_id").distinct().withColumn("broken", F.lit(True))
    return _result(references.join(broken, "doc_id", "left"), "NUMBERING", F.when(F.col("broken"), "flag").otherwise("pass"))


def check_second_reading(texts: DataFrame) -> DataFrame:
    """``texts`` has doc_id, text, second (null: there is no second reading)."""
    similarity = dice(F.col("text"), F.col("second"), F.col("second").isNotNull())
    return _result(bounded_batches(texts), "SECOND_EXTRACTOR", F.when(F.col("second").isNull(), "not_available").when(similarity >= SECOND_READING, "pass").otherwise("flag"))


def check_balance(source_lines: DataFrame, placed_lines: DataFrame) -> DataFrame:
    """Every character of the source went to some part. Both have doc_id and text."""
    a = source_lines.groupBy("doc_id").agg(F.sum(F.length("text")).alias("a"))
    b = placed_lines.groupBy("doc_id").agg(F.sum(F.length("text")).alias("b"))
    return _result(a.join(b, "doc_id", "left"), "CHARACTER_BALANCE", F.when(F.col("a") == F.coalesce("b", F.lit(0)), "pass").otherwise("flag"))


def roll_up(results: DataFrame) -> DataFrame:
    """(doc_id, flagged, not_available, all_passed) of check results."""
    named = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("check"))))
    return results.groupBy("doc_id").agg(named("flag").alias("flagged"), named("not_available").alias("not_available"), F.bool_and(F.col("status") == "pass").alias("all_passed"))


def mark_machine_checked(records: DataFrame, rolled: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Records of documents whose checks all ran and passed become machine_checked; verified ones stay so."""
    passed = rolled.filter("all_passed").select(F.col("doc_id").alias(doc_col), F.lit(True).alias("__ok"))
    status = F.when(F.col("status") == "verified", "verified").when(F.col("__ok"), "machine_checked").otherwise(F.col("status"))
    return records.join(passed, doc_col, "left").withColumn("status", status).drop("__ok")


def promote(records: DataFrame, target: str, reviewer: str, at: str, id_col: str = "version_id") -> tuple[DataFrame, DataFrame]:
    """One record as verified by a named reviewer, and its audit row.

    Raises ValueError unless exactly one record that is not verified yet has the id, or if no reviewer is named.
    """
    if not reviewer.strip():
        raise ValueError("a reviewer must be named")
    hits = records.filter(F.col(id_col) == target).select("status").limit(2).collect()
    if len(hits) != 1:
        raise ValueError(f"{len(hits)} records have the id {target}")
    if hits[0]["status"] == "verified":
        raise ValueError(f"{target} is verified already")
    out = records.withColumn("status", F.when(F.col(id_col) == target, "verified").otherwise(F.col("status")))
    audit = records.sparkSession.createDataFrame([(target, reviewer, at, "human")], "target string, reviewed_by string, reviewed_at string, method string")
    return out, audit


def coverage(source_lines: DataFrame, records: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Source lines that no record has: neither as a line or heading of one, nor inside the document's text.

    ``source_lines`` has doc, ord, text; ``records`` doc, heading, text and, where a document has several,
    ord, by which their texts follow one another (else by text). Lines and records are dealt by document once; a
    document's lines are looked up among those of its records, and what is left is searched in its whole text, so no
    line is a key that is sorted or joined, and no text is repeated for each line.
    """
    asked = source_lines.select(doc, "ord", collapse(F.col("text")).alias("line")).filter("line <> ''")
    asked = asked.groupBy(doc).agg(F.collect_list(F.struct("ord", "line")).alias("asked"))
    order = F.col("ord") if "ord" in records.columns else F.lit(0)
    parts = F.sort_array(F.collect_list(F.struct(order.alias("ord"), F.col("text").alias("text"))))["text"]
    has = records.groupBy(doc).agg(parts.alias("parts"), F.collect_set(collapse(F.col("heading"))).alias("heads"))
    rows = asked.join(has.select(doc, "heads", collapse_lines(F.array_join("parts", "\n")).alias("text")), doc, "left")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ords, lines = batch["asked"].flatten().flatten()
            line, at, open_lines = iter(enumerate(lines.to_pylist())), [], []
            for i, (n, text, heads) in enumerate(zip(batch["asked"].value_lengths().to_pylist(), batch["text"], batch["heads"])):
                own = [x.strip(" ") for x in (text.as_py() or "").split("\n")]
                found, whole = dict.fromkeys([*own, *(heads.as_py() or ())], True), " ".join(filter(None, own))
                for k, x in islice(line, n):
                    if x not in found:
                        found[x] = x in whole
                    if not found[x]:
                        at.append(i)
                        open_lines.append(k)
            yield pa.RecordBatch.from_arrays([batch[doc].take(pa.array(at, pa.int64())), *(c.take(pa.array(open_lines, pa.int64())) for c in (ords, lines))], names=[doc, "ord", "line"])

    out = StructType([rows.schema[doc], *rows.schema["asked"].dataType.elementType.fields])
    return bounded_batches(rows).mapInArrow(run, out)


def article_issues(articles: DataFrame, doc: str = "doc_id") -> DataFrame:
    """GAP, DUPLICATE and UNNUMBERED articles: (doc, issue, number). ``articles`` has doc, ord, number."""
    d = Window.partitionBy(doc, "number").orderBy("ord")
    numbered = articles.filter("number is not null").withColumn("k", F.row_number().over(d))
    twice = numbered.filter("k > 1").select(doc, F.lit("DUPLICATE").alias("issue"), "number")
    steps = numbered.filter("k = 1").withColumn("before", F.coalesce(F.lag("number").over(Window.partitionBy(doc).orderBy("number")), F.lit(0)))
    holes = steps.filter("number > before + 1").select(doc, F.lit("GAP").alias("issue"), F.explode(F.sequence(F.col("before") + 1, F.col("number") - 1)).alias("number"))
    none = articles.filter("number is null").select(doc, F.lit("UNNUMBERED").alias("issue"), F.lit(None).cast(articles.schema["number"].dataType).alias("number"))
    return twice.union(holes).union(none)


def publish_issues(versions: DataFrame, amendments: DataFrame, applicability: DataFrame, now: str, allowed_hosts: list[str]) -> DataFrame:
    """What keeps a release from being published: (locator, issue). No rows: it may be.

    ``versions`` has version_id, provision_id, text, text_sha256, status, intervals and evidence (array of structs
    with url and retrieved_at); ``amendments`` amendment_id, target_id, status; ``applicability`` condition_id, status.
    """
    evidence = versions.select("version_id", F.explode("evidence").alias("e"))
    host = F.try_parse_url(F.col("e.url"), F.lit("HOST"))
    known = versions.select(F.col("provision_id").alias("target_id")).distinct()
    parts = [
        versions.filter(~servable(F.col("status"))).select(F.col("version_id").alias("locator"), F.lit("NOT_SERVABLE").alias("issue")),
        versions.filter(F.sha2("text", 256) != F.col("text_sha256")).select("version_id", F.lit("TEXT_HASH_MISMATCH")),
        evidence.filter(~host_allowed(host, allowed_hosts)).select("version_id", F.lit("HOST_NOT_ALLOWED")),
        evidence.filter(F.col("e.retrieved_at") > F.lit(now)).select("version_id", F.lit("RETRIEVED_IN_FUTURE")),
        collisions(versions).select("second_id", F.lit("OVERLAPPING_VERSIONS")),
        applicability.filter("status <> 'verified'").select("condition_id", F.lit("APPLICABILITY_NOT_VERIFIED")),
        amendments.filter("status <> 'verified'").select("amendment_id", F.lit("AMENDMENT_NOT_VERIFIED")),
        amendments.join(known, "target_id", "left_anti").select("amendment_id", F.lit("TARGET_NOT_IN_RELEASE")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def review_queue(records: DataFrame, rate: float = 0.05, seed: int = 1, ord_col: str = "ord") -> DataFrame:
    """Records that a person has to read (must_read) and a sample of the machine-checked ones (sampled).

    The k-th machine-checked record in load order is sampled if the k-th draw is under ``rate``; verified
    records are not listed. ``k`` is counted per range of 100,000 places, so no task ranks all records.
    """
    from tessera.operators.sets import seeded_draws

    must = records.filter(F.col("status").isin("under_review", "unverified")).withColumn("queue", F.lit("must_read"))
    part = F.floor(F.col(ord_col) / 100_000)
    checked = records.filter("status = 'machine_checked'").withColumn("__part", part)
    sizes = checked.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__before", before).drop("__n")
    k = F.row_number().over(Window.partitionBy("__part").orderBy(ord_col)) + F.col("__before")
    drawn = checked.join(sizes, "__part").withColumn("__k", k).filter(seeded_draws(F.col("__k"), seed) < rate)
    return must.unionByName(drawn.drop("__part", "__before", "__k").withColumn("queue", F.lit("sampled")))


def review_list(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status, version_id, heading) of all records, and how many still await review."""
    return records.select("status", "version_id", "heading"), records.agg(F.count_if(~servable(F.col("status"))).alias("awaiting_review"))
