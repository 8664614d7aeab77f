"""Documents as a versioned corpus of provisions, and as lines of gazette pages, with faults planted by id.

Both keep the whole text of every document. Each shape has a twin in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.derive import table

#: References added to the texts, by the remainder of the id modulo 5.
SENTENCES = (
    "'theo khoản 2 Điều 2 của Nghị định này.'",
    "concat('theo Điều 3 của Nghị định số ', doc_id % 50, '/2019/NĐ-CP')",
    "concat('theo Nghị định số ', CASE WHEN doc_id % 2 = 0 THEN '1/2019/NĐ-CP' ELSE '9/1999/NĐ-CP' END)",
    "'điểm a khoản 1 Điều 5 Luật An ninh mạng và các luật khác'",
    "'khoản 1 Điều này'",
)
SENTENCE_SQL = "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(SENTENCES)) + " END"

LAW_SQL = f"""
lw0 AS (SELECT *, doc_id // 3 AS p, doc_id // 12 AS g, CAST(doc_id % 3 AS INTEGER) AS k, DATE '2010-01-01' + CAST(doc_id % 3 * 1000 AS INTEGER) AS valid_from FROM documents
), law AS (
  SELECT doc_id, p, g, 'pv_' || doc_id AS version_id, 'prov_' || p AS provision_id, 'doc_' || g AS document_id, g || '/2019/NĐ-CP' AS document_number,
    CASE WHEN g % 5 = 0 AND p % 4 = 3 THEN 3 ELSE p % 4 + 1 END AS article, source,
    coalesce(text, '') || chr(10) || {SENTENCE_SQL} AS text, valid_from,
    CASE WHEN k < 2 THEN DATE '2010-01-01' + (k + 1) * 1000 + CASE WHEN doc_id % 30 = 0 THEN 400 ELSE 0 END END AS valid_to,
    CAST(valid_from AS TIMESTAMP) + (doc_id % 5) * INTERVAL 1 DAY AS known_from,
    ['verified', 'machine_checked', 'under_review', 'unverified'][doc_id % 4 + 1] AS status, doc_id % 4 < 2 AS served
  FROM lw0
), lawh AS (SELECT *, 'Điều ' || article || '. ' || coalesce(source, '') AS heading FROM law
), asked AS (
  SELECT doc_id AS question_id, CASE WHEN doc_id % 41 = 0 THEN 'prov_none' ELSE 'prov_' || doc_id // 3 END AS provision_id,
    DATE '2009-10-01' + CAST(doc_id * 37 % 4000 AS INTEGER) AS valid_at, CAST(DATE '2009-10-01' + CAST(doc_id * 37 % 4000 AS INTEGER) AS TIMESTAMP) + INTERVAL 3 DAY AS known_at FROM documents
)"""


def answers_sql(questions: str) -> str:
    """CTE body: what holds for each row of ``questions`` (question_id, provision_id, valid_at, known_at)."""
    return f"""(SELECT question_id, provision_id, valid_at, known_at, CASE WHEN n_good = 1 THEN 'resolved' WHEN n_good > 1 THEN 'conflict' ELSE 'unknown' END AS status,
  CASE WHEN n_good = 1 THEN one END AS version_id, CASE WHEN n_good > 0 THEN NULL WHEN n_all > 0 THEN 'MATCH_ONLY_UNVERIFIED' ELSE 'NO_MATCHING_VERSION' END AS reason FROM (
  SELECT q.question_id, q.provision_id, q.valid_at, q.known_at, count(v.version_id) AS n_all, count(v.version_id) FILTER (WHERE v.served) AS n_good, min(v.version_id) FILTER (WHERE v.served) AS one
  FROM {questions} q LEFT JOIN lawh v ON q.provision_id = v.provision_id AND q.valid_at >= v.valid_from AND (v.valid_to IS NULL OR q.valid_at < v.valid_to) AND q.known_at >= v.known_from
  GROUP BY ALL))"""


def law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a version of a provision: three versions a provision, four provisions a document.

    Statuses go round by id; every 30th version holds 400 days too long; every fifth document has two articles 3.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.expr("doc_id div 3").alias("p"), F.expr("doc_id div 12").alias("g"), F.expr("cast(doc_id % 3 as int)").alias("k"))
    article = F.when((F.col("g") % 5 == 0) & (F.col("p") % 4 == 3), 3).otherwise(F.col("p") % 4 + 1)
    start = F.expr("date_add(date'2010-01-01', k * 1000)")
    evidence = F.array(F.struct(
        F.concat(F.lit("ev_"), "doc_id").alias("evidence_id"), F.concat(F.lit("https://"), F.when(F.col("doc_id") % 10 == 0, "elsewhere.net").otherwise("law.example.org"), F.lit("/"), "doc_id").alias("url"),
        F.when(F.col("doc_id") % 19 == 0, "2030-01-01T00:00:00.000Z").otherwise("2024-01-01T00:00:00.000Z").alias("retrieved_at"),
    ))
    return d.select(
        "doc_id", F.concat(F.lit("pv_"), "doc_id").alias("version_id"), F.concat(F.lit("prov_"), "p").alias("provision_id"), F.concat(F.lit("doc_"), "g").alias("document_id"), F.concat("g", F.lit("/2019/NĐ-CP")).alias("document_number"),
        F.concat(F.lit("Điều "), article, F.lit(". "), F.coalesce("source", F.lit(""))).alias("heading"), F.concat_ws("\n", F.coalesce("text", F.lit("")), F.expr(SENTENCE_SQL)).alias("text"), start.alias("valid_from"),
        F.expr("CASE WHEN k < 2 THEN date_add(date'2010-01-01', (k + 1) * 1000 + CASE WHEN doc_id % 30 = 0 THEN 400 ELSE 0 END) END").alias("valid_to"),
        (start.cast("timestamp_ntz") + F.expr("make_dt_interval(cast(doc_id % 5 as int))")).alias("known_from"), F.lit(None).cast("timestamp_ntz").alias("known_to"),
        F.expr("element_at(array('verified', 'machine_checked', 'under_review', 'unverified'), cast(doc_id % 4 as int) + 1)").alias("status"), F.col("doc_id").alias("ord"),
        evidence.alias("evidence"), F.when(F.col("doc_id") % 23 == 0, "ev_none").otherwise(F.concat(F.lit("ev_"), "doc_id")).alias("primary_evidence_id"),
    )


def law_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per document: what held of its provision on some day, as known three days later."""
    day = F.expr("date_add(date'2009-10-01', cast(doc_id * 37 % 4000 as int))")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 41 == 0, "prov_none").otherwise(F.expr("concat('prov_', doc_id div 3)")).alias("provision_id"),
        day.alias("valid_at"), (day.cast("timestamp_ntz") + F.expr("make_dt_interval(3)")).alias("known_at"),
    )


#: Lines of a gazette document around the lines of its text: (page, x, font size, text, part, article). Values are SQL
#: expressions over doc_id. The second article's number breaks the order in every seventh document.
HEAD = (
    ("1", "100", "12", "'CÔNG BÁO 1'", "running", "NULL"),
    ("1", "100", "12", "concat('Số: ', doc_id, '/2026/TT-BCA')", "preamble", "NULL"),
    ("1", "100", "12", "concat('Hà Nội, ngày ', doc_id % 28 + 1, ' tháng ', doc_id % 12 + 1, ' năm 2026')", "preamble", "NULL"),
    ("1", "100", "12", "'Điều 1. Phạm vi'", "article", "1"),
)
SECOND = "CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 2 END"
TAIL = (
    ("1", "100", "12", "'trang 1'", "running", "NULL"),
    ("2", "100", "12", "'CÔNG BÁO 2'", "running", "NULL"),
    ("2", "100", "12", "'Chương II QUY ĐỊNH'", "structure", "NULL"),
    ("2", "100", "12", "'ngoài'", "unassigned", "NULL"),
    ("2", "100", "12", f"concat('Điều ', {SECOND}, '. Hiệu lực')", "article", SECOND),
    ("2", "100", "12", "CASE WHEN doc_id % 9 = 0 THEN '1. Có hiệu lực kể từ ngày ký.' WHEN doc_id % 9 = 1 THEN '1. Không nói gì.' ELSE '1. Văn bản này có hiệu lực từ ngày 01/07/2026.' END", "article", SECOND),
    ("2", "100", "12", "'2. Như sau:'", "article", SECOND),
    ("2", "100", "12", "'a) một'", "article", SECOND),
    ("2", "100", "12", "CASE WHEN doc_id % 5 = 0 THEN 'd) hai' ELSE 'b) hai' END", "article", SECOND),
    ("2", "100", "12", "'2.1. không phải khoản'", "article", SECOND),
    ("2", "100", "12", "CASE WHEN doc_id % 11 = 0 THEN '5. năm' ELSE '3. ba' END", "article", SECOND),
    ("2", "100", "9", "'chú thích nhỏ'", "apparatus", "NULL"),
    ("2", "400", "12", "'BỘ TRƯỞNG'", "signature", SECOND),
    ("2", "420", "12", "'Nguyễn A'", "signature", SECOND),
    ("2", "100", "12", "'trang 2'", "running", "NULL"),
    ("3", "100", "12", "'CÔNG BÁO 3'", "running", "NULL"),
    ("3", "100", "12", "'PHỤ LỤC I'", "annex", "NULL"),
    ("3", "100", "12", "'Điều 1. của phụ lục'", "annex", "NULL"),
    ("3", "100", "12", "'trang 3'", "running", "NULL"),
)


def gazette_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as three gazette pages, the whole text inside its first article."""

    def line(page, x, size, content: Column) -> Column:
        return F.struct(F.expr(page).cast("int").alias("page"), F.expr(x).cast("double").alias("x"), F.expr(size).cast("double").alias("font_size"), content.cast("string").alias("text"))

    def fixed(rows) -> Column:
        return F.array(*[line(r[0], r[1], r[2], F.expr(r[3])) for r in rows])

    body = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: line("1", "100", "12", t))
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.concat(fixed(HEAD), body, fixed(TAIL))).alias("ord", "l"))
    return d.select("doc_id", "l.page", F.lit(595.0).alias("page_width"), "l.x", "l.font_size", "ord", "l.text")


def _planted(rows) -> str:
    return "[" + ", ".join(f"{{'text': {r[3]}, 'part': '{r[4]}', 'article': CAST({r[5]} AS INTEGER)}}" for r in rows) + "]"


#: The same lines with the part that each was planted as.
GAZETTE_SQL = f"""
gz0 AS (SELECT doc_id, list_concat(list_concat({_planted(HEAD)}, list_transform(string_split(coalesce(text, ''), chr(10)), lambda t: {{'text': t, 'part': 'article', 'article': 1}})), {_planted(TAIL)}) AS l FROM documents
), gz AS (SELECT doc_id, ord, r.text AS text, r.part AS part, r.article AS article FROM (SELECT doc_id, unnest(l) AS r, unnest(range(0, len(l))) AS ord FROM gz0))"""


def gazette_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page says of each document; every sixth number and every eighth date of issue are wrong."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    day = F.when(F.col("doc_id") % 8 == 0, "2025-01-01").otherwise(F.expr("concat('2026-', lpad(doc_id % 12 + 1, 2, '0'), '-', lpad(doc_id % 28 + 1, 2, '0'))"))
    number = F.concat("doc_id", F.when(F.col("doc_id") % 6 == 0, "/2027/TT-BCA").otherwise("/2026/TT-BCA"))
    return d.select("doc_id", number.alias("document_number"), day.alias("issued_on"), F.when(F.col("doc_id") % 4 == 0, day).otherwise("2026-07-01").alias("effective_from"))


GAZETTE_REF_SQL = """
ref0 AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN '2025-01-01' ELSE '2026-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS issued_on FROM documents
), ref AS (SELECT doc_id, issued_on, CASE WHEN doc_id % 4 = 0 THEN issued_on ELSE '2026-07-01' END AS effective_from FROM ref0)"""
