"""Registered queries over sources of records: page payloads, archives, verification of releases, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import extract, sets
from tessera.plans.derive import table
from tessera.plans.lawbook import LAW_SQL, law
from tessera.plans.registry import query
from tessera.sources import releases, web
from tessera.streaming import crawl

ESCAPED = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
#: The text as it comes out of a page: no-break spaces as blanks, none before line ends, none at either end.
SHOWN_SQL = r"regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$', '', 'g')"


def _payloads(spark, sf_dir):
    """Every document as a streamed page: a length-prefixed part with two marked articles, the whole text in the first,
    then the metadata, which is missing or without its date in some."""
    d = table(spark, sf_dir, "documents")
    second = F.when(F.col("doc_id") % 5 == 0, F.lit('<p class="prov-article">Điều 2. Không số</p>')).otherwise(F.concat(F.lit('<p class="prov-article" id="b'), "doc_id", F.lit('">Điều 2. Hiệu lực &#233;</p>')))
    html = F.concat(
        F.lit('<p class="prov-chapter">Chương I</p><p class="prov-article" id="a'), "doc_id", F.lit('">Điều 1. <b>Phạm vi</b></p><p class="prov-content">'), F.expr(ESCAPED),
        F.lit('</p><p class="prov-clause">1. m<br/>n &quot;o&quot;</p>'), second,
    )
    meta = F.concat(
        F.lit('\n9:{"a":{"effFrom":"'), F.when(F.col("doc_id") % 11 == 0, "").otherwise("2020-03-04T00:00:00"), F.lit('","effTo":'), F.when(F.col("doc_id") % 2 == 0, '"2024-01-02T00:00:00"').otherwise("null"),
        F.lit(',"id":"'), "doc_id", F.lit('","title":"a } b","'), F.when(F.col("doc_id") % 7 == 0, "number").otherwise("docNum"), F.lit('":"'), "doc_id", F.lit('/2020/TT"}}'),
    )
    size = F.lower(F.hex(F.octet_length(html)))
    return d.select("doc_id", F.concat(F.lit("0:x\n1:T"), size, F.lit(","), html, meta).alias("payload"))


@query(f"""
WITH d AS (SELECT doc_id, doc_id || '/2020/TT' AS document_number, CASE WHEN doc_id % 2 = 0 THEN '2024-01-02' END AS valid_to, {SHOWN_SQL} || chr(10) || '1. m' || chr(10) || 'n "o"' AS body FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0)
SELECT doc_id, document_number, 'prov_vbpl_a' || doc_id AS provision_id, 'pv_vbpl_a' || doc_id || '_e20200304' AS version_id, 'Điều 1. Phạm vi' AS heading, sha256(body) AS text_sha256, '2020-03-04' AS valid_from, valid_to FROM d
UNION ALL SELECT doc_id, document_number, 'prov_vbpl_b' || doc_id, 'pv_vbpl_b' || doc_id || '_e20200304', 'Điều 2. Hiệu lực é', sha256('Điều 2. Hiệu lực é'), '2020-03-04', valid_to FROM d WHERE doc_id % 5 <> 0""")
def payload_drafts(spark, sf_dir):
    drafts, _ = extract.draft_from_payloads(_payloads(spark, sf_dir), "doc_id", "payload")
    return drafts.select("doc_id", "document_number", "provision_id", "version_id", "heading", "text_sha256", "valid_from", "valid_to")


@query("""
SELECT doc_id, 'document' AS locator, CASE WHEN doc_id % 7 = 0 THEN 'METADATA_NOT_FOUND' ELSE 'EFFECTIVE_DATE_MISSING' END AS reason FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0
UNION ALL SELECT doc_id, 'article 2', 'NO_ID' FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 = 0""")
def payload_refusals(spark, sf_dir):
    return extract.draft_from_payloads(_payloads(spark, sf_dir), "doc_id", "payload")[1]


@query("""
SELECT doc_id, r AS relation, doc_id || '-' || k AS target_document_id, 'văn bản ' || k AS name FROM documents, (VALUES ('amends', 1), ('amends', 2), ('replaces', 3)) t(r, k) WHERE doc_id % 3 > 0
UNION ALL SELECT NULL, 'unmapped 99', NULL, CAST(count(*) AS VARCHAR) FROM documents WHERE doc_id % 3 > 0""")
def payload_relations(spark, sf_dir):
    """Relations behind the whole text of each document; codes without a meaning as one row with their count."""
    one = lambda k: F.concat(F.lit('{"id":"'), "doc_id", F.lit(f'-{k}","name":"văn bản {k}"}}'))
    line = F.concat(F.lit('7:{"documentNamesByType":{"10":['), one(1), F.lit(","), one(2), F.lit('],"12":['), one(3), F.lit('],"3":['), one(4), F.lit('],"99":['), one(5), F.lit("]}}"))
    p = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", F.when(F.col("doc_id") % 3 > 0, line).otherwise("7:[]"), F.lit("end")).alias("payload"))
    known, unmapped = web.relations(p, "doc_id", "payload")
    rest = unmapped.select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("unmapped "), "code").alias("relation"), F.lit(None).cast("string").alias("target_document_id"), F.col("n").cast("string").alias("name"))
    return known.unionByName(rest)


@query("""
SELECT page_id, CASE WHEN page_id % 5 <> 1 THEN '/f/' || page_id || '.pdf?d=1' END AS pdf_url, CASE WHEN page_id % 5 <> 2 THEN page_id || '/2026/TT-BCA' END AS document_number,
  CASE WHEN page_id % 5 <> 3 THEN '2026-02-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS issued_on, CASE WHEN page_id % 5 <> 4 THEN '2026-07-01' END AS effective_from,
  CASE page_id % 5 WHEN 1 THEN 'NO_PDF' WHEN 2 THEN 'NO_NUMBER' WHEN 3 THEN 'NO_ISSUE_DATE' WHEN 4 THEN 'NO_EFFECTIVE_DATE' END AS refusal FROM pages""")
def detail_pages(spark, sf_dir):
    part = lambda k, c: F.when(F.col("page_id") % 5 != k, c)
    fields = F.concat_ws(
        "\n", part(1, F.concat(F.lit('<a href="/f/'), "page_id", F.lit('.pdf?d=1">PDF</a>'))), part(2, F.concat(F.lit("<li>Số hiệu: <b>"), "page_id", F.lit("/2026/TT-BCA</b></li>"))),
        part(3, F.concat(F.lit("<li>Ngày ban hành: "), F.col("page_id") % 28 + 1, F.lit("/2/2026</li>"))), part(4, F.lit("<li>Ngày có hiệu lực:&nbsp;1/7/2026</li>")),
    )
    p = table(spark, sf_dir, "pages").select("page_id", F.concat_ws("\n", "html", fields).alias("html"))
    return extract.read_detail_page(p).drop("html")


def _chain(spark, sf_dir):
    """A release, its archives, what is derived from them and its reviews, with faults by id."""
    v = law(spark, sf_dir).withColumn("source_sha256", F.sha2(F.concat_ws("#", "text", "doc_id"), 256))
    versions = v.withColumn("text_sha256", F.sha2(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256))
    archives = v.filter("doc_id % 9 <> 0").select(F.col("source_sha256").alias("sha256"), (F.col("doc_id") % 8 != 0).alias("present"))
    archives = archives.union(v.filter("doc_id % 50 = 0").select(F.sha2(F.concat(F.lit("orphan"), "doc_id"), 256), F.lit(True)))
    derived = v.filter("doc_id % 7 <> 0").select("source_sha256", F.when(F.col("doc_id") % 12 == 1, "prov_other").otherwise(F.col("provision_id")).alias("provision_id"), "text")
    reviews = v.filter("doc_id % 10 <> 1").select(F.col("version_id").alias("target"), F.when(F.col("doc_id") % 4 == 1, "machine").alias("method"))
    reviews = reviews.withColumn("method", F.when(F.col("target").rlike("4$"), "machine").otherwise(F.col("method")))
    return versions, archives, derived, reviews


CHAIN_SQL = f"""{LAW_SQL}, ch AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'EVIDENCE_NOT_ARCHIVED' WHEN doc_id % 8 = 0 THEN 'ARCHIVE_NOT_PRESENT' WHEN doc_id % 7 = 0 THEN 'SOURCE_NOT_DERIVABLE' WHEN doc_id % 12 = 1 THEN 'PROVISION_NOT_IN_SOURCE' WHEN doc_id % 13 = 0 THEN 'TEXT_MISMATCH' END AS issue,
  CASE WHEN doc_id % 10 = 1 THEN 'UNVOUCHED_RECORD' WHEN doc_id % 4 = 0 AND doc_id % 10 = 4 THEN 'WRONG_VOUCHER' ELSE 'ok' END AS voucher FROM lawh)"""


@query(f"""
WITH {CHAIN_SQL} SELECT version_id AS locator, issue FROM ch WHERE issue IS NOT NULL UNION ALL SELECT version_id, voucher FROM ch WHERE served AND voucher <> 'ok'
UNION ALL SELECT sha256('orphan' || doc_id), 'ORPHAN_ARCHIVE' FROM documents WHERE doc_id % 50 = 0""")
def chain_verify(spark, sf_dir):
    return releases.verify_chain(*_chain(spark, sf_dir))


@query(f"""
WITH {CHAIN_SQL} SELECT count(*) FILTER (WHERE issue IS NULL) AS derived, count(*) FILTER (WHERE issue = 'ARCHIVE_NOT_PRESENT') AS unchecked, count(*) FILTER (WHERE served AND voucher = 'ok') AS vouched,
  count(*) FILTER (WHERE doc_id % 9 <> 0 AND doc_id % 8 <> 0) + count(*) FILTER (WHERE doc_id % 50 = 0) AS archived FROM ch""")
def chain_counts(spark, sf_dir):
    return releases.chain_counts(*_chain(spark, sf_dir))


@query("""
WITH f AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE text IS NOT NULL) SELECT h || '.txt' AS name FROM f WHERE h NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0)""")
def archive_additions(spark, sf_dir):
    files = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), F.lit("txt").alias("ext"))
    return releases.archive(files, files.filter("doc_id % 3 = 0")).select("name")


@query("""
SELECT 'd/' || doc_id AS name, CASE WHEN doc_id % 4 = 0 THEN 'absent' WHEN doc_id % 6 = 1 THEN 'mismatch' ELSE 'ok' END AS state,
  CASE WHEN doc_id % 5 = 0 THEN 'source_corrupt' WHEN doc_id % 4 = 0 THEN 'missing' WHEN doc_id % 6 = 1 THEN 'copy_corrupt' ELSE 'same' END AS backup FROM documents WHERE text IS NOT NULL""")
def archive_states(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("name"), F.sha2("text", 256).alias("sha256"))
    copy = d.filter("doc_id % 4 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 6 == 1, "x").otherwise(F.col("sha256")))
    source = d.select(F.col("name").alias("path"), "sha256", F.when(F.col("doc_id") % 5 == 0, "y").otherwise(F.col("sha256")).alias("registered"))
    backup = sets.compare_copies(source, copy.withColumnRenamed("name", "path")).select(F.col("path").alias("name"), F.col("state").alias("backup"))
    return releases.archive_state(d, copy).join(backup, "name")


@query("""
SELECT page_id, left(sha256(html), 12) || '.' || CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'rsc.txt' WHEN 2 THEN 'pdf' ELSE 'bin' END AS name, left(sha256(html), 12) || '.evidence.json' AS evidence_name, sha256(html) AS sha256, octet_length(encode(html)) AS n_bytes
FROM pages""")
def stored_documents(spark, sf_dir):
    kind = F.when(F.col("page_id") % 4 == 0, "text/html; charset=utf-8").when(F.col("page_id") % 4 == 1, "text/x-component").when(F.col("page_id") % 4 == 2, "application/pdf")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("https://a.org/"), "page_id", F.lit("?x.html")).alias("url"), kind.alias("content_type"), F.encode("html", "UTF-8").alias("content"), F.lit("2024-01-01T00:00:00.000Z").alias("retrieved_at"))
    e = F.from_json("evidence", "byteLength long, sourceSha256 string")
    return releases.stored_documents(pages).select(F.regexp_extract("url", r"([0-9]+)\?", 1).cast("long").alias("page_id"), "name", "evidence_name", e["sourceSha256"].alias("sha256"), e["byteLength"].alias("n_bytes"))


BATCH_SQL = """b AS (SELECT doc_id, doc_id % 3 = 0 AS known, CASE WHEN doc_id % 10 = 1 THEN 'transient' WHEN doc_id % 10 = 2 OR doc_id % 7 = 0 THEN 'refused' WHEN doc_id % 2 = 0 THEN 'ingested' ELSE 'needs_review' END AS status,
  CASE WHEN doc_id % 10 = 1 THEN 'TIMEOUT' WHEN doc_id % 10 = 2 THEN 'NO_ARTICLES' WHEN doc_id % 7 = 0 THEN 'NO_RESULT' END AS reason FROM documents)"""


def _batch(spark, sf_dir):
    """A batch of the documents that the ledger, with every third, does not have; results with failures by id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://a.org/"), "doc_id").alias("url"), F.col("doc_id").alias("ord"))
    ledger = d.filter("doc_id % 3 = 0").select("url", F.lit("ingested").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit("old").alias("at"))
    error = F.when(F.col("doc_id") % 10 == 1, "TIMEOUT").when(F.col("doc_id") % 10 == 2, "NO_ARTICLES")
    results = d.filter("doc_id % 7 <> 0 or doc_id % 10 in (1, 2)").select("url", error.alias("error"), (F.col("doc_id") % 2 == 0).alias("all_passed"))
    pending, kept = crawl.latest_outcomes(d, ledger, None)
    return crawl.batch_outcomes(pending, results, kept, "now")


@query(f"""
WITH {BATCH_SQL} SELECT 'https://a.org/' || doc_id AS url, CASE WHEN known THEN 'ingested' ELSE status END AS status, CASE WHEN NOT known THEN reason END AS reason, CASE WHEN known THEN 'old' ELSE 'now' END AS at FROM b WHERE known OR status <> 'transient'""")
def batch_ledger(spark, sf_dir):
    return _batch(spark, sf_dir)[1]


@query(f"WITH {BATCH_SQL} SELECT status, count(*) AS n FROM b WHERE NOT known GROUP BY 1")
def batch_tallies(spark, sf_dir):
    return _batch(spark, sf_dir)[2]
