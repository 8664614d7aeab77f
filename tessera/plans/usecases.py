"""Registered queries over the versioned corpus and the gazette pages of ``lawbook``: the use cases of the service,
extraction, cross-checks and the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import checks, text
from tessera.functions.batches import bounded_batches
from tessera.operators import compare, extract, quality
from tessera.plans import service
from tessera.plans.derive import stored, table
from tessera.plans.lawbook import GAZETTE_REF_SQL, GAZETTE_SQL, LAW_SQL, answers_sql, gazette_lines, gazette_references, law, law_questions
from tessera.plans.registry import FOLD_SQL, KEPT_SQL, TOKENS_SQL, query

# ---------------------------------------------------------------- use cases


@query(f"""
WITH {LAW_SQL}, a AS {answers_sql("asked")}
SELECT question_id, a.status, a.version_id, reason, CASE WHEN a.status = 'resolved' THEN 'effective' END AS validity, document_number, heading, sha256(text) AS text_sha256,
  CASE WHEN doc_id % 23 <> 0 THEN 'https://' || CASE WHEN doc_id % 10 = 0 THEN 'elsewhere.net' ELSE 'law.example.org' END || '/' || doc_id END AS url, true AS untrusted_content
FROM a LEFT JOIN lawh USING (version_id)""")
def usecase_provision_at(spark, sf_dir):
    out = service.provision_at(law_questions(spark, sf_dir), law(spark, sf_dir))
    return out.select("question_id", "status", "version_id", "reason", "validity", "document_number", "heading", F.sha2("text", 256).alias("text_sha256"), F.col("citation.url").alias("url"), "untrusted_content")


CITED_SQL = f"""{LAW_SQL}, c AS (
  SELECT doc_id AS question_id, CASE WHEN doc_id % 17 = 0 THEN -1 ELSE doc_id // 12 END AS g, doc_id % 6 + 1 AS article, valid_at, known_at,
    CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 9 = 0 THEN 'khác hẳn' ELSE coalesce(text, '') || ' thêm' END AS quote FROM documents JOIN asked ON question_id = doc_id
), f AS (SELECT question_id, count(DISTINCT provision_id) AS n, min(provision_id) AS pid FROM c JOIN lawh v ON c.g = v.g AND c.article = v.article GROUP BY 1
), loc AS (SELECT c.*, CASE WHEN NOT EXISTS (SELECT 1 FROM lawh v WHERE v.g = c.g) THEN 'DOCUMENT_NOT_IN_CORPUS' WHEN n IS NULL THEN 'ARTICLE_NOT_IN_DOCUMENT' WHEN n > 1 THEN 'ARTICLE_AMBIGUOUS' END AS why, CASE WHEN n = 1 THEN pid END AS provision_id FROM c LEFT JOIN f USING (question_id)
), good AS (SELECT * FROM loc WHERE why IS NULL), a AS {answers_sql("good")}, found AS (
  SELECT loc.question_id, loc.provision_id, a.status, a.version_id, coalesce(why, a.reason) AS reason, quote FROM loc LEFT JOIN a USING (question_id))"""


def _citations(spark, sf_dir):
    """Citations in other spellings of the number, some of documents or articles that there are not, most with a quotation."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    number = F.when(F.col("doc_id") % 17 == 0, "none").otherwise(F.expr("concat(doc_id div 12, ' - 2019 - nd.cp')"))
    quote = F.when(F.col("doc_id") % 4 != 1, F.when(F.col("doc_id") % 9 == 0, "khác hẳn").otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit(" thêm"))))
    c = d.select(F.col("doc_id").alias("question_id"), number.alias("document_number"), (F.col("doc_id") % 6 + 1).alias("article"), quote.alias("quote"))
    return c.join(law_questions(spark, sf_dir).drop("provision_id"), "question_id")


@query(f"WITH {CITED_SQL} SELECT question_id, provision_id, status, version_id, reason FROM found")
def usecase_lookup_by_citation(spark, sf_dir):
    return service.lookup_by_citation(_citations(spark, sf_dir), law(spark, sf_dir)).select("question_id", "provision_id", "status", "version_id", "reason")


@query(f"""
WITH {CITED_SQL}, t AS (
  SELECT found.*, regexp_extract_all(lower(quote), '[\\p{{L}}\\p{{N}}]+') AS x, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS y FROM found LEFT JOIN lawh USING (version_id)
), x AS (SELECT question_id, w, count(*) AS n FROM (SELECT question_id, unnest(x) AS w FROM t) GROUP BY ALL), y AS (SELECT question_id, w, count(*) AS n FROM (SELECT question_id, unnest(y) AS w FROM t) GROUP BY ALL
), b AS (SELECT question_id, CAST(sum(least(x.n, y.n)) AS BIGINT) AS common FROM x JOIN y USING (question_id, w) GROUP BY 1
), s AS (SELECT t.*, CASE WHEN t.status = 'resolved' AND quote IS NOT NULL THEN CASE WHEN len(x) + len(y) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(common, 0) / (len(x) + len(y)) END END AS sim FROM t LEFT JOIN b USING (question_id))
SELECT question_id, coalesce(status = 'resolved', false) OR coalesce(reason = 'ARTICLE_AMBIGUOUS', false) OR coalesce(status = 'unknown', false) AS "exists", coalesce(status = 'resolved', false) AS in_force, version_id,
  floor(sim * 1000 + 0.5) / 1000 AS similarity, CASE WHEN sim IS NULL THEN 'not_checked' WHEN sim >= 0.995 THEN 'exact' WHEN sim >= 0.9 THEN 'close' ELSE 'different' END AS band, reason FROM s""")
def usecase_check_citation(spark, sf_dir):
    return service.check_citation(_citations(spark, sf_dir), law(spark, sf_dir)).withColumn("similarity", text.round_half_up(F.col("similarity")))


SEARCH_AT = ("DATE '2013-06-01'", "TIMESTAMP '2014-01-01'")
SEARCH_SQL = f"""{LAW_SQL}, el AS (
  SELECT *, concat_ws(' ', heading, heading, text) AS full_text FROM lawh WHERE served AND valid_from <= {SEARCH_AT[0]} AND (valid_to IS NULL OR valid_to > {SEARCH_AT[0]}) AND known_from <= {SEARCH_AT[1]}
), k AS (SELECT version_id, {KEPT_SQL.format("full_text")} AS kept FROM el), t AS (SELECT version_id, {TOKENS_SQL} AS t FROM k), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t
), p AS (SELECT version_id, len(t) AS len, unnest(t) AS term FROM t), h AS (SELECT version_id, len, term, count(*) AS tf FROM p GROUP BY ALL
), qt AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT -1, 'zzzz qqqq'), qk AS (SELECT query_id, {KEPT_SQL.format("coalesce(text, '')")} AS kept FROM qt
), q AS (SELECT query_id, unnest(list_distinct({TOKENS_SQL})) AS term FROM qk
), df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM h, st GROUP BY term, n
), ce AS (SELECT query_id, sum(idf) * 2.2 AS ceiling FROM q JOIN df USING (term) GROUP BY 1
), s AS (SELECT query_id, version_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / greatest(mean, 1)))) AS raw FROM q JOIN df USING (term) JOIN h USING (term), st GROUP BY 1, 2
), r AS (SELECT query_id, version_id, raw / ceiling AS x, row_number() OVER (PARTITION BY query_id ORDER BY round(raw / ceiling, 12) DESC, version_id) AS rank FROM s JOIN ce USING (query_id) WHERE raw / ceiling >= 0.15
), hit AS (SELECT query_id, rank, floor(x * 1000 + 0.5) / 1000 AS score, version_id, provision_id, heading, text, kept FROM r JOIN el USING (version_id) JOIN qk USING (query_id) WHERE rank <= 8)"""


def _search(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    q = q.union(spark.sql("SELECT -1L, 'zzzz qqqq'"))
    at, known = (F.expr(x.replace("TIMESTAMP", "timestamp_ntz")) for x in SEARCH_AT)
    return service.search_provisions(q, law(spark, sf_dir), at, known, store=stored)


@query(f"""
WITH {SEARCH_SQL}, ls AS (SELECT query_id, version_id, kept, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM hit
), lh AS (SELECT *, len(list_filter(list_distinct(kept), lambda w: contains({FOLD_SQL.format("line")}, w))) AS hits FROM ls
), best AS (SELECT *, row_number() OVER (PARTITION BY query_id, version_id ORDER BY hits DESC, no) AS b FROM lh)
SELECT query_id, rank, score, version_id, provision_id, heading, CASE WHEN length(line) > 240 THEN substr(line, 1, 237) || '…' ELSE line END AS snippet FROM hit JOIN best USING (query_id, version_id) WHERE b = 1""")
def usecase_search(spark, sf_dir):
    return _search(spark, sf_dir)[0].withColumn("rank", F.col("rank").cast("long"))


@query(f"""
WITH {SEARCH_SQL} SELECT query_id, n = 0 AS corpus_empty, n > 0 AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.query_id = qt.query_id) AS nothing_relevant FROM qt, st""")
def usecase_search_flags(spark, sf_dir):
    return _search(spark, sf_dir)[1]


@query(f"""
WITH {LAW_SQL}, pr AS (SELECT doc_id AS question_id, 'pv_' || doc_id AS f, 'pv_' || CASE WHEN doc_id % 11 = 0 THEN -1 WHEN doc_id % 16 = 0 THEN doc_id + 12 ELSE doc_id + 1 END AS t FROM documents
), e AS (
  SELECT question_id, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y, CASE WHEN a.version_id IS NULL OR b.version_id IS NULL THEN 'VERSION_NOT_FOUND' WHEN NOT a.served OR NOT b.served THEN 'VERSION_NOT_SERVABLE'
    WHEN a.provision_id <> b.provision_id THEN 'DIFFERENT_PROVISIONS' WHEN greatest(len(x), len(y)) > 2000 THEN 'TOO_LONG' END AS error
  FROM pr LEFT JOIN lawh a ON f = a.version_id LEFT JOIN lawh b ON t = b.version_id)
SELECT question_id, error, CASE WHEN error IS NULL THEN x <> y END AS changed, CASE WHEN error IS NULL THEN CAST(len(y) - len(x) AS INTEGER) END AS growth FROM e""")
def usecase_compare_versions(spark, sf_dir):
    other = F.when(F.col("doc_id") % 11 == 0, -1).when(F.col("doc_id") % 16 == 0, F.col("doc_id") + 12).otherwise(F.col("doc_id") + 1)
    pairs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.concat(F.lit("pv_"), "doc_id").alias("from_id"), F.concat(F.lit("pv_"), other).alias("to_id"))
    counts = compare.chunk_counts(F.col("chunks"))
    return service.compare_versions(pairs, law(spark, sf_dir)).select("question_id", "error", "changed", (counts["added"] - counts["removed"]).alias("growth"))


@query(f"""
WITH {LAW_SQL}
SELECT document_id, provision_id, arg_min(heading, doc_id) AS heading, string_agg(version_id || ':' || status, ' ' ORDER BY valid_from, doc_id) AS versions FROM lawh GROUP BY 1, 2""")
def usecase_catalog(spark, sf_dir):
    p = service.get_catalog(law(spark, sf_dir)).select("document_id", F.explode("provisions").alias("p"))
    return p.select("document_id", "p.provision_id", "p.heading", F.array_join(F.transform("p.versions", lambda v: F.concat_ws(":", v["version_id"], v["status"])), " ").alias("versions"))


@query("""
WITH edge AS (SELECT 'amd_' || doc_id AS edge_id, doc_id // 3 AS s, doc_id * 31 % 997 // 3 AS t FROM documents WHERE doc_id % 3 <> 0
), f AS (SELECT DISTINCT doc_id AS question_id, edge_id, s FROM documents JOIN edge ON doc_id = s OR doc_id = t
), g AS (SELECT question_id, e.edge_id FROM f JOIN edge e ON e.s = f.s OR e.t = f.s)
SELECT question_id, edge_id, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT question_id, edge_id, 1 AS depth FROM f UNION ALL SELECT question_id, edge_id, 2 FROM g) GROUP BY 1, 2""")
def usecase_trace_amendments(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    edges = d.select(F.concat(F.lit("amd_"), "doc_id").alias("edge_id"), F.expr("concat('prov_', doc_id div 3)").alias("source_id"), F.expr("concat('prov_', doc_id * 31 % 997 div 3)").alias("target_id"), F.when(F.col("doc_id") % 3 == 0, "under_review").otherwise("verified").alias("status"))
    return service.trace_amendments(d.select(F.col("doc_id").alias("question_id"), F.concat(F.lit("prov_"), "doc_id").alias("provision_id")), edges, 2)


@query(f"""
WITH {LAW_SQL}, a0 AS {answers_sql("asked")}, a AS (SELECT question_id, valid_at, known_at, v.* FROM a0 JOIN lawh v USING (version_id)
), sp AS (
  SELECT question_id, valid_at, known_at, doc_id % 5 AS r, doc_id, g, provision_id, version_id, CASE doc_id % 5 WHEN 0 THEN g WHEN 1 THEN doc_id % 50 END AS tg, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS ta FROM a
), tgt AS (SELECT question_id, count(DISTINCT v.provision_id) AS n, min(v.provision_id) AS target FROM sp JOIN lawh v ON v.g = tg AND v.article = ta GROUP BY 1
), e AS (SELECT sp.*, CASE WHEN r = 4 THEN sp.provision_id ELSE target END AS target,
    CASE WHEN r = 2 AND doc_id % 2 = 0 AND EXISTS (SELECT 1 FROM lawh WHERE lawh.g = 1) THEN 'UNSUPPORTED' WHEN r IN (2, 3) OR (r < 2 AND n IS NULL) THEN 'NOT_IN_CORPUS' WHEN r < 2 AND n > 1 THEN 'AMBIGUOUS' END AS early FROM sp LEFT JOIN tgt USING (question_id)
), aq AS (SELECT question_id, target AS provision_id, valid_at, known_at FROM e WHERE early IS NULL), an AS {answers_sql("aq")}
SELECT question_id || '#0' AS span_id, ['same_document', 'numbered_document', 'numbered_document', 'named_document', 'same_document'][r + 1] AS kind, CASE WHEN early IS NULL THEN target END AS target_provision_id, an.version_id AS target_version_id,
  coalesce(early, CASE an.status WHEN 'conflict' THEN 'AMBIGUOUS' WHEN 'unknown' THEN 'NOT_IN_FORCE_AT_DATE' END) AS reason FROM e LEFT JOIN an USING (question_id)""")
def usecase_references(spark, sf_dir):
    v = law(spark, sf_dir)
    answers = service.provision_at(law_questions(spark, sf_dir), v)
    return service.references_of(answers, v, stored).select("span_id", "kind", "target_provision_id", "target_version_id", "reason")


# ---------------------------------------------------------------- release gates and review


@query(f"""
WITH {LAW_SQL}, am AS (SELECT 'amd_' || doc_id AS locator, doc_id // 3 * 2 AS t, doc_id % 3 = 0 AS ok FROM documents)
SELECT version_id AS locator, 'NOT_SERVABLE' AS issue FROM lawh WHERE NOT served
UNION ALL SELECT version_id, 'TEXT_HASH_MISMATCH' FROM lawh WHERE doc_id % 13 = 0
UNION ALL SELECT version_id, 'HOST_NOT_ALLOWED' FROM lawh WHERE doc_id % 10 = 0
UNION ALL SELECT version_id, 'RETRIEVED_IN_FUTURE' FROM lawh WHERE doc_id % 19 = 0
UNION ALL SELECT greatest(a.version_id, b.version_id), 'OVERLAPPING_VERSIONS' FROM lawh a JOIN lawh b ON a.provision_id = b.provision_id AND a.doc_id < b.doc_id AND (a.valid_to IS NULL OR b.valid_from < a.valid_to) AND (b.valid_to IS NULL OR a.valid_from < b.valid_to)
UNION ALL SELECT 'cond_' || doc_id, 'APPLICABILITY_NOT_VERIFIED' FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT locator, 'AMENDMENT_NOT_VERIFIED' FROM am WHERE NOT ok
UNION ALL SELECT locator, 'TARGET_NOT_IN_RELEASE' FROM am WHERE t NOT IN (SELECT p FROM lawh)""")
def publish_gate(spark, sf_dir):
    v = law(spark, sf_dir)
    v = v.withColumn("text_sha256", F.sha2(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256))
    d = table(spark, sf_dir, "documents").select("doc_id")
    amendments = d.select(F.concat(F.lit("amd_"), "doc_id").alias("amendment_id"), F.expr("concat('prov_', doc_id div 3 * 2)").alias("target_id"), F.when(F.col("doc_id") % 3 == 0, "verified").otherwise("under_review").alias("status"))
    conditions = d.select(F.concat(F.lit("cond_"), "doc_id").alias("condition_id"), F.when(F.col("doc_id") % 2 == 0, "under_review").otherwise("verified").alias("status"))
    return quality.publish_issues(v, amendments, conditions, "2026-01-01T00:00:00.000Z", ["example.org"])


@query(f"""
WITH {LAW_SQL}, k AS (SELECT version_id, row_number() OVER (ORDER BY doc_id)::HUGEINT AS k FROM lawh WHERE status = 'machine_checked'), a AS (
  SELECT version_id, ((1 + k * 1831565813) % 4294967296)::UBIGINT AS s FROM k
), b AS (SELECT version_id, s, ((xor(s, s >> 15)::HUGEINT * (s | 1)::HUGEINT) % 4294967296)::UBIGINT AS v FROM a
), c AS (SELECT version_id, xor(v, ((v::HUGEINT + (xor(v, v >> 7)::HUGEINT * (v | 61)::HUGEINT) % 4294967296) % 4294967296)::UBIGINT) AS v FROM b)
SELECT version_id, 'sampled' AS queue FROM c WHERE xor(v, v >> 14)::DOUBLE / 4294967296.0 < 0.05
UNION ALL SELECT version_id, 'must_read' FROM lawh WHERE NOT served""")
def review_queue(spark, sf_dir):
    return quality.review_queue(law(spark, sf_dir)).select("version_id", "queue")


@query(f"""
WITH {LAW_SQL} SELECT version_id, heading, CASE WHEN version_id = 'pv_2' THEN 'verified' ELSE status END AS status, (SELECT count(*) FROM lawh WHERE NOT served) - 1 AS awaiting_review FROM lawh""")
def promote_and_list(spark, sf_dir):
    """One record becomes verified; then all records with the count of those that still await review."""
    promoted, _ = quality.promote(law(spark, sf_dir), "pv_2", "reviewer", "2026-01-01T00:00:00.000Z")
    listed, awaiting = quality.review_list(promoted)
    return listed.crossJoin(F.broadcast(awaiting))  # one row of awaiting


# ---------------------------------------------------------------- gazette pages


@query(f"WITH {GAZETTE_SQL} SELECT doc_id, CAST(ord AS INTEGER) AS ord, part, article, sha256(text) AS text_sha256 FROM gz")
def gazette_parts(spark, sf_dir):
    parts, _ = extract.segment_gazette(gazette_lines(spark, sf_dir))
    return parts.select("doc_id", "ord", "part", F.col("article").cast("int").alias("article"), F.sha2("text", 256).alias("text_sha256"))


@query("SELECT doc_id, CAST(2 AS BIGINT) AS n_articles, CASE WHEN doc_id % 7 = 0 THEN 'ARTICLES_NOT_CONTINUOUS' END AS refusal FROM documents")
def gazette_documents(spark, sf_dir):
    _, documents = extract.segment_gazette(gazette_lines(spark, sf_dir))
    return documents.withColumn("n_articles", F.col("n_articles").cast("long"))


@query(f"""
WITH {GAZETTE_SQL}, {GAZETTE_REF_SQL}, b AS (SELECT doc_id, article, doc_id || CASE WHEN doc_id % 6 = 0 THEN '2027' ELSE '2026' END || 'ttbca' AS slug, effective_from, text, ord FROM gz JOIN ref USING (doc_id) WHERE part = 'article' AND doc_id % 7 <> 0)
SELECT doc_id, CAST(article AS BIGINT) AS article, 'prov_congbao_' || slug || '_d' || article AS provision_id, 'pv_congbao_' || slug || '_d' || article || '_e' || replace(effective_from, '-', '') AS version_id,
  arg_min(text, ord) AS heading, sha256(string_agg(text, chr(10) ORDER BY ord)) AS text_sha256, effective_from AS valid_from FROM b GROUP BY doc_id, article, slug, effective_from""")
def gazette_provisions(spark, sf_dir):
    parts, documents = extract.segment_gazette(gazette_lines(spark, sf_dir))
    out = extract.gazette_provisions(parts, documents, gazette_references(spark, sf_dir))
    return out.select("doc_id", "article", "provision_id", "version_id", "heading", F.sha2("text", 256).alias("text_sha256"), "valid_from")


@query(f"""
WITH {GAZETTE_SQL}, l AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, trim(regexp_replace(text, '[\\s\\x{{00A0}}\\x{{FEFF}}]+', ' ', 'g')) AS line, part, article FROM gz
), kept AS (SELECT doc_id, line FROM l WHERE part = 'article' AND doc_id % 7 <> 0
), j AS (SELECT doc_id, trim(regexp_replace(string_agg(text, chr(10) ORDER BY ord), '[\\s\\x{{00A0}}\\x{{FEFF}}]+', ' ', 'g')) AS t FROM gz WHERE part = 'article' AND doc_id % 7 <> 0 GROUP BY 1)
SELECT l.doc_id, ord, line FROM l LEFT JOIN j USING (doc_id) WHERE line <> '' AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = l.doc_id AND k.line = l.line) AND NOT coalesce(contains(t, line), false)""")
def gazette_coverage(spark, sf_dir):
    """Lines of the pages that no provision has: all that is not an article's, and every line of a refused document."""
    lines = gazette_lines(spark, sf_dir)
    parts, documents = extract.segment_gazette(lines, lambda t: stored(t, "parts"))
    provisions = stored(extract.gazette_provisions(parts, documents, gazette_references(spark, sf_dir)), "provisions")
    return quality.coverage(lines.select("doc_id", "ord", "text"), provisions.select("doc_id", "heading", "text", F.col("article").alias("ord")))


CHECKS_SQL = f"""{GAZETTE_REF_SQL}, n AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS n FROM documents
), cs AS (
  SELECT doc_id, 'DOCUMENT_NUMBER' AS "check", CASE WHEN doc_id % 6 = 0 THEN 'flag' ELSE 'pass' END AS status FROM documents
  UNION ALL SELECT doc_id, 'ISSUE_DATE', CASE WHEN doc_id % 8 = 0 THEN 'flag' ELSE 'pass' END FROM documents
  UNION ALL SELECT doc_id, 'EFFECTIVE_DATE', CASE WHEN doc_id % 9 = 1 THEN 'not_available' WHEN doc_id % 9 = 0 THEN CASE WHEN effective_from = issued_on THEN 'pass' ELSE 'flag' END WHEN effective_from = '2026-07-01' THEN 'pass' ELSE 'flag' END FROM ref
  UNION ALL SELECT doc_id, 'NUMBERING', CASE WHEN doc_id % 5 = 0 OR doc_id % 11 = 0 THEN 'flag' ELSE 'pass' END FROM documents
  UNION ALL SELECT doc_id, 'SECOND_EXTRACTOR', CASE WHEN doc_id % 3 = 0 THEN 'not_available' WHEN doc_id % 3 = 1 THEN CASE WHEN 2.0 * n / (2 * n + 1) >= 0.97 THEN 'pass' ELSE 'flag' END WHEN n = 0 THEN 'pass' ELSE 'flag' END FROM n)"""


def _cross_checks(spark, sf_dir):
    """Results of the checks on the gazette pages. Numbering is checked on the second article, whose lines have it."""
    ref = gazette_references(spark, sf_dir)
    parts, _ = extract.segment_gazette(gazette_lines(spark, sf_dir), lambda t: stored(t.filter("part in ('preamble', 'article')"), "parts"))
    preamble = parts.filter("part = 'preamble'")
    body = parts.filter("part = 'article'")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    second = F.when(F.col("doc_id") % 3 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit(" zzzz"))).when(F.col("doc_id") % 3 == 2, "--")
    out = quality.check_number(preamble, ref).union(quality.check_issue_date(preamble, ref)).union(quality.check_effective_date(body, ref))
    out = out.union(quality.check_numbering(body.filter("article > 1"), ref))
    return out.union(quality.check_second_reading(texts.withColumn("second", second)))


@query(f'WITH {CHECKS_SQL} SELECT doc_id, "check", status FROM cs')
def cross_checks(spark, sf_dir):
    return _cross_checks(spark, sf_dir)


@query(f"""
WITH {CHECKS_SQL}, r AS (SELECT doc_id, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (WHERE status = 'flag'), '') AS flagged, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (WHERE status = 'not_available'), '') AS not_available, bool_and(status = 'pass') AS all_passed FROM cs GROUP BY 1)
SELECT doc_id, flagged, not_available, all_passed, CASE WHEN doc_id % 4 = 0 THEN 'verified' WHEN all_passed OR doc_id % 4 = 1 THEN 'machine_checked' WHEN doc_id % 4 = 2 THEN 'under_review' ELSE 'unverified' END AS status FROM r""")
def cross_check_rollup(spark, sf_dir):
    rolled = stored(quality.roll_up(_cross_checks(spark, sf_dir)), "checks")
    marked = quality.mark_machine_checked(law(spark, sf_dir).select("doc_id", "status"), rolled)
    return rolled.join(marked, "doc_id").select("doc_id", F.array_join("flagged", ",").alias("flagged"), F.array_join("not_available", ",").alias("not_available"), "all_passed", "status")


@query(f"""
WITH {GAZETTE_SQL}, l AS (SELECT doc_id, article, ord, CAST(TRY_CAST(nullif(regexp_extract(text, '^[ \\t\\n\\x0B\\f\\r]*([0-9]+)[.](?:[^0-9]|$)', 1), '') AS INTEGER) AS BIGINT) AS clause,
    nullif(regexp_extract(text, '^[ \\t\\n\\x0B\\f\\r]*([a-zđ])[)]', 1), '') AS point FROM gz WHERE part = 'article' AND doc_id IS NOT NULL
), n AS (SELECT *, strpos('{quality.POINT_LETTERS}', point) AS place, count(clause) OVER (PARTITION BY doc_id, article ORDER BY ord ROWS UNBOUNDED PRECEDING) AS grp FROM l
), c AS (SELECT doc_id, clause, coalesce(lag(clause) OVER (PARTITION BY doc_id, article ORDER BY ord) + 1, 1) AS e FROM n WHERE clause IS NOT NULL
), p AS (SELECT doc_id, point, place, coalesce(lag(place) OVER (PARTITION BY doc_id, article, grp ORDER BY ord) + 1, 1) AS e FROM n WHERE clause IS NULL AND point IS NOT NULL)
SELECT doc_id, CAST(e AS VARCHAR) AS expected, CAST(clause AS VARCHAR) AS found FROM c WHERE clause <> e UNION ALL SELECT doc_id, substr('{quality.POINT_LETTERS}', e, 1), point FROM p WHERE place <> e""")
def numbering_breaks(spark, sf_dir):
    """Breaks in all articles: the first has the whole text of its document."""
    parts, _ = extract.segment_gazette(gazette_lines(spark, sf_dir))
    return quality.numbering_breaks(parts.filter("part = 'article'")).select("doc_id", "expected", "found")


@query("""
SELECT 'cond_pv_' || doc_id || '_k' || k AS condition_id, 'prov_' || doc_id // 3 AS provision_id, CASE WHEN k = 1 THEN 'Cơ quan nhà nước' ELSE 'một hai ba bốn năm sáu bảy tám' END AS subject, true AS applies, 'under_review' AS status
FROM documents, (VALUES (1), (2)) t(k) WHERE doc_id % 2 = 0 AND doc_id % 5 <> 0
UNION ALL SELECT NULL, 'prov_' || doc_id // 3, 'pv_' || doc_id, NULL, NULL FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 = 0""")
def applicability(spark, sf_dir):
    """Conditions of every second text, headed and numbered so; of the provisions without any, the version's id as subject."""
    lines = F.when(F.col("doc_id") % 5 != 0, "1. Cơ quan nhà nước;\n2) một hai ba bốn năm sáu bảy tám chín mười.").otherwise("không đánh số")
    v = law(spark, sf_dir).withColumn("heading", F.when(F.col("doc_id") % 2 == 0, "Điều 2. Đối tượng áp dụng").otherwise(F.col("heading"))).withColumn("text", F.concat_ws("\n", "heading", "text", lines))
    conditions, without = extract.propose_applicability(v)
    none = without.select(F.lit(None).cast("string").alias("condition_id"), "provision_id", F.col("version_id").alias("subject"), F.lit(None).cast("boolean").alias("applies"), F.lit(None).cast("string").alias("status"))
    return conditions.drop("condition").unionByName(none)


# ---------------------------------------------------------------- scalar functions


@query("""
WITH h AS (SELECT doc_id, doc_id % 6 AS r, CAST(doc_id % 90 + 1 AS BIGINT) AS n FROM documents)
SELECT doc_id, CASE WHEN r IN (0, 1, 4) THEN n END AS heading_no, CASE WHEN r < 5 THEN n END AS own_no, CASE WHEN r IN (0, 4) THEN n END AS gazette_no, CASE WHEN r = 4 THEN n + 2 END AS referenced_no FROM h""")
def article_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 90 + 1).alias("n"), (F.col("doc_id") % 6).alias("r"))
    own = F.concat(F.lit("Điều "), "n")
    h = F.when(F.col("r") == 0, F.concat(own, F.lit(". "), "text")).when(F.col("r") == 1, own).when(F.col("r") == 2, F.concat(F.lit("  "), own, F.lit(". "), "text")).when(F.col("r") == 3, F.concat(own, F.lit("a")))
    h = h.when(F.col("r") == 4, F.concat(own, F.lit(" : Sửa đổi Điều 1 và Điều "), F.col("n") + 2, F.lit(" "), "text")).otherwise(F.col("text"))
    d = d.withColumn("h", h)
    return d.select("doc_id", *[f(F.col("h")).alias(name) for name, f in (("heading_no", text.heading_article_number), ("own_no", text.own_article_number), ("gazette_no", text.gazette_article_number), ("referenced_no", text.referenced_article_number))])


@query("""
WITH d AS (SELECT doc_id, '20' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 31 + 1 AS VARCHAR), 2, '0') AS iso FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN iso END AS spoken, iso AS day_month_year, CASE WHEN doc_id % 2 = 0 THEN iso END AS date_part, try_cast(iso AS DATE) IS NOT NULL AS is_date, try_cast(iso AS DATE) IS NOT NULL AND doc_id % 3 > 0 AS is_instant FROM d""")
def date_texts(spark, sf_dir):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 31 + 1).alias("d"), (F.col("doc_id") % 12 + 1).alias("m"), F.concat(F.lit("20"), two(F.col("doc_id") % 30)).alias("y"))
    spoken = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Hà Nội, ngày "), "d", F.lit(" tháng "), "m", F.lit(" năm "), "y"))
    spoken = spoken.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("NGÀY "), "d", F.lit("/"), "m", F.lit("/"), "y")).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("ngày "), "d", F.lit("-"), "m", F.lit("-"), "y")).otherwise("01/07/2026")
    iso = F.concat_ws("-", "y", two(F.col("m")), two(F.col("d")))
    instant = F.concat(iso, F.when(F.col("doc_id") % 3 == 0, "T24:00:00.000Z").otherwise("T23:59:59.999Z"))
    return d.select(
        "doc_id", text.iso_from_spoken_date(F.concat_ws("\n", "text", spoken)).alias("spoken"), text.iso_from_day_month_year(F.concat(F.lit(" "), F.concat_ws("/", "d", "m", "y"), F.lit(" "))).alias("day_month_year"),
        text.date_part(F.when(F.col("doc_id") % 2 == 0, instant).otherwise("2026")).alias("date_part"), checks.is_date(iso).alias("is_date"), checks.is_instant(instant).alias("is_instant"),
    )


WS_SQL = r"[\s\x{00A0}\x{FEFF}]+"


@query(f"""
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), 'ß', 'ss') || chr(160) || ' ' || doc_id || '.' AS t FROM documents)
SELECT doc_id, sha256(upper(regexp_replace(t, '{WS_SQL}', '', 'g'))) AS compact, sha256(trim(regexp_replace(t, '{WS_SQL}', ' ', 'g'))) AS collapsed, sha256(trim(regexp_replace(t, '[ \\t\\x{{00A0}}]+', ' ', 'g'))) AS line,
  sha256(regexp_replace(t, '[0-9]+', '#', 'g')) AS running, sha256(upper(regexp_replace(strip_accents(replace(replace(t, 'đ', 'd'), 'Đ', 'D')), '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS key,
  CASE WHEN left(regexp_replace(lower(t), '[^a-z0-9]', '', 'g'), 40) = '' THEN 'vanban' ELSE left(regexp_replace(lower(t), '[^a-z0-9]', '', 'g'), 40) END AS slug,
  array_to_string(regexp_split_to_array(regexp_replace(t, '[.;]$', ''), '{WS_SQL}')[1:8], ' ') AS subject FROM d""")
def text_keys(spark, sf_dir):
    t = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("ß"), F.lit("ss")), F.lit("\u00a0 "), "doc_id", F.lit("."))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    digests = (("compact", text.compact), ("collapsed", text.collapse), ("line", text.normalise_line), ("running", text.running_key), ("key", text.citation_key))
    return d.select("doc_id", *[F.sha2(f(F.col("t")), 256).alias(n) for n, f in digests], text.slug(F.col("t")).alias("slug"), text.subject_of(F.col("t")).alias("subject"))


@query("""
SELECT doc_id, doc_id % 4 IN (0, 1) AS tagged, text IS NOT NULL AND doc_id % 3 > 0 AS sha, doc_id % 5 > 1 AS url, doc_id % 6 = 0 AS path, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 90 + 1 AS INTEGER) END AS article, CASE WHEN doc_id % 2 = 0 THEN '2024-05-06' END AS valid_at FROM documents""")
def field_predicates(spark, sf_dir):
    pick = lambda n, *values: F.element_at(F.array(*values), (F.col("doc_id") % n + 1).cast("int"))
    number = F.col("doc_id").cast("string")
    at = text.permanent_citation(F.concat(F.lit("/x/dieu-"), F.col("doc_id") % 90 + 1, F.when(F.col("doc_id") % 2 == 0, "@2024-05-06").otherwise("@2024")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", checks.is_tagged_id(pick(4, F.concat(F.lit("prov_a"), number), F.concat(F.lit("prov_"), number, F.lit("_B-c")), F.concat(F.lit("prov_A"), number), F.concat(F.lit("doc_"), number)), "prov").alias("tagged"),
        checks.is_sha256(pick(3, F.upper(F.sha2("text", 256)), F.sha2("text", 256), F.sha2("text", 256))).alias("sha"),
        checks.is_https_url(pick(5, F.concat(F.lit("http://a.org/"), number), F.lit("https:///x"), F.concat(F.lit("https://a.org/"), number), F.lit("https://a.org"), F.concat(F.lit("https://a.org?q="), number))).alias("url"),
        checks.is_safe_path(pick(6, F.concat(F.lit("a/b"), number), F.lit("a/../b"), F.lit("/a"), F.lit("a\\b"), F.lit("C:/a"), F.lit("a//b"))).alias("path"), at["article"].alias("article"), at["valid_at"].alias("valid_at"),
    )


@query(f"""
WITH d AS (SELECT doc_id, nfc_normalize(replace(coalesce(text, ''), 'ß', 'ss')) || ' Điều ' || (doc_id % 90 + 1) || '. Đối tượng é' AS t FROM documents)
SELECT doc_id, sha256(t) AS nfc, sha256(upper(regexp_replace(t, '{WS_SQL}', '', 'g'))) AS compact, sha256(trim(regexp_replace(t, '[ \\t\\x{{00A0}}]+', ' ', 'g'))) AS line,
  CASE WHEN left(regexp_replace(lower(t), '[^a-z0-9]', '', 'g'), 40) = '' THEN 'vanban' ELSE left(regexp_replace(lower(t), '[^a-z0-9]', '', 'g'), 40) END AS slug, doc_id % 90 + 1 AS heading_no, 1.0::DOUBLE AS similarity FROM d""")
def normal_forms(spark, sf_dir):
    """Keys, lines, numbers and similarities of whole texts, of which every third is spelled with separate marks."""
    whole = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("ß"), F.lit("ss")), F.lit(" Điều "), F.col("doc_id") % 90 + 1, F.lit(". Đối tượng é"))
    d = bounded_batches(table(spark, sf_dir, "documents")).select("doc_id", whole.alias("t"))
    d = d.withColumn("apart", F.when(F.col("doc_id") % 3 == 0, text.nfd(F.when(F.col("doc_id") % 3 == 0, F.col("t")))).otherwise(F.col("t")))
    heading = F.regexp_extract("apart", "[^ ]+ [0-9]+[.][^.]*$", 0)
    # composed once: the functions below find by one search each that nothing is left to compose
    d = d.withColumn("composed", text.nfc(F.col("apart")))
    digests = (("nfc", lambda c: c), ("compact", text.compact), ("line", text.normalise_line))
    return d.select("doc_id", *[F.sha2(f(F.col("composed")), 256).alias(n) for n, f in digests], text.slug(F.col("composed")).alias("slug"), text.heading_article_number(heading).alias("heading_no"), compare.dice(F.col("t"), F.col("apart")).alias("similarity"))
