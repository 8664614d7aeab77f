"""Registered queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import checks, text
from tessera.functions.batches import bounded_batches
from tessera.operators import citations, compare, extract, graph, quality, references, search, sets, temporal, text_index
from tessera.plans import derive
from tessera.plans.derive import EDGES_SQL, VERSIONS_SQL, table
from tessera.sources import web
from tessera.streaming import crawl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query of its own name, with its SQL equivalent."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- time


@query(f"""
WITH {VERSIONS_SQL}, q AS (
  SELECT event_id AS question_id, user_id, event_type, ts + INTERVAL 12 HOUR AS valid_at, ts + INTERVAL 60 HOUR AS known_at FROM events
), h AS (
  SELECT q.question_id, count(v.version_id) AS n_all, count(v.version_id) FILTER (WHERE v.status IN ('verified', 'machine_checked')) AS n_good,
    min(v.version_id) FILTER (WHERE v.status IN ('verified', 'machine_checked')) AS one
  FROM q LEFT JOIN ver v ON q.user_id = v.user_id AND q.event_type = v.event_type AND q.valid_at >= v.valid_from
    AND (v.valid_to IS NULL OR q.valid_at < v.valid_to) AND q.known_at >= v.known_from
  GROUP BY q.question_id
)
SELECT question_id, CASE WHEN n_good = 1 THEN 'resolved' WHEN n_good > 1 THEN 'conflict' ELSE 'unknown' END AS status,
  CASE WHEN n_good = 1 THEN one END AS version_id,
  CASE WHEN n_good > 0 THEN NULL WHEN n_all > 0 THEN 'MATCH_ONLY_UNVERIFIED' ELSE 'NO_MATCHING_VERSION' END AS reason,
  CASE WHEN n_good > 0 THEN n_good ELSE n_all END AS n_candidates
FROM h""")
def asof_resolve(spark, sf_dir):
    out = temporal.resolve(derive.questions(spark, sf_dir), derive.event_versions(spark, sf_dir), keys=("user_id", "event_type"))
    return out.select("question_id", "status", "version_id", "reason", F.size("candidates").cast("long").alias("n_candidates"))


@query("""
SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment FROM (
  SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders
) o JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate <= TIMESTAMP '1996-07-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-07-01')""")
def asof_orders_snapshot(spark, sf_dir):
    o = temporal.versions_by_succession(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate")
    at = temporal.snapshot(o, F.lit("1996-07-01").cast("timestamp_ntz"))
    return at.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_totalprice", "c_mktsegment")


@query(f"""
WITH {VERSIONS_SQL}
SELECT a.user_id, a.event_type, a.version_id AS first_id, b.version_id AS second_id FROM ver a JOIN ver b
ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.version_id < b.version_id
AND (b.valid_to IS NULL OR a.valid_from < b.valid_to) AND (a.valid_to IS NULL OR b.valid_from < a.valid_to)""")
def bitemporal_conflicts(spark, sf_dir):
    return temporal.collisions(derive.event_versions(spark, sf_dir), ("user_id", "event_type"))


@query(f"""
WITH {VERSIONS_SQL}
SELECT count(*) FILTER (WHERE valid_to IS NOT NULL AND valid_from >= valid_to) AS empty_intervals, count(*) FILTER (WHERE valid_to IS NULL) AS open_intervals,
  count(*) FILTER (WHERE status IN ('verified', 'machine_checked')) AS servable FROM ver""")
def interval_audit(spark, sf_dir):
    v = derive.event_versions(spark, sf_dir)
    return v.agg(F.count_if(~checks.valid_interval(F.col("valid_from"), F.col("valid_to"))).alias("empty_intervals"), F.count_if(F.col("valid_to").isNull()).alias("open_intervals"), F.count_if(checks.servable(F.col("status"))).alias("servable"))


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS document_id, o_orderpriority AS provision_id, count(*) AS n_versions, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_version
FROM orders GROUP BY 1, 2""")
def catalog_nested(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = o.select(F.col("o_custkey").cast("string").alias("document_id"), F.col("o_orderpriority").alias("provision_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("ord"), F.lit(None).cast("string").alias("heading"))
    p = temporal.catalog(v).select("document_id", F.explode("provisions").alias("p"))
    return p.select("document_id", "p.provision_id", F.size("p.versions").cast("long").alias("n_versions"), F.col("p.versions")[0]["version_id"].alias("first_version"))


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'F')""")
def fk_orphans(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey")
    return checks.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), parents, "l_orderkey", "o_orderkey")


@query("""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, occurrence FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS occurrence FROM lineitem) WHERE occurrence > 1""")
def dup_ids(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return checks.repeated(li, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]).withColumn("occurrence", F.col("occurrence").cast("long"))


@query("""
SELECT l_orderkey, expected, CAST(l_linenumber AS BIGINT) AS found FROM (
  SELECT l_orderkey, l_linenumber, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 1, 1) AS expected
  FROM lineitem) WHERE l_linenumber <> expected""")
def seq_gaps(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return temporal.gaps(li, ["l_orderkey"], "l_linenumber")


# ---------------------------------------------------------------- sets


@query("""
SELECT key AS doc_id, CASE WHEN n IS NULL THEN 'MISSING' WHEN w IS NULL THEN 'ADDED' ELSE 'CHANGED' END AS drift FROM (
  SELECT coalesce(a.doc_id, b.doc_id) AS key, sha256(a.text) AS w, b.h AS n FROM documents a FULL OUTER JOIN (
    SELECT doc_id, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 17 <> 0
    UNION ALL SELECT doc_id + 1000000000, sha256(text) FROM documents WHERE doc_id % 19 = 0) b ON a.doc_id = b.doc_id)
WHERE w IS DISTINCT FROM n""")
def drift_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    now = d.filter("doc_id % 17 <> 0").select("doc_id", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    now = now.union(d.filter("doc_id % 19 = 0").select(F.col("doc_id") + 1_000_000_000, "text"))
    digest = lambda x: x.select("doc_id", F.sha2("text", 256).alias("h"))
    return sets.drift(digest(d), digest(now), "doc_id", "h")


@query("""
SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'MISSING' WHEN doc_id % 7 = 0 THEN 'UNREGISTERED' WHEN doc_id % 5 = 0 THEN 'HASH_MISMATCH' ELSE 'SIZE_MISMATCH' END AS issue
FROM documents WHERE text IS NOT NULL AND ((doc_id % 11 = 0 AND doc_id % 7 <> 0) OR (doc_id % 11 <> 0 AND (doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0)))""")
def manifest_verify(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.length("text").alias("byte_length"))
    manifest = d.filter("doc_id % 7 <> 0")
    actual = d.filter("doc_id % 11 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("sha256"))).withColumn("byte_length", F.col("byte_length") + (F.col("doc_id") % 3 == 0).cast("int"))
    return sets.verify_manifest(manifest, actual)


@query("""
SELECT o_custkey, min_key AS first_wins, max_key AS last_wins FROM (SELECT o_custkey, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders GROUP BY 1)""")
def merge_drafts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("ord"))
    first = sets.merge_drafts(o, "o_custkey").select("o_custkey", F.col("o_orderkey").alias("first_wins"))
    last = sets.merge_drafts(o, "o_custkey", last_wins=True).select("o_custkey", F.col("o_orderkey").alias("last_wins"))
    return first.join(last, "o_custkey")


@query("""
SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, 'rel_b' AS release_id FROM orders""")
def cumulate_new_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    new = o.filter("o_orderdate >= timestamp_ntz'1997-01-01'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return sets.cumulate(o, new, "o_orderkey", "release_id", "rel_b").drop("o_orderdate")


@query("""
SELECT 'doc' || d.doc_id AS target, CASE WHEN quality = 1 THEN 'verified' ELSE 'machine_checked' END AS status,
  CASE WHEN d.doc_id % 5 = 0 THEN 'UNVOUCHED_RECORD' WHEN (quality = 1) = (d.doc_id % 3 <> 0) THEN 'ok' ELSE 'WRONG_VOUCHER' END AS voucher
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def voucher_check(spark, sf_dir):
    c = derive.corpus(spark, sf_dir).filter("quality is not null")
    records = c.select(F.concat(F.lit("doc"), "doc_id").alias("target"), F.when(F.col("quality") == 1, "verified").otherwise("machine_checked").alias("status"))
    reviews = c.filter("doc_id % 5 <> 0").select(F.concat(F.lit("doc"), "doc_id").alias("target"), F.when(F.col("doc_id") % 3 == 0, "machine").alias("method"))
    return sets.check_vouchers(records, reviews)


@query("""
SELECT source, CASE WHEN bool_or(coalesce(quality, 1) = 0) THEN 'machine_checked' ELSE 'verified' END AS review_state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def release_state(spark, sf_dir):
    c = derive.corpus(spark, sf_dir).withColumn("status", F.when(F.col("quality") == 0, "machine_checked").otherwise("verified"))
    return sets.review_state(c, "source")


@query("""
SELECT source, CASE WHEN bool_or(coalesce(quality, 1) = 0 AND coalesce(toxic, 0) = 1) THEN 'refused' WHEN bool_and(coalesce(quality, 1) = 1) THEN 'clean' ELSE 'needs_review' END AS route, count(*) AS n_records
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def route_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.coalesce("quality", F.lit(1)) == 1
    return sets.route_documents(d.withColumn("p", good).withColumn("r", ~good & (F.coalesce("toxic", F.lit(0)) == 1)), "source", "p", "r")


@query("""
WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id)::HUGEINT AS k FROM documents), a AS (
  SELECT doc_id, ((20240229 + k * 1831565813) % 4294967296)::UBIGINT AS s FROM k
), b AS (SELECT doc_id, s, ((xor(s, s >> 15)::HUGEINT * (s | 1)::HUGEINT) % 4294967296)::UBIGINT AS v FROM a
), c AS (SELECT doc_id, xor(v, ((v::HUGEINT + (xor(v, v >> 7)::HUGEINT * (v | 61)::HUGEINT) % 4294967296) % 4294967296)::UBIGINT) AS v FROM b)
SELECT doc_id, xor(v, v >> 14)::DOUBLE / 4294967296.0 AS u FROM c""")
def seeded_sample(spark, sf_dir):
    # the k-th draw goes to the k-th document: ranks come from counts per id range, not from one sorted task
    d = table(spark, sf_dir, "documents").select("doc_id")
    parts = d.withColumn("part", F.floor(F.col("doc_id") / 10_000))
    from pyspark.sql.window import Window

    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("doc_id"))).join(sizes.select("part", "before"), "part")
    return ranked.select("doc_id", sets.seeded_draws(F.col("r") + F.col("before"), 20240229).alias("u"))


# ---------------------------------------------------------------- text

FOLD_SQL = "lower(strip_accents(replace(replace({0}, 'đ', 'd'), 'Đ', 'D')))"
STOP_SQL = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
KEPT_SQL = f"list_filter(regexp_extract_all({FOLD_SQL}, '[\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP_SQL}))"
TOKENS_SQL = "(CASE WHEN len(kept) > 1 THEN list_concat(kept, list_transform(range(1, len(kept)), lambda i: kept[i] || '_' || kept[i + 1])) ELSE kept END)"


@query(f"""
WITH k AS (SELECT doc_id, {KEPT_SQL.format("coalesce(text, '')")} AS kept FROM documents), t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM k)
SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY term""")
def fold_tokens(spark, sf_dir):
    return search.term_stats(table(spark, sf_dir, "documents"), "text")


@query(f"""
WITH k AS (SELECT d.doc_id, {KEPT_SQL.format("coalesce(text, '')")} AS kept FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1
), t AS (SELECT doc_id, {TOKENS_SQL} AS t FROM k), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t
), p AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM t), h AS (SELECT doc_id, len, term, count(*) AS tf FROM p GROUP BY ALL
), qk AS (SELECT item_id AS query_id, {KEPT_SQL.format("coalesce(text, '')")} AS kept FROM benchmark), q AS (SELECT query_id, unnest(list_distinct({TOKENS_SQL})) AS term FROM qk
), df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM h, st GROUP BY term, n
), ce AS (SELECT query_id, sum(idf) * 2.2 AS ceiling FROM q JOIN df USING (term) GROUP BY 1
), s AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / greatest(mean, 1)))) AS raw FROM q JOIN df USING (term) JOIN h USING (term), st GROUP BY 1, 2
), r AS (SELECT query_id, doc_id, raw / ceiling AS x, row_number() OVER (PARTITION BY query_id ORDER BY round(raw / ceiling, 12) DESC, doc_id) AS rank FROM s JOIN ce USING (query_id) WHERE raw / ceiling >= 0.15)
SELECT query_id, doc_id, floor(x * 1000 + 0.5) / 1000 AS score, rank FROM r WHERE rank <= 8""")
def bm25_topk(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = derive.corpus(spark, sf_dir).filter(checks.servable(F.col("status")))
    return search.bm25(q, docs, "doc_id", "text", store=derive.stored).withColumn("rank", F.col("rank").cast("long"))


@query(ORACLES["bm25_topk"].replace(" JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1", ""))
def bm25_topk_all(spark, sf_dir):
    """All documents, whatever their review state."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.bm25(q, table(spark, sf_dir, "documents"), "doc_id", "text", store=derive.stored).withColumn("rank", F.col("rank").cast("long"))


@query(ORACLES["bm25_topk_all"])
def bm25_topk_indexed(spark, sf_dir):
    """The same from a stored index of two segments."""
    d, path = table(spark, sf_dir, "documents").select("doc_id", "text"), derive.folder(spark, "index")
    for k in (0, 1):
        text_index.add_segment(d.filter(F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0)) == k), path, "doc_id", "text")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return text_index.Index(spark, path).search(q, store=derive.stored).select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS no FROM documents
), h AS (SELECT doc_id, line, no, len(list_filter(['the', 'der', 'que', 'les'], lambda w: contains({FOLD_SQL.format("line")}, w))) AS hits FROM l
), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, no) AS r FROM h)
SELECT doc_id, CAST(hits AS INTEGER) AS hits, CASE WHEN length(line) > 240 THEN substr(line, 1, 237) || '…' ELSE line END AS snippet FROM b WHERE r = 1""")
def snippet_best_line(spark, sf_dir):
    wanted = F.array(*map(F.lit, ("the", "der", "que", "les")))
    return search.best_line(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", wanted).select("doc_id", "hits", "snippet")


@query("""
WITH p AS (SELECT a.conv_id, a.turn, regexp_extract_all(lower(a.text), '[\\p{L}\\p{N}]+') AS x, regexp_extract_all(lower(b.text), '[\\p{L}\\p{N}]+') AS y
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2
), s AS (SELECT conv_id, turn, 2.0 * list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))) / (len(x) + len(y)) AS d FROM p)
SELECT conv_id, turn, floor(coalesce(d, 0) * 1000 + 0.5) / 1000 AS similarity, CASE WHEN d >= 0.995 THEN 'exact' WHEN d >= 0.9 THEN 'close' ELSE 'different' END AS band FROM s""")
def dice_pairs(spark, sf_dir):
    d = bounded_batches(derive.turn_pairs(spark, sf_dir)).withColumn("d", compare.dice(F.col("text"), F.col("later")))
    return d.select("conv_id", "turn", text.round_half_up(F.col("d")).alias("similarity"), text.match_band(F.col("d")).alias("band"))


@query("""
WITH RECURSIVE p AS (SELECT a.conv_id, a.turn, string_split(coalesce(a.text, ''), chr(10)) AS x, string_split(coalesce(b.text, ''), chr(10)) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2
), lcs AS (
  SELECT *, 0 AS i, list_transform(range(0, len(y) + 1), lambda j: 0) AS best FROM p
  UNION ALL
  SELECT conv_id, turn, x, y, i + 1, list_transform(range(0, len(y) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE list_max(t[1:j]) END)
  FROM (SELECT *, list_transform(range(1, len(y) + 1), lambda j: greatest(best[j + 1], CASE WHEN x[i + 1] = y[j] THEN best[j] + 1 ELSE 0 END)) AS t FROM lcs WHERE i < len(x)))
SELECT conv_id, turn, best[len(best)] AS unchanged, CAST(len(x) - best[len(best)] AS INTEGER) AS removed, CAST(len(y) - best[len(best)] AS INTEGER) AS added FROM lcs WHERE i = len(x)""")
def line_diff(spark, sf_dir):
    c = compare.chunk_counts(compare.diff_lines(F.col("text"), F.col("later")))
    return derive.turn_pairs(spark, sf_dir).withColumn("c", c).select("conv_id", "turn", "c.*")


@query("""
WITH q AS (SELECT p_partkey AS question_id, upper(regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g')) AS key, p_size * 7 % 60 + 1 AS article FROM part
), p AS (SELECT DISTINCT upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS key, p_size AS no, p_brand || '/' || p_size AS provision_id FROM part
), f AS (SELECT question_id, count(DISTINCT provision_id) AS n, min(provision_id) AS pid FROM q JOIN p ON q.key = p.key AND q.article = p.no GROUP BY 1)
SELECT question_id, pid AS provision_id, CASE WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.key = q.key) THEN 'DOCUMENT_NOT_IN_CORPUS' WHEN n IS NULL THEN 'ARTICLE_NOT_IN_DOCUMENT' WHEN n > 1 THEN 'ARTICLE_AMBIGUOUS' END AS reason
FROM q LEFT JOIN f USING (question_id)""")
def citation_locate(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    asked = p.select(F.col("p_partkey").alias("question_id"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(" - "))).alias("document_number"), (F.col("p_size") * 7 % 60 + 1).cast("long").alias("article"))
    have = p.select(F.concat_ws("/", "p_brand", "p_size").alias("provision_id"), F.col("p_brand").alias("document_number"), F.concat(F.lit("Điều "), "p_size", F.lit(". x")).alias("heading")).distinct()
    return citations.locate(asked, have).select("question_id", "provision_id", "reason")


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'named_document' WHEN doc_id % 3 = 1 THEN 'numbered_document' ELSE 'same_document' END AS kind,
  CASE WHEN doc_id % 3 = 1 THEN NULL ELSE CAST(doc_id % 50 + 1 AS INTEGER) END AS article, CASE WHEN doc_id % 3 = 1 THEN doc_id || '/2019/NĐ-CP' END AS number FROM documents""")
def reference_spans(spark, sf_dir):
    d = derive.referring(spark, sf_dir)
    spans = references.extract_references(d.withColumn("text", F.concat_ws("\n", "text", "sentence")), "doc_id", "text")
    return spans.select("doc_id", "kind", "article", "number")


@query()
def reference_spans_whole(spark, sf_dir):
    """Positions too, with the sentence in the middle of the text and at its end."""
    half = F.floor(F.length("text") / 2).cast("int")
    middle = F.concat_ws("\n", F.expr("left(text, cast(floor(length(text) / 2) as int))"), "sentence", F.col("text").substr(half + 1, F.length("text")), "sentence")
    spans = references.extract_references(derive.referring(spark, sf_dir).withColumn("text", middle), "doc_id", "text")
    return spans.select("doc_id", "ord", "kind", "span", "start", "end", "article", "clause", "point", "title", "type", "number")


@query("""
SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM (
  SELECT page_id, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', ' ', 'g'), '(?s)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '[\\s\\x{00A0}\\x{FEFF}]+', ' ', 'g')) AS t FROM pages)""")
def page_text(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", text.plain_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


# ---------------------------------------------------------------- graph


@query(f"""
WITH {EDGES_SQL}, q AS (SELECT p_partkey AS question_id, p_partkey + 1000000000 AS pid FROM part
), f AS (SELECT DISTINCT question_id, edge_id, source_id FROM q JOIN edge ON pid = target_id OR pid = source_id
), s AS (SELECT DISTINCT question_id, e.edge_id FROM f JOIN edge e ON e.source_id = f.source_id OR e.target_id = f.source_id)
SELECT question_id, edge_id, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT question_id, edge_id, 1 AS depth FROM f UNION ALL SELECT question_id, edge_id, 2 FROM s) GROUP BY 1, 2""")
def amend_trace_2hop(spark, sf_dir):
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), (F.col("p_partkey") + 1_000_000_000).alias("provision_id"))
    return graph.trace(q, derive.edges(spark, sf_dir), 2)


@query("""
WITH t AS (SELECT p_brand, p_size, min(p_partkey) AS target FROM part GROUP BY 1, 2)
SELECT 'sup_' || s_suppkey AS provision_id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 60 + 1 END AS article, CASE WHEN s_suppkey % 4 <> 0 AND target IS NOT NULL THEN 'prov_' || target END AS target_id,
  CASE WHEN s_suppkey % 4 = 0 THEN 'NO_ARTICLE' WHEN target IS NULL THEN 'NOT_FOUND' ELSE 'linked' END AS status
FROM supplier LEFT JOIN t ON t.p_brand = 'Brand#' || (s_suppkey % 5 + 1) || '1' AND t.p_size = s_suppkey % 60 + 1""")
def link_first_target(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    heading = F.when(F.col("s_suppkey") % 4 == 0, "Điều 1. Điều khoản thi hành").otherwise(F.concat(F.lit("Điều 1. Sửa đổi Điều "), F.col("s_suppkey") % 60 + 1))
    amending = s.select(F.col("s_suppkey").alias("document_id"), F.concat(F.lit("sup_"), "s_suppkey").alias("provision_id"), heading.alias("heading"), F.col("s_suppkey").alias("ord"))
    targets = table(spark, sf_dir, "part").select(F.col("p_brand").alias("document_id"), F.concat(F.lit("prov_"), "p_partkey").alias("provision_id"), F.concat(F.lit("Điều "), "p_size", F.lit(". x")).alias("heading"), F.col("p_partkey").alias("ord"))
    rel = s.select(F.col("s_suppkey").alias("document_id"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 5 + 1, F.lit("1")).alias("target_document_id"), F.lit("amends").alias("relation"), F.lit("2024-01-01").alias("effective_from"))
    return graph.link_amendments(amending, targets, rel).select("provision_id", "article", "target_id", "status")


# ---------------------------------------------------------------- extraction and checks

LINES_SQL = "ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_no FROM documents)"


@query(f"""
WITH {LINES_SQL}, m AS (SELECT *, CASE WHEN length(line) % 7 = 0 THEN line_no WHEN length(line) % 11 = 0 THEN -1 END AS mark FROM ln
), f AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM m)
SELECT doc_id, CASE WHEN s >= 0 THEN s END AS section, count(*) AS n_lines FROM f GROUP BY 1, 2""")
def section_fill(spark, sf_dir):
    lines = extract.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    n = F.length("line")
    return extract.section_fill(lines, "doc_id", "line_no", n % 7 == 0, n % 11 == 0).groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"))


@query(f"""
WITH {LINES_SQL}, p AS (SELECT doc_id, line_no, line, (line_no - 1) // 4 AS page FROM ln
), e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) AS b FROM p
), k AS (SELECT doc_id, regexp_replace(line, '[0-9]+', '#', 'g') AS key, sum((a = 1)::INT + (b = 1)::INT) AS n FROM e WHERE a = 1 OR b = 1 GROUP BY 1, 2
), c AS (SELECT doc_id, count(DISTINCT page) AS pages FROM p GROUP BY 1)
SELECT doc_id, key, CAST(n AS BIGINT) AS n FROM k JOIN c USING (doc_id) WHERE n >= greatest(2, ceil(pages * 0.6))""")
def running_lines(spark, sf_dir):
    lines = extract.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    paged = lines.select("doc_id", F.floor((F.col("line_no") - 1) / 4).alias("page"), F.col("line_no").alias("ord"), F.col("line").alias("text"))
    return extract.running_lines(paged)


@query("""
WITH h AS (SELECT p_brand AS doc_id, p_size AS font_size, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2)
SELECT doc_id, font_size, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1 AS body FROM h""")
def font_mode(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("font_size"), F.col("p_partkey").alias("ord"))
    return extract.font_histogram(lines)


@query(f"""
WITH {LINES_SQL}, src AS (SELECT doc_id, sum(length(line)) AS a FROM ln GROUP BY 1), dst AS (SELECT doc_id, sum(length(line)) AS b FROM ln WHERE line_no % 6 <> 5 GROUP BY 1)
SELECT doc_id, 'CHARACTER_BALANCE' AS check, CASE WHEN a = coalesce(b, 0) THEN 'pass' ELSE 'flag' END AS status FROM src LEFT JOIN dst USING (doc_id)""")
def char_balance(spark, sf_dir):
    lines = extract.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("line", "text")
    return quality.check_balance(lines, lines.filter("line_no % 6 <> 5"))


@query(f"""
WITH {LINES_SQL}, l AS (SELECT doc_id, line_no AS ord, trim(regexp_replace(line, '[\\s\\x{{00A0}}\\x{{FEFF}}]+', ' ', 'g')) AS line FROM ln
), r AS (SELECT doc_id, line, ord FROM l WHERE ord % 3 <> 0), j AS (SELECT doc_id, string_agg(line, ' ' ORDER BY ord) AS t FROM r GROUP BY 1)
SELECT doc_id, ord, line FROM l WHERE line <> '' AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND r.line = l.line)
AND NOT EXISTS (SELECT 1 FROM j WHERE j.doc_id = l.doc_id AND contains(j.t, l.line))""")
def coverage_antijoin(spark, sf_dir):
    lines = extract.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    kept = lines.filter("line_no % 3 <> 0").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("text"))
    return quality.coverage(lines.select("doc_id", F.col("line_no").cast("long").alias("ord"), F.col("line").alias("text")), kept.withColumn("heading", F.lit(None).cast("string")))


@query("""
WITH c AS (
  SELECT doc_id, 'LENGTH' AS k, CASE WHEN n_chars > 1000 THEN 'pass' ELSE 'flag' END AS s FROM documents
  UNION ALL SELECT d.doc_id, 'LABEL', CASE WHEN quality = 1 THEN 'pass' WHEN quality = 0 THEN 'flag' ELSE 'not_available' END FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT c.doc_id, count(*) FILTER (WHERE s = 'flag') AS n_flagged, count(*) FILTER (WHERE s = 'not_available') AS n_missing, bool_and(s = 'pass') AS all_passed,
  CASE WHEN any_value(quality) = 1 THEN 'verified' WHEN bool_and(s = 'pass') THEN 'machine_checked' WHEN any_value(quality) = 0 THEN 'under_review' ELSE 'unverified' END AS status
FROM c LEFT JOIN labels l ON c.doc_id = l.doc_id GROUP BY c.doc_id""")
def quality_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = derive.corpus(spark, sf_dir)
    label = F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "flag").otherwise("not_available")
    results = d.select("doc_id", F.lit("LENGTH").alias("check"), F.when(F.col("n_chars") > 1000, "pass").otherwise("flag").alias("status")).union(c.select("doc_id", F.lit("LABEL"), label))
    rolled = quality.roll_up(results)
    marked = quality.mark_machine_checked(c.select("doc_id", "status"), rolled)
    return rolled.join(marked, "doc_id").select("doc_id", F.size("flagged").cast("long").alias("n_flagged"), F.size("not_available").cast("long").alias("n_missing"), "all_passed", "status")


@query("""
SELECT l_orderkey AS doc_id, 'GAP' AS issue, CAST(g AS BIGINT) AS number FROM (
  SELECT l_orderkey, unnest(range(b + 1, n)) AS g FROM (
    SELECT l_orderkey, l_linenumber AS n, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) AS b
    FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE n > b + 1)
UNION ALL SELECT l_orderkey, 'DUPLICATE', l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS r FROM lineitem) WHERE r > 1""")
def article_issues(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("ord"), F.col("l_linenumber").cast("long").alias("number"))
    return quality.article_issues(li)


# ---------------------------------------------------------------- web and crawling


@query("""
SELECT page_id, ext, host, allowed FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host,
  coalesce(nullif(lower(regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '\\.([A-Za-z0-9]{1,5})$', 1)), ''), 'bin') AS ext,
  regexp_matches(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '(^|\\.)(example\\.com|example\\.org)$') AS allowed FROM pages)""")
def host_allow(spark, sf_dir):
    host = F.try_parse_url("url", F.lit("HOST"))
    return table(spark, sf_dir, "pages").select("page_id", text.extension_for(F.lit(None).cast("string"), F.col("url")).alias("ext"), host.alias("host"), checks.host_allowed(host, ["example.com", "example.org"]).alias("allowed"))


@query("""
WITH a AS (SELECT page_id, url AS base, regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"''#]+)["'']', 1) AS l FROM pages
), u AS (SELECT page_id, base, unnest(l) AS link, unnest(range(1, len(l) + 1)) AS ord FROM a
), o AS (SELECT *, regexp_extract(base, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(base, '^(https?://[^?#]*/)[^/?#]*', 1) AS f FROM u
), r AS (SELECT page_id, base, ord, replace(link, '&amp;', '&') AS link, origin, CASE WHEN length(f) > length(origin) THEN f ELSE origin || '/' END AS folder FROM o
), x AS (SELECT page_id, base, ord, CASE WHEN regexp_matches(link, '(?i)^https?://') THEN link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN link LIKE '//%' THEN regexp_extract(base, '^(https?):', 1) || ':' || link WHEN link LIKE '/%' THEN origin || link ELSE folder || regexp_replace(link, '^\\./', '') END AS url FROM r
), g AS (SELECT page_id, url, min(ord) AS ord FROM x WHERE regexp_extract(url, '^https?://([^/:?#]+)', 1) = regexp_extract(base, '^https?://([^/:?#]+)', 1) GROUP BY 1, 2)
SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS ord FROM g""")
def discover_links(spark, sf_dir):
    return web.discover_links(table(spark, sf_dir, "pages"), "page_id", "url", "html").select("page_id", F.col("ord").cast("long").alias("ord"), "url")


@query("""
SELECT page_id AS request_id, NOT regexp_matches(regexp_replace(url, '#.*$', ''), '[3579]$') AS allowed FROM pages""")
def robots_decision(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("request_id"), F.try_parse_url("url", F.lit("HOST")).alias("host"), F.try_parse_url("url", F.lit("FILE")).alias("path"))
    robots = "User-agent: *\nDisallow: /\n\nUser-agent: tessera\nUser-agent: other\nAllow: /\n" + "".join(f"Disallow: /*{d}$\n" for d in (1, 3, 5, 7, 9)) + "Allow: /*1$ # last digit one\n"
    rules = web.parse_robots(p.select("host").distinct().withColumn("text", F.lit(robots)))
    return web.robots_decision(p, rules, "tessera-bot").select("request_id", "allowed")


@query("""
WITH d AS (SELECT url, min(page_id) AS ord, CASE WHEN min(page_id) % 3 = 0 THEN '2024-01-01' END AS lastmod FROM pages GROUP BY url
), s AS (SELECT url, CASE WHEN min(page_id) % 6 = 0 THEN '2024-01-01' ELSE '2023-01-01' END AS old, sha256(CASE WHEN min(page_id) % 5 = 0 THEN 'x' ELSE min(html) END) AS sha FROM pages WHERE page_id % 4 <> 0 GROUP BY url
), t AS (SELECT d.*, s.old, s.sha, coalesce(d.lastmod = s.old, false) AS same, (SELECT sha256(min(html)) FROM pages p WHERE p.url = d.url) AS now FROM d LEFT JOIN s USING (url)
), r AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY ord, url) AS k FROM t)
SELECT url, ord, CASE WHEN same THEN 'skipped_lastmod' WHEN k > 100 THEN 'skipped_budget' WHEN now = sha THEN 'unchanged' ELSE 'fetched' END AS outcome FROM r""")
def crawl_step(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    first = p.groupBy("url").agg(F.min("page_id").alias("ord"), F.min("html").alias("html"))
    discovered = first.select("url", "ord", F.when(F.col("ord") % 3 == 0, "2024-01-01").alias("lastmod"))
    old = p.filter("page_id % 4 <> 0").groupBy("url").agg(F.min("page_id").alias("k"), F.min("html").alias("html"))
    state = old.select("url", F.lit("2024-01-01T00:00:00.000Z").alias("last_checked_at"), F.lit("2024-01-01T00:00:00.000Z").alias("retrieved_at"), F.when(F.col("k") % 6 == 0, "2024-01-01").otherwise("2023-01-01").alias("lastmod"), F.sha2(F.when(F.col("k") % 5 == 0, F.lit("x")).otherwise(F.col("html")), 256).alias("sha256"))
    fetched = first.select("url", F.sha2("html", 256).alias("sha256"))
    return crawl.crawl_step(discovered, state, fetched, 100, "2024-02-01T00:00:00.000Z")[0]


@query("""
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def events_tumbling(spark, sf_dir):
    return crawl.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour")


@query("""
WITH g AS (SELECT *, CASE WHEN epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts) < 14400 THEN 0 ELSE 1 END AS b FROM (SELECT user_id, ts FROM events)
), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY 1, 2""")
def events_sessions(spark, sf_dir):
    return crawl.sessions(table(spark, sf_dir, "events").select("user_id", "ts"), "ts", "user_id", 14_400).select("user_id", "session", "n")
