"""The use cases: each takes a frame of questions and gives a frame of answers.

Answers never guess: what is missing, ambiguous or not in force comes back as such. Every answer frame has a
row per question, and texts in answers are data from outside: callers should treat them as untrusted.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.checks import citation_of, contains, servable
from tessera.operators import citations, compare, graph, references, search, temporal

#: Bounds of single requests; over them a request is refused, never cut.
MAX_QUERY, MAX_LIMIT, DEFAULT_LIMIT, MAX_ARTICLE, MAX_NUMBER, MAX_QUOTE, MAX_VERSIONS, MAX_RELATIONS = 500, 20, 8, 10_000, 256, 20_000, 256, 256


class QueryError(Exception):
    """A refused request; ``code`` is one of INVALID_INPUT, VERSION_NOT_FOUND, VERSION_NOT_SERVABLE,
    DIFFERENT_PROVISIONS, TOO_MANY_RESULTS."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


#: How codes map to statuses of a web interface.
HTTP_STATUS = {"INVALID_INPUT": 400, "VERSION_NOT_FOUND": 404, "REQUEST_ABORTED": 408}


def validate(request_id: str | None = None, article: int | None = None, number: str | None = None, query: str | None = None, limit: int | None = None, quote: str | None = None) -> dict:
    """Checked and normalised fields of one request."""
    if request_id is not None and not 8 <= len(request_id) <= 128:
        raise QueryError("INVALID_INPUT", "request id")
    if article is not None and not (isinstance(article, int) and 1 <= article <= MAX_ARTICLE):
        raise QueryError("INVALID_INPUT", "article")
    if number is not None and not (number.strip() and len(number) <= MAX_NUMBER):
        raise QueryError("INVALID_INPUT", "document number")
    if quote is not None and len(quote) > MAX_QUOTE:
        raise QueryError("INVALID_INPUT", "quote")
    if query is not None:
        query = unicodedata.normalize("NFC", query).strip()
        if not 1 <= len(query) <= MAX_QUERY:
            raise QueryError("INVALID_INPUT", "query")
    limit = DEFAULT_LIMIT if limit is None else limit
    if not 1 <= limit <= MAX_LIMIT:
        raise QueryError("INVALID_INPUT", "limit")
    return {"request_id": request_id, "article": article, "number": number, "query": query, "limit": limit, "quote": quote}


def refuse_over(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the keys with at most ``limit`` rows, and the other keys with ``error`` TOO_MANY_RESULTS: one answer that is
    too long is refused as a whole, the rest of the batch is answered."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    over = counts.filter(F.col("__n") > limit).select(*keys)
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return df.alias("a").join(over.alias("o"), on, "left_anti"), over.withColumn("error", F.lit("TOO_MANY_RESULTS"))


def provision_at(questions: DataFrame, versions: DataFrame) -> DataFrame:
    """Which version held (question_id, provision_id, valid_at, known_at), with its text and citation."""
    answer = temporal.resolve(questions, versions, "question_id")
    cited = citation_of(versions).select("version_id", "text", "document_number", "heading", "citation", "valid_from", "valid_to") if "evidence" in versions.columns else versions.select("version_id", "text", "document_number", "heading")
    return answer.join(cited, "version_id", "left").withColumn("validity", F.when(F.col("status") == "resolved", "effective")).withColumn("untrusted_content", F.lit(True))


def references_of(answers: DataFrame, versions: DataFrame, store: Callable[[DataFrame, str], DataFrame] = lambda t, name: t) -> DataFrame:
    """Cross-references in the texts of resolved answers, resolved at the questions' dates.

    ``store`` may write the spans and read them back: each kind of reference is resolved from them, and no text is
    searched twice. They bring their question along, so that answers are not joined again."""
    owner = versions.select("version_id", "document_id").distinct()
    asked = F.struct(F.col("question_id").cast("string").alias("question_id"), "provision_id", "document_id", "valid_at", "known_at")
    t = answers.filter("status = 'resolved'").join(owner, "version_id").select(asked.alias("asked"), "text")
    spans = references.extract_references(t, "asked", "text").select("asked.*", "*").drop("asked").withColumn("span_id", F.concat_ws("#", "question_id", "ord"))
    spans = store(spans, "spans")
    return references.resolve_references(spans, versions, versions)


def lookup_by_citation(questions: DataFrame, versions: DataFrame) -> DataFrame:
    return citations.lookup(questions, versions)


def check_citation(questions: DataFrame, versions: DataFrame) -> DataFrame:
    return citations.check(questions, versions)


def search_provisions(queries: DataFrame, versions: DataFrame, valid_at, known_at, limit: int = DEFAULT_LIMIT, store: Callable[[DataFrame, str], DataFrame] = lambda t, name: t) -> tuple[DataFrame, DataFrame]:
    """Hits of each query among the servable versions in force at a date, and per query whether there was a corpus
    at all and whether nothing in it was relevant. ``store`` is as in ``search.bm25``; stored hits, a few for each query,
    also show the planner their size, so that it need not deal out the corpus' texts to find those of the hits."""
    eligible = versions.filter(servable(F.col("status")) & contains(F.col("valid_from"), F.col("valid_to"), F.lit(valid_at)) & contains(F.col("known_from"), F.col("known_to"), F.lit(known_at)))
    hits = store(search.bm25(queries, eligible, "version_id", "text", "heading", limit, store=store), "found")
    texts = eligible.select("version_id", "provision_id", "heading", "text")
    words = queries.select("query_id", F.filter(search.tokens(F.col("query")), lambda w: ~w.contains("_")).alias("wanted"))
    shown = search.best_line(hits.join(texts, "version_id").join(words, "query_id"), "text", F.col("wanted"))
    size = eligible.agg(F.count("*").alias("n"))
    flags = queries.select("query_id").crossJoin(F.broadcast(size)).join(hits.groupBy("query_id").agg(F.count("*").alias("k")), "query_id", "left")  # one row of size
    flags = flags.select("query_id", (F.col("n") == 0).alias("corpus_empty"), ((F.col("n") > 0) & F.col("k").isNull()).alias("nothing_relevant"))
    return shown.select("query_id", "rank", "score", "version_id", "provision_id", "heading", "snippet"), flags


def compare_versions(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """Line differences of pairs (question_id, from_id, to_id), or why a pair cannot be compared, in this order:
    VERSION_NOT_FOUND, VERSION_NOT_SERVABLE, DIFFERENT_PROVISIONS, TOO_LONG."""
    v = versions.select("version_id", "provision_id", "text", servable(F.col("status")).alias("ok"))

    def side(name):
        return v.select(F.col("version_id").alias(f"{name}_id"), F.col("provision_id").alias(f"{name}_p"), F.col("text").alias(f"{name}_t"), F.col("ok").alias(f"{name}_ok"))

    t = pairs.join(side("from"), "from_id", "left").join(side("to"), "to_id", "left")
    early = F.when(F.col("from_p").isNull() | F.col("to_p").isNull(), "VERSION_NOT_FOUND").when(~F.col("from_ok") | ~F.col("to_ok"), "VERSION_NOT_SERVABLE").when(F.col("from_p") != F.col("to_p"), "DIFFERENT_PROVISIONS")
    t = t.withColumn("early", early).withColumn("chunks", compare.diff_lines(F.when(F.col("early").isNull(), F.col("from_t")), F.when(F.col("early").isNull(), F.col("to_t"))))
    error = F.coalesce("early", F.when(F.col("chunks").isNull(), "TOO_LONG"))
    t = t.select("question_id", F.when(error.isNull(), F.col("chunks")).alias("chunks"), error.alias("error"))
    return t.select("question_id", "chunks", F.exists("chunks", lambda c: c["operation"] != "unchanged").alias("changed"), "error")


def get_catalog(versions: DataFrame) -> DataFrame:
    return temporal.catalog(versions)


def trace_amendments(questions: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """Verified edges around each provision, at depth 1 or 2."""
    if depth not in (1, 2):
        raise QueryError("INVALID_INPUT", "depth")
    return graph.trace(questions, edges.filter("status = 'verified'") if "status" in edges.columns else edges, depth)
