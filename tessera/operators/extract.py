"""Extraction of provisions from positioned lines and from marked-up pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import WS, gazette_article_number, html_to_text, iso_from_day_month_year, nfc, normalise_line, plain_text, running_key, slug

# How structural lines and the start of an annex are written.
CHAPTER = r"^Chương\s+[IVXLCDM]+(\s+[^\p{Ll}]+)?$"
SECTION = r"^Mục\s+[0-9]+(\s+[^\p{Ll}]+)?$"
ANNEX_STARTS = (
    r"CỘNG[ ]+HÒA[ ]+XÃ[ ]+HỘI[ ]+CHỦ[ ]+NGHĨA[ ]+VIỆT[ ]+NAM",
    r"(?iu)^PHỤ[ ]+LỤC([ ]+[IVXLCDM0-9]+[A-Za-zĐ]?)?[ ]*$",
    r"(?iu)^Mẫu[ ]+[^ ]+[ ]+(ban[ ]+hành[ ]+)?kèm[ ]+theo[ ]+",
    r"^[(][ ]*(Ban[ ]+hành[ ]+)?[Kk]èm[ ]+theo[ ]+",
)
#: A line is running if its key stands at page edges this often; small print is under this part of the body size.
RUNNING_SHARE, RUNNING_LEAST, SMALL_PRINT = 0.6, 2, 0.8


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 1, line) of each text."""
    return docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def join_fragments(fragments: DataFrame) -> DataFrame:
    """Lines from positioned fragments (doc_id, page, x, y, font_size, text): a line per rounded baseline, top
    down, its fragments in order of x, joined as they are and then normalised."""
    g = fragments.groupBy("doc_id", "page", F.round("y").alias("y"))
    out = g.agg(F.sort_array(F.collect_list(F.struct("x", "text"))).alias("f"), F.min("x").alias("x"), F.max("font_size").alias("font_size"))
    text = normalise_line(F.array_join(F.col("f")["text"], ""))
    w = Window.partitionBy("doc_id").orderBy("page", F.desc("y"))
    return out.withColumn("text", text).filter("text <> ''").withColumn("ord", F.row_number().over(w)).drop("f")


def font_histogram(lines: DataFrame) -> DataFrame:
    """(doc_id, font_size, n, body): lines per size; the body size is the most frequent one, first met on a tie."""
    h = lines.groupBy("doc_id", "font_size").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return h.withColumn("body", F.row_number().over(w) == 1).drop("first")


def running_lines(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, key, n) of header and footer keys: first and last line of every page, numbers masked, seen on at least
    two edges and 60% of the pages. The only line of a page counts as both its edges."""
    up = Window.partitionBy(doc, "page").orderBy("ord")
    down = Window.partitionBy(doc, "page").orderBy(F.desc("ord"))
    edges = lines.withColumn("a", F.row_number().over(up)).withColumn("b", F.row_number().over(down)).filter("a = 1 or b = 1")
    keyed = edges.select(doc, running_key(F.col("text")).alias("key"), ((F.col("a") == 1).cast("int") + (F.col("b") == 1).cast("int")).alias("k"))
    pages = lines.groupBy(doc).agg(F.count_distinct("page").alias("pages"))
    counts = keyed.groupBy(doc, "key").agg(F.sum("k").alias("n")).join(pages, doc)
    return counts.filter(F.col("n") >= F.greatest(F.lit(RUNNING_LEAST), F.ceil(F.col("pages") * RUNNING_SHARE))).select(doc, "key", "n")


def section_fill(lines: DataFrame, doc: str, order: str, opens, closes) -> DataFrame:
    """``lines`` with ``section`` added: the ``order`` of the latest opening line, none after a closing one."""
    mark = F.when(opens, F.col(order).cast("long")).when(closes, F.lit(-1).cast("long"))
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(mark, ignorenulls=True).over(w)
    return lines.withColumn("section", F.when(last >= 0, last))


def _body_size(lines: DataFrame) -> DataFrame:
    """``lines`` with ``body_size``, the size that ``font_histogram`` marks as the body's."""
    size = Window.partitionBy("doc_id", "font_size")
    t = lines.withColumn("__n", F.count("*").over(size)).withColumn("__first", F.min("ord").over(size))
    most = F.max(F.struct("__n", -F.col("__first"), "font_size")).over(Window.partitionBy("doc_id"))
    return t.withColumn("body_size", most["font_size"]).drop("__n", "__first")


def _page_edges(lines: DataFrame) -> DataFrame:
    """``lines`` with ``is_running``: whether the line's key is one of those that ``running_lines`` gives."""
    page, doc = Window.partitionBy("doc_id", "page").orderBy("ord"), Window.partitionBy("doc_id")
    t = lines.withColumn("__first", (F.row_number().over(page) == 1).cast("int")).withColumn("__edges", F.col("__first") + F.lead(F.lit(1)).over(page).isNull().cast("int"))
    t = t.withColumn("__pages", F.sum(F.when(F.col("page").isNotNull(), F.col("__first"))).over(doc)).withColumn("__key", running_key(F.col("text")))
    # keys are as long as lines: their hash sorts them, the key itself tells those of one hash apart
    n = F.sum("__edges").over(Window.partitionBy("doc_id", F.xxhash64("__key"), "__key"))
    least = F.greatest(F.lit(RUNNING_LEAST), F.ceil(F.coalesce("__pages", F.lit(0)) * RUNNING_SHARE))
    t = t.withColumn("is_running", F.col("__key").isNotNull() & (n >= least))
    return t.drop("__first", "__edges", "__pages", "__key")


def segment_gazette(lines: DataFrame, store: Callable[[DataFrame], DataFrame] = lambda t: t) -> tuple[DataFrame, DataFrame]:
    """Provisions of gazette documents from their lines (doc_id, page, page_width, x, font_size, ord, text).

    Running lines go, small print is apparatus, an annex is cut off from its first marker line after an article
    unless the next article comes later, article lines open sections and chapter or section headings close them.
    Lines to the right of the centre at the end of the last article are its signature. All steps are windows
    over a document's lines.

    Returns (lines with their ``part``: running, apparatus, annex, structure, preamble, unassigned, signature or
    article, and ``article``) and (documents: doc_id, n_articles, refusal). Refusals: NO_ARTICLES,
    ARTICLES_NOT_CONTINUOUS. ``store`` may write the lines and read them back: for callers that use the results
    more than once, who would segment as often.
    """
    # every step is a window within a document, so lines are dealt by document once and carried through all of them
    t = _page_edges(_body_size(lines.filter("doc_id is not null").repartition("doc_id")))
    t = t.withColumn("early", F.when(F.col("is_running"), "running").when(F.col("font_size") < SMALL_PRINT * F.col("body_size"), "apparatus"))
    live = F.col("early").isNull()
    t = t.withColumn("no", F.when(live, gazette_article_number(F.col("text"))))
    marker = F.lit(False)
    for pattern in ANNEX_STARTS:
        marker = marker | F.col("text").rlike(pattern)
    upto = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("doc_id")
    t = t.withColumn("before", F.last("no", ignorenulls=True).over(upto)).withColumn("first_marker", F.min(F.when(live & marker & F.col("before").isNotNull(), F.col("ord"))).over(whole))
    t = t.withColumn("last_no", F.max(F.when(F.col("ord") == F.col("first_marker"), F.col("before"))).over(whole))
    t = t.withColumn("goes_on", F.coalesce(F.max(F.when((F.col("ord") > F.col("first_marker")) & (F.col("no") == F.col("last_no") + 1), True)).over(whole), F.lit(False)))
    cut = F.coalesce((F.col("ord") >= F.col("first_marker")) & ~F.col("goes_on"), F.lit(False))
    t = t.withColumn("early", F.coalesce("early", F.when(cut, "annex"))).withColumn("no", F.when(~cut, F.col("no")))
    structural = F.col("early").isNull() & (F.col("text").rlike(CHAPTER) | F.col("text").rlike(SECTION))
    t = section_fill(t.withColumn("structural", structural), "doc_id", "ord", F.col("no").isNotNull(), F.col("structural"))
    t = t.withColumn("article", F.when(F.col("section").isNotNull() & F.col("early").isNull(), F.last("no", ignorenulls=True).over(upto)))
    # the tail of the last article right of the centre: no line at or after it stands left of the centre
    last_section = F.max(F.when(F.col("early").isNull(), F.col("section"))).over(whole)
    in_last = F.col("early").isNull() & (F.col("section") == F.col("last_section")) & ~F.col("structural")
    t = t.withColumn("last_section", last_section)
    right = F.col("x") > F.col("page_width") / 2
    t = t.withColumn("last_left", F.max(F.when(in_last & ~right, F.col("ord"))).over(whole)).withColumn("last_right", F.max(F.when(in_last & right, F.col("ord"))).over(whole))
    tail = (F.col("ord") <= F.col("last_right")) & (F.col("last_left").isNull() | (F.col("ord") > F.col("last_left")))
    signature = in_last & F.coalesce(tail, F.lit(False)) & F.col("no").isNull()
    first_article = F.min(F.when(F.col("no").isNotNull(), F.col("ord"))).over(whole)
    t = t.withColumn("first_article", first_article)
    part = (
        F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("structural"), "structure").when(signature, "signature")
        .when(F.col("section").isNotNull(), "article").when(F.col("first_article").isNull() | (F.col("ord") < F.col("first_article")), "preamble").otherwise("unassigned")
    )
    t = store(t.select("doc_id", "ord", "page", "x", "text", part.alias("part"), "article", "no"))
    heads = t.filter("no is not null and part = 'article'")
    step = heads.withColumn("expected", F.coalesce(F.lag("no").over(Window.partitionBy("doc_id").orderBy("ord")) + 1, F.lit(1)))
    broken = step.groupBy("doc_id").agg(F.count("*").alias("n_articles"), F.bool_or(F.col("no") != F.col("expected")).alias("broken"))
    documents = t.select("doc_id").distinct().join(broken, "doc_id", "left")
    refusal = F.when(F.col("n_articles").isNull(), "NO_ARTICLES").when(F.col("broken"), "ARTICLES_NOT_CONTINUOUS")
    documents = documents.select("doc_id", F.coalesce("n_articles", F.lit(0)).alias("n_articles"), refusal.alias("refusal"))
    return t.drop("no"), documents


def gazette_provisions(parts: DataFrame, documents: DataFrame, references: DataFrame) -> DataFrame:
    """Provision rows of the documents that were not refused: ids, heading, text with its heading line, dates.

    ``references`` has doc_id, document_number, effective_from.
    """
    kept = parts.filter("part = 'article'").join(documents.filter("refusal is null").select("doc_id"), "doc_id").join(references, "doc_id")
    g = kept.groupBy("doc_id", "document_number", "effective_from", "article").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("l"))
    # fixed values: how ids are made
    base = F.concat(F.lit("congbao_"), slug(F.col("document_number")), F.lit("_d"), F.col("article"))
    return g.select("doc_id", "article", F.concat(F.lit("prov_"), base).alias("provision_id"), F.concat(F.lit("pv_"), base, F.lit("_e"), F.regexp_replace("effective_from", "-", "")).alias("version_id"), F.col("l")[0]["text"].alias("heading"), F.array_join(F.col("l")["text"], "\n").alias("text"), F.col("effective_from").alias("valid_from"))


def paragraphs(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, ord, role, class, source_id, text) of a page's classed paragraphs; a class that is not known counts as content
    further on and keeps the role unknown here."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r'(?s)(<p[^>]*class="[^"]*"[^>]*>.*?</p>)'), F.lit(1))
    t = pages.select(F.col(id_col), F.posexplode(found).alias("ord", "p"))
    name = F.regexp_extract("p", r'^<p[^>]*class="([^"]*)"', 1)
    role = F.when(name == "prov-article", "article").when(name.isin("prov-content", "prov-clause", "prov-item"), "content").when(name.isin("prov-chapter", "prov-section"), "structure").otherwise("unknown")
    source = F.nullif(F.regexp_extract("p", r'^<p[^>]*\sid="([^"]*)"', 1), F.lit(""))
    return t.select(id_col, "ord", role.alias("role"), name.alias("class"), source.alias("source_id"), html_to_text(F.regexp_replace("p", "(?s)^<p[^>]*>|</p>$", "")).alias("text"))


def marked_provisions(paras: DataFrame, id_col: str) -> DataFrame:
    """(id, no, source_id, heading, text) of pages' articles: content up to the next article or structural paragraph, joined
    by newlines, without the heading unless there is no content."""
    t = section_fill(paras, id_col, "ord", F.col("role") == "article", F.col("role") == "structure").filter("section is not null")
    content = F.filter(F.sort_array(F.collect_list(F.struct("ord", "role", "text"))), lambda p: p["role"] != "article")
    g = t.groupBy(id_col, "section").agg(F.max(F.when(F.col("role") == "article", F.col("text"))).alias("heading"), F.max(F.when(F.col("role") == "article", F.col("source_id"))).alias("source_id"), content.alias("c"))
    text = F.when(F.size("c") > 0, F.array_join(F.col("c")["text"], "\n")).otherwise(F.col("heading"))
    no = F.row_number().over(Window.partitionBy(id_col).orderBy("section"))
    return g.select(id_col, no.alias("no"), "source_id", "heading", text.alias("text"))


def read_detail_page(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with what a gazette page says of its document, or why it is refused.

    Adds pdf_url, document_number, issued_on, effective_from, refusal (NO_PDF, NO_NUMBER, NO_ISSUE_DATE,
    NO_EFFECTIVE_DATE).
    """
    text = plain_text(F.col(html_col))
    date = lambda label: iso_from_day_month_year(F.regexp_extract(text, label + r"\s*:?\s*([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", 1))
    pdf = F.nullif(F.regexp_extract(F.col(html_col), r'href="([^"]+\.pdf[^"]*)"', 1), F.lit(""))
    number = F.nullif(F.regexp_extract(text, r"Số(?: hiệu| ký hiệu)?\s*:?\s*([0-9]+[/0-9A-Za-zĐđ.-]*)", 1), F.lit(""))
    out = pages.withColumn("pdf_url", pdf).withColumn("document_number", number).withColumn("issued_on", date("Ngày ban hành")).withColumn("effective_from", date("Ngày có hiệu lực"))
    refusal = F.when(F.col("pdf_url").isNull(), "NO_PDF").when(F.col("document_number").isNull(), "NO_NUMBER").when(F.col("issued_on").isNull(), "NO_ISSUE_DATE").when(F.col("effective_from").isNull(), "NO_EFFECTIVE_DATE")
    return out.withColumn("refusal", refusal)


def propose_applicability(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conditions from numbered lines of provisions about who a text applies to, and such provisions without any.

    The first line is taken for the heading. Conditions await review.
    """
    scope = versions.filter(nfc(F.col("heading")).rlike("(?iu)Đối tượng áp dụng"))
    lines = scope.select("provision_id", "version_id", F.posexplode(F.slice(F.split(nfc(F.col("text")), "\n"), 2, 1_000_000)).alias("k", "line"))
    hit = lines.withColumn("no", F.regexp_extract(F.trim("line"), r"^([0-9]+)[.)]\s+(.+)$", 1)).withColumn("condition", F.regexp_extract(F.trim("line"), r"^([0-9]+)[.)]\s+(.+)$", 2)).filter("no <> ''")
    subject = F.array_join(F.slice(F.split(F.regexp_replace("condition", "[.;]$", ""), WS + "+"), 1, 8), " ")
    conditions = hit.select(F.concat(F.lit("cond_"), "version_id", F.lit("_k"), "no").alias("condition_id"), "provision_id", subject.alias("subject"), "condition", F.lit(True).alias("applies"), F.lit("under_review").alias("status"))
    return conditions, scope.join(hit.select("version_id").distinct(), "version_id", "left_anti").select("provision_id", "version_id")


def draft_from_payloads(payloads: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Draft provisions of streamed page payloads, and what was refused or skipped: (id, locator, reason).

    A payload without metadata, id or effective date is refused as a whole (METADATA_NOT_FOUND,
    EFFECTIVE_DATE_MISSING); an article without an id or heading is skipped. Drafts await review.
    """
    from tessera.sources.web import read_flight

    parts = read_flight(payloads, id_col, text_col, with_text=True)  # a payload goes through its worker: no join brings it back
    meta = F.from_json("metadata", "docNum string, effFrom string, effTo string, id string, title string")
    body = F.coalesce(F.filter("chunks", lambda c: c.contains("prov-article"))[0], F.col("text"))
    t = parts.withColumn("m", meta).withColumn("body", body)
    day = lambda c: F.when(F.length(c) >= 10, F.substring(c, 1, 10))
    refusal = F.when(F.col("m.docNum").isNull() | F.col("m.id").isNull(), "METADATA_NOT_FOUND").when(day(F.col("m.effFrom")).isNull(), "EFFECTIVE_DATE_MISSING")
    t = t.withColumn("refusal", refusal)
    good = t.filter("refusal is null")
    # the metadata travels as part of the key, so that payloads are read once
    keyed = good.select(F.struct(F.col(id_col).alias("id"), "m").alias("__key"), "body")
    found = marked_provisions(paragraphs(keyed, "__key", "body"), "__key").select(F.col("__key.id").alias(id_col), F.col("__key.m").alias("m"), "no", "source_id", "heading", "text")
    skip = F.when(F.col("source_id").isNull(), "NO_ID").when(F.col("heading") == "", "EMPTY_HEADING")
    found = found.withColumn("skip", skip)
    start = day(F.col("m.effFrom"))
    # fixed values: how ids are made
    drafts = found.filter("skip is null").select(
        id_col, F.concat(F.lit("doc_vbpl_"), "m.id").alias("document_id"), F.col("m.docNum").alias("document_number"), F.concat(F.lit("prov_vbpl_"), "source_id").alias("provision_id"),
        F.concat(F.lit("pv_vbpl_"), "source_id", F.lit("_e"), F.regexp_replace(start, "-", "")).alias("version_id"), "heading", "text", F.sha2("text", 256).alias("text_sha256"),
        start.alias("valid_from"), day(F.col("m.effTo")).alias("valid_to"), F.lit("under_review").alias("status"),
    )
    issues = t.filter("refusal is not null").select(id_col, F.lit("document").alias("locator"), F.col("refusal").alias("reason"))
    return drafts, issues.union(found.filter("skip is not null").select(id_col, F.concat(F.lit("article "), "no"), "skip"))
