"""Links, hosts and robots rules of web pages, as columns and joins."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.batches import bounded_batches
from tessera.functions.checks import host_allowed  # noqa: F401  (part of this module's interface)

#: Links of one page at most.
MAX_LINKS = 1_000


def discover_links(pages: DataFrame, id_col: str, url_col: str, html_col: str, pattern: str = ".*", max_links: int = MAX_LINKS) -> DataFrame:
    """(id, ord, url, lastmod) of each page's links: anchors, then sitemap entries, on the page's own host.

    Relative links are resolved against the page. A link found more than once keeps its first place and the
    first date it has. Anchors with a ``#`` are not links. Over ``max_links`` the later ones are left out, as
    the limit is part of the operator.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    anchors = F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"'#]+)["']"""), F.lit(1)), lambda u: F.struct(u.alias("link"), F.lit(None).cast("string").alias("lastmod")))
    entries = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>(\s*<lastmod>\s*.*?\s*</lastmod>)?"), F.lit(0)),
        lambda e: F.struct(F.regexp_extract(e, r"(?s)<loc>\s*(.*?)\s*</loc>", 1).alias("link"), F.nullif(F.regexp_extract(e, r"(?s)<lastmod>\s*(.*?)\s*</lastmod>", 1), F.lit("")).alias("lastmod")),
    )
    t = pages.select(F.col(id_col), F.col(url_col).alias("base"), F.posexplode(F.concat(anchors, entries)).alias("ord", "e"))
    t = t.withColumn("url", resolve_url(F.col("base"), F.replace(F.col("e.link"), F.lit("&amp;"), F.lit("&"))))
    host = F.try_parse_url("url", F.lit("HOST"))
    t = t.filter((host == F.try_parse_url("base", F.lit("HOST"))) & F.col("url").rlike(pattern))
    g = t.groupBy(id_col, "url").agg(F.min("ord").alias("ord"), F.min_by("e.lastmod", F.when(F.col("e.lastmod").isNotNull(), F.col("ord"))).alias("lastmod"))
    w = Window.partitionBy(id_col).orderBy("ord")
    return g.withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= max_links).select(id_col, "ord", "url", "lastmod")


def resolve_url(base: Column, link: Column) -> Column:
    """An absolute URL for a link on a page; links that are no web address give null."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^?#]*/)[^/?#]*", 1)
    folder = F.when(F.length(folder) > F.length(origin), folder).otherwise(F.concat(origin, F.lit("/")))
    scheme = F.regexp_extract(base, "^(https?):", 1)
    return (
        F.when(link.rlike("(?i)^https?://"), link).when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(folder, F.regexp_replace(link, r"^\./", "")))
    )


def document_id_of(url: Column) -> Column:
    """What stands behind the last ``--`` of a URL's last path part, else that part."""
    part = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)/?$", 1)
    return F.substring_index(part, "--", -1)


def parse_robots(files: DataFrame, host_col: str = "host", text_col: str = "text") -> DataFrame:
    """(host, agent, pattern, allow) rules of robots files; an agent without rules has a row with null pattern."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = [(h, *r) for h, t in zip(batch["host"], batch["text"]) for r in _rules(t or "")]
            yield pd.DataFrame(rows, columns=["host", "agent", "pattern", "allow"])

    return files.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")).mapInPandas(run, "host string, agent string, pattern string, allow boolean")


def _rules(text: str) -> list[tuple[str, str | None, bool | None]]:
    """Agents on neighbouring lines share the rules that follow; any other field ends their list, lines without a
    field and comments do not."""
    out: list[tuple] = []
    agents: list[str] = []
    naming = False
    for line in re.split(r"\r?\n", text):
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            agents = [*agents, value.lower()] if naming else [value.lower()]
            out.append((agents[-1], None, None))
        elif name in ("allow", "disallow") and value:
            out += [(a, value, name == "allow") for a in agents]
        naming = name == "user-agent"
    return out


def robots_pattern(pattern: Column) -> Column:
    """A robots path pattern as a regular expression: ``*`` is anything, a final ``$`` the end."""
    anchored = pattern.endswith("$")
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.+?^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(anchored, "$").otherwise(""))


def robots_decision(requests: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``requests`` (request_id, host, path) with ``allowed``.

    The group of the agent counts if there is one, else that of ``*``. The longest matching pattern decides, an
    allowing one on a tie; without a match the path is allowed.
    """
    mine = rules.withColumn("own", (F.col("agent") != "*") & F.lit(agent.lower()).contains(F.col("agent"))).filter(F.col("own") | (F.col("agent") == "*"))
    best = mine.groupBy("host").agg(F.max("own").alias("own"))
    mine = mine.join(best, ["host", "own"]).filter("pattern is not null").select("host", "pattern", "allow", robots_pattern(F.col("pattern")).alias("regex"))
    hit = requests.join(mine, "host").filter(F.expr("path rlike regex"))
    decided = hit.groupBy("request_id").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("allow"))
    return requests.join(decided, "request_id", "left").select("request_id", "host", "path", F.coalesce("allow", F.lit(True)).alias("allowed"))


def too_fast(fetches: DataFrame, min_seconds: float = 2.0) -> DataFrame:
    """Fetches (host, ts) that came sooner after the host's one before than they should."""
    w = Window.partitionBy("host").orderBy("ts")
    gap = F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(w)
    return fetches.withColumn("gap", gap).filter(F.col("gap") < min_seconds)


def read_flight(payloads: DataFrame, id_col: str, text_col: str, with_text: bool = False) -> DataFrame:
    """(id, chunks, metadata) of streamed page payloads: length-prefixed texts and the record's metadata object; the
    whole payload as ``text`` too where it is asked for.

    Marks of length-prefixed texts stand at the start of a line, with a number; lengths count UTF-8 bytes. The metadata
    is the innermost balanced object around the first ``"docNum"`` that is JSON and has the fields of a record
    (see ``is_record``); it is returned as text, null if there is none.
    """
    kind = payloads.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [t.as_py() or "" for t in batch["text"]]
            chunks = pa.array([_chunks(t) for t in texts], pa.list_(pa.string()))
            metadata = pa.array([_object_around(t, '"docNum"', is_record) for t in texts], pa.string())
            columns = {"id": batch["id"], "chunks": chunks, "metadata": metadata, **({"text": batch["text"]} if with_text else {})}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return bounded_batches(payloads).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, chunks array<string>, metadata string{', text string' if with_text else ''}").withColumnRenamed("id", id_col)


def _chunks(text: str) -> list[str]:
    raw = text.encode()
    out = []
    for m in re.finditer(rb"(?:^|\n)[0-9]+:T([0-9a-f]+),", raw):
        size = int(m[1], 16)
        if size and m.end() + size <= len(raw):
            out.append(raw[m.end() : m.end() + size].decode("utf-8", "replace"))
    return out


#: Fields of a record's metadata: longest text, and whether it must be there (fixed values).
RECORD_FIELDS = {"docNum": (256, True), "title": (2048, True), "id": (128, False), "key": (128, False)}
RECORD_DATES = ("effFrom", "effTo", "issueDate")


def is_record(text: str) -> bool:
    """JSON object whose known fields have their types and lengths; others do not matter."""
    try:
        record = json.loads(text)
    except ValueError:
        return False
    for name, (longest, needed) in RECORD_FIELDS.items():
        if (needed or name in record) and not (isinstance(record.get(name), str) and 1 <= len(record[name]) <= longest):
            return False
    status = record.get("effStatus")
    if not all(record.get(name) is None or isinstance(record[name], str) for name in RECORD_DATES) or not isinstance(status, dict | None):
        return False
    return status is None or "name" not in status or isinstance(status["name"], str) and len(status["name"]) <= 256


def _balanced(text: str, start: int) -> int:
    """Where the object that opens at ``start`` ends, -1 if it does not."""
    depth, quoted, escaped = 0, False, False
    for end in range(start, len(text)):
        c = text[end]
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return end + 1
    return -1


def _object_around(text: str, mark: str, fits: Callable[[str], bool], tries: int = 64) -> str | None:
    """The innermost object around the first ``mark`` that ``fits``, of the first ``tries`` that may be."""
    at = text.find(mark)
    start = at
    for _ in range(tries if at >= 0 else 0):
        start = text.rfind("{", 0, max(start, 0))
        if start < 0:
            return None
        end = _balanced(text, start)
        if end > at and fits(text[start:end]):
            return text[start:end]
    return None


def relations(payloads: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Relations between documents that page payloads list, and counts of relation codes that have no meaning here.

    A payload is lines of ``key:JSON``; codes 10 and 12 are amends and replaces, 3 is left out (fixed values).
    """
    line = F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    t = payloads.select(F.col(id_col), line.alias("line")).withColumn("json", F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    parsed = F.from_json("json", "documentNamesByType map<string, array<struct<id: string, name: string>>>")["documentNamesByType"]
    t = t.filter(F.col("json").contains("documentNamesByType")).select(id_col, F.explode(parsed).alias("code", "documents"))
    t = t.select(id_col, "code", F.explode("documents").alias("d"))
    kind = F.when(F.col("code") == "10", "amends").when(F.col("code") == "12", "replaces").when(F.col("code") == "3", "ignored")
    t = t.withColumn("relation", kind)
    known = t.filter("relation in ('amends', 'replaces')").select(id_col, "relation", F.col("d.id").alias("target_document_id"), F.col("d.name").alias("name"))
    return known, t.filter("relation is null").groupBy("code").agg(F.count("*").alias("n"))
