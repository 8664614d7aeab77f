"""Cross-references in legal text: finding the spans, resolving them to versions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.functions.batches import bounded_batches
from tessera.functions.text import compact, heading_article_number
from tessera.operators.temporal import resolve

# Document types, the words that end a title, and the five shapes of a reference.
TYPES = ("Luật", "Bộ luật", "Nghị định", "Nghị quyết", "Thông tư", "Quyết định", "Pháp lệnh")
TITLE_ENDS = ("và", "hoặc", "hay", "theo", "tại", "trong", "của", "về", "được", "đã", "có", "cho", "từ", "với", "nếu", "khi", "này", "đó")

_S = "[\\s﻿]+"
_TYPE = f"(?P<type>{'|'.join(TYPES)})"
_POINT = f"(?:điểm{_S}(?P<point>[a-zđ]){_S})?"
_CLAUSE = f"(?:khoản{_S}(?P<clause>[0-9]+){_S})?"
_ARTICLE = f"Điều{_S}(?P<article>[0-9]+){_S}"
_OF = f"(?:của{_S})?"
_TITLE = f"(?P<title>[A-ZĐ][^,.;:()\\n]*?(?={_S}(?:{'|'.join(TITLE_ENDS)})(?=[\\s,.;:()]|$)|[,.;:()\\n]|$))"
SHAPES = tuple(
    (kind, re.compile(pattern))
    for kind, pattern in (
        ("named_document", f"{_POINT}{_CLAUSE}{_ARTICLE}{_OF}{_TYPE}{_S}{_TITLE}"),
        ("numbered_document", f"{_POINT}{_CLAUSE}(?:{_ARTICLE})?{_OF}{_TYPE}{_S}số{_S}(?P<number>[0-9]+[/A-Za-z0-9_.-]*[A-ZĐ][A-Za-z0-9_-]*)"),
        ("same_document", f"{_POINT}{_CLAUSE}{_ARTICLE}của{_S}{_TYPE}{_S}này"),
        ("same_document", f"Chương{_S}(?P<chapter>[IVXLCDM]+){_S}của{_S}{_TYPE}{_S}này"),
        ("same_document", f"{_POINT}khoản{_S}(?P<clause>[0-9]+){_S}Điều{_S}này"),
    )
)
#: What a reference starts with, always before white space.
STARTS = re.compile(f"(?:điểm|khoản|Điều|của|Chương|{'|'.join(TYPES)})(?=[\\s\ufeff])")
SPAN_DDL = "kind string, span string, start int, end int, article int, clause int, point string, chapter string, title string, type string, number string"


def _matches(shape: re.Pattern, text: str, starts: list[int]) -> Iterator[re.Match]:
    """What ``shape.finditer`` finds, if every match starts at one of ``starts``."""
    end = 0
    for at in starts:
        if at >= end and (m := shape.match(text, at)):
            end = m.end()
            yield m


def find_references(text: str) -> list[dict]:
    """Spans of one text in order of their start (code points).

    Shapes are tried in order; a span that overlaps others meets only the first of them and takes its place if
    it is longer. They are tried at the words that a reference may start with and nowhere else.
    """
    found: list[dict] = []
    starts = [m.start() for m in STARTS.finditer(text)]
    for kind, shape in SHAPES:
        for m in _matches(shape, text, starts):
            g = m.groupdict()
            number = lambda k, g=g: int(g[k]) if g.get(k) else None
            span = {"kind": kind, "span": m[0], "start": m.start(), "end": m.end(), "article": number("article"), "clause": number("clause"), "point": g.get("point"), "chapter": g.get("chapter"), "title": g.get("title"), "type": g.get("type"), "number": g.get("number")}
            clash = next((k for k, f in enumerate(found) if f["start"] < m.end() and m.start() < f["end"]), None)
            if clash is None:
                found.append(span)
            elif len(m[0]) > found[clash]["end"] - found[clash]["start"]:
                found[clash] = span
    return sorted(found, key=lambda f: f["start"])


def extract_references(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per reference: id, ord and the span's fields. Null texts give none. The id may be a struct of all that
    is to stay with a text's references.

    Texts without any of the words a reference needs are filtered out before Python sees them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike("Điều|Chương|số"))
    out = to_arrow_schema(StructType([StructField("ord", IntegerType()), *StructType.fromDDL(SPAN_DDL)]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            # one text at a time as a Python string; the spans of a batch are all that is kept
            rows = [{"at": i, "ord": k, **s} for i, t in enumerate(batch["text"]) for k, s in enumerate(find_references(t.as_py()))]
            ids = batch["id"].take(pa.array([r["at"] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *pa.RecordBatch.from_pylist(rows, schema=out).columns], names=["id", *out.names])

    return bounded_batches(texts).mapInArrow(run, f"id {kind}, ord int, {SPAN_DDL}").withColumnRenamed("id", id_col)


def resolve_references(spans: DataFrame, versions: DataFrame, documents_of: DataFrame) -> DataFrame:
    """Each span's target version at its question's date, or why it has none.

    ``spans`` has span_id, provision_id and document_id of the text it stands in, valid_at, known_at and the
    fields of ``extract_references``; ``versions`` is what ``resolve`` takes, ``documents_of`` has
    provision_id, document_id, document_number and heading.

    Reasons: UNSUPPORTED (a chapter, or a whole numbered document), NOT_IN_CORPUS, AMBIGUOUS,
    NOT_IN_FORCE_AT_DATE.
    """
    known = documents_of.select("provision_id", "document_id", compact(F.col("document_number")).alias("key"), heading_article_number(F.col("heading")).alias("no")).distinct()
    s = spans.withColumn("key", compact(F.col("number")))
    own = F.col("kind") == "same_document"
    same = s.filter(own & F.col("article").isNotNull()).alias("s").join(known.alias("k"), (F.col("s.document_id") == F.col("k.document_id")) & (F.col("s.article") == F.col("k.no")))
    numbered = s.filter((F.col("kind") == "numbered_document") & F.col("article").isNotNull()).alias("s").join(known.alias("k"), (F.col("s.key") == F.col("k.key")) & (F.col("s.article") == F.col("k.no")))
    targets = same.select("s.span_id", F.col("k.provision_id").alias("target")).union(numbered.select("s.span_id", F.col("k.provision_id").alias("target")))
    targets = targets.groupBy("span_id").agg(F.count_distinct("target").alias("n_targets"), F.min("target").alias("target"))
    s = s.join(targets, "span_id", "left")
    # "this article" is the provision that the text stands in
    itself = own & F.col("article").isNull() & F.col("chapter").isNull()
    s = s.withColumn("n_targets", F.when(itself, 1).otherwise(F.coalesce("n_targets", F.lit(0)))).withColumn("target", F.when(itself, F.col("provision_id")).otherwise(F.col("target")))
    early = (
        F.when(F.col("chapter").isNotNull(), "UNSUPPORTED").when(F.col("kind") == "named_document", "NOT_IN_CORPUS")
        .when((F.col("kind") == "numbered_document") & F.col("article").isNull() & F.col("known_number"), "UNSUPPORTED")
        .when(F.col("n_targets") == 0, "NOT_IN_CORPUS").when(F.col("n_targets") > 1, "AMBIGUOUS")
    )
    numbers = known.select("key").distinct().withColumn("known_number", F.lit(True))
    s = s.join(numbers, "key", "left").withColumn("known_number", F.coalesce("known_number", F.lit(False))).withColumn("early", early)
    asked = s.filter("early is null").select("span_id", F.col("target").alias("provision_id"), "valid_at", "known_at")
    answer = resolve(asked, versions, "span_id").select("span_id", F.col("status").alias("answer"), "version_id")
    out = s.join(answer, "span_id", "left")
    reason = F.coalesce("early", F.when(F.col("answer") == "conflict", "AMBIGUOUS").when(F.col("answer") == "unknown", "NOT_IN_FORCE_AT_DATE"))
    return out.select("span_id", "kind", "span", "start", "end", F.when(F.col("early").isNull(), F.col("target")).alias("target_provision_id"), F.when(reason.isNull(), F.col("version_id")).alias("target_version_id"), reason.alias("reason"))
