"""Predicates and interval arithmetic over columns, and the record checks of a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Review states that may be served, best first, and all states.
SERVABLE = ("verified", "machine_checked")
STATES = ("verified", "machine_checked", "under_review", "unverified")
RELATIONS = ("amends", "repeals", "replaces", "corrects")


def contains(start: Column, end: Column, point: Column) -> Column:
    """Half-open membership; a null end is open."""
    return (point >= start) & (end.isNull() | (point < end))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (b_end.isNull() | (a_start < b_end)) & (a_end.isNull() | (b_start < a_end))


def valid_interval(start: Column, end: Column) -> Column:
    return start.isNotNull() & (end.isNull() | (start < end))


def servable(status: Column) -> Column:
    return F.coalesce(status.isin(*SERVABLE), F.lit(False))


def is_tagged_id(c: Column, tag: str) -> Column:
    """``tag`` and one or more segments of letters, digits, dashes, the first of them in lower case."""
    return F.coalesce(c.rlike(rf"^{tag}_[a-z0-9][A-Za-z0-9-]*(_[A-Za-z0-9-]+)*$") & (F.length(c) <= 128), F.lit(False))


def is_date(c: Column) -> Column:
    """A day of the calendar as YYYY-MM-DD; years before 100 are refused."""
    return F.coalesce(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull() & (c >= "0100"), F.lit(False))


def is_instant(c: Column) -> Column:
    """A UTC instant as YYYY-MM-DDThh:mm:ss.SSSZ."""
    shape = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\.[0-9]{3}Z$")
    return F.coalesce(shape & is_date(F.substring(c, 1, 10)), F.lit(False))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_https_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https://[^\s/?#]+") & (F.length(c) <= 2048) & F.try_parse_url(c, F.lit("HOST")).isNotNull(), F.lit(False))


def is_safe_path(c: Column) -> Column:
    """A relative path without empty, ``.`` or ``..`` parts, back slashes or drive letters."""
    parts = F.split(c, "/")
    return F.coalesce((c != "") & ~c.contains("\\") & ~c.rlike("^[A-Za-z]:") & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))


def host_allowed(host: Column, allowed: list[str]) -> Column:
    """The host is one of ``allowed`` or a subdomain of one."""
    h = F.lower(host)
    hit = F.lit(False)
    for a in allowed:
        hit = hit | (h == a.lower()) | F.endswith(h, F.lit("." + a.lower()))
    return F.coalesce(hit, F.lit(False))


def repeated(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The second and later rows of each key."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("occurrence > 1")


def orphans(df: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key no parent has."""
    return df.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def citation_of(versions: DataFrame) -> DataFrame:
    """Add ``citation``: the entry of ``evidence`` that ``primary_evidence_id`` names, null unless exactly one does."""
    hit = F.filter("evidence", lambda e: e["evidence_id"] == F.col("primary_evidence_id"))
    return versions.withColumn("citation", F.when(F.size(hit) == 1, hit[0]))
