"""Immutable releases on a file system that Spark reaches: strict decoding, publishing, loading, rolling back."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import extension_for
from tessera.operators.sets import check_vouchers

EVIDENCE = "array<struct<evidenceId: string, locator: string, officialSourceUrl: string, retrievedAt: string, sourceSha256: string>>"
INTERVAL = "struct<from: string, to: string>"
VERSION = f"struct<datasetReleaseId: string, documentId: string, documentNumber: string, evidence: {EVIDENCE}, heading: string, legalText: string, legalTextSha256: string, primaryEvidenceId: string, provisionId: string, provisionVersionId: string, reviewStatus: string, systemTime: {INTERVAL}, validTime: {INTERVAL}>"
AMENDMENT = f"struct<amendmentId: string, effectiveFrom: string, evidence: {EVIDENCE}, relationType: string, reviewStatus: string, sourceProvisionId: string, targetProvisionId: string>"
APPLICABILITY = f"struct<applies: boolean, condition: string, conditionId: string, evidence: {EVIDENCE}, provisionId: string, reviewStatus: string, subject: string>"
FILE = f"amendments array<{AMENDMENT}>, applicability array<{APPLICABILITY}>, datasetReleaseId string, provisionVersions array<{VERSION}>, schemaVersion int"
#: Release ids that the pointer remembers at most.
HISTORY = 32


class ReleaseError(Exception):
    """A release that cannot be published, loaded or rolled back; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole text files, a byte-order mark taken off."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.withColumn("value", F.regexp_replace("value", r"^\x{FEFF}", ""))


def decode(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded data-set files and what is wrong with the files: (path, issue).

    Files are refused for broken JSON, another schema version, keys that the schema does not know (Spark would
    drop them silently), a record of another release and repeated ids.
    """
    t = files.withColumn("d", F.from_json("value", FILE, {"mode": "PERMISSIVE"}))
    known = ["schemaVersion", "datasetReleaseId", "provisionVersions", "amendments", "applicability"]
    version_keys = [f.strip() for f in ("datasetReleaseId documentId documentNumber evidence heading legalText legalTextSha256 primaryEvidenceId provisionId provisionVersionId reviewStatus systemTime validTime").split()]
    extra = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, known)))
    items = F.from_json(F.get_json_object("value", "$.provisionVersions"), "array<map<string, string>>")
    extra_in = F.array_except(F.flatten(F.transform(items, lambda m: F.map_keys(m))), F.array(*map(F.lit, version_keys)))
    ids = F.col("d.provisionVersions.provisionVersionId")
    checks = [
        ("NOT_JSON", F.json_object_keys("value").isNull()),
        ("SCHEMA_VERSION", F.coalesce(F.col("d.schemaVersion") != 1, F.lit(True))),
        ("UNKNOWN_KEY", F.size(extra) > 0),
        ("UNKNOWN_KEY", F.size(extra_in) > 0),
        ("OTHER_RELEASE", F.exists("d.provisionVersions", lambda v: v["datasetReleaseId"] != F.col("d.datasetReleaseId"))),
        ("DUPLICATE_ID", F.size(ids) > F.size(F.array_distinct(ids))),
        ("PRIMARY_EVIDENCE", F.exists("d.provisionVersions", lambda v: F.size(F.filter(v["evidence"], lambda e: e["evidenceId"] == v["primaryEvidenceId"])) != 1)),
    ]
    found = F.array_distinct(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks))))
    t = t.withColumn("issues", found)
    return t.filter("size(issues) = 0").select("path", "d.*"), t.select("path", F.explode("issues").alias("issue"))


def versions_of(decoded: DataFrame) -> DataFrame:
    """Provision versions of decoded files in the library's flat form, with their load order."""
    v = decoded.select(F.posexplode("provisionVersions").alias("ord", "v"))
    at = lambda c: F.to_timestamp(c)
    return v.select(
        F.col("v.datasetReleaseId").alias("release_id"), F.col("v.documentId").alias("document_id"), F.col("v.documentNumber").alias("document_number"), F.col("v.provisionId").alias("provision_id"),
        F.col("v.provisionVersionId").alias("version_id"), F.col("v.heading").alias("heading"), F.col("v.legalText").alias("text"), F.col("v.legalTextSha256").alias("text_sha256"), F.col("v.reviewStatus").alias("status"),
        F.to_date("v.validTime.from").alias("valid_from"), F.to_date("v.validTime.to").alias("valid_to"), at("v.systemTime.from").alias("known_from"), at("v.systemTime.to").alias("known_to"),
        F.size("v.evidence").alias("n_evidence"), F.col("v.evidence").alias("evidence"), F.col("v.primaryEvidenceId").alias("primary_evidence_id"), "ord",
    )


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, byte_length) of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_length"))


class Release(NamedTuple):
    """A loaded release; ``reviews`` and ``missing`` (names absent from the archive) are None where it has no such table."""

    release_id: str
    manifest: dict
    versions: DataFrame
    reviews: DataFrame | None
    missing: DataFrame | None


class Store:
    """Releases under one folder: ``releases/<id>`` with a table, its manifest and a pointer to the current one.

    All access goes through Hadoop's file system, so any store that Spark reads will do. Data is written first,
    the manifest then, the pointer last and by a rename: readers see the old release or the new one, whole.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read_json(self, name: str) -> dict | None:
        if not self._fs().exists(self._path(name)):
            return None
        return json.loads(self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()["value"])

    def _write_json(self, name: str, value: dict) -> None:
        fs, spare = self._fs(), self._path(f"{name}.new")
        stream = fs.create(spare, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        # one atomic step, so that there is a current release at every moment
        jvm = self.spark._jvm
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(spare), fs.makeQualified(self._path(name)), how)

    def publish(self, versions: DataFrame, release_id: str, reviewed_by: str, issues: DataFrame, at: str, reviews: DataFrame | None = None, sources: DataFrame | None = None) -> None:
        """Write a release and point to it. Refused: an id that exists, no reviewer, any issue.

        ``reviews`` is the release's review log. ``sources`` has sha256, ext and content of the files that the records
        were taken from: they go to the archive that all releases share, those that are there already excepted,
        and the release keeps their names. A file that does not have its digest is refused (ARCHIVE_MISMATCH).
        """
        if not reviewed_by.strip():
            raise ReleaseError("REVIEWER_MISSING")
        if self._fs().exists(self._path(f"releases/{release_id}")):
            raise ReleaseError("RELEASE_EXISTS", release_id)
        if found := issues.limit(5).collect():
            raise ReleaseError("NOT_PUBLISHABLE", "; ".join(f"{r[0]} {r[1]}" for r in found))
        if sources is not None and (bad := sources.filter(F.sha2("content", 256) != F.col("sha256")).select("sha256").limit(5).collect()):
            raise ReleaseError("ARCHIVE_MISMATCH", " ".join(r[0] for r in bad))
        base = f"{self.root}/releases/{release_id}"
        versions.write.mode("errorifexists").parquet(f"{base}/versions")
        tables = ["versions"]
        if reviews is not None:
            reviews.write.mode("errorifexists").parquet(f"{base}/reviews")
            tables.append("reviews")
        if sources is not None:
            named = sources.select("sha256", F.concat_ws(".", "sha256", "ext").alias("name")).dropDuplicates(["sha256"])
            named.write.mode("errorifexists").parquet(f"{base}/sources")
            tables.append("sources")
            archive(sources, self.archived()).select("name", "sha256", "content").write.mode("errorifexists").parquet(f"{self.root}/archive/{release_id}")
        state = versions.agg(F.bool_or(F.col("status") == "machine_checked")).first()[0]
        manifest = {"releaseId": release_id, "releasedAt": at, "reviewedBy": reviewed_by, "reviewState": "machine_checked" if state else "verified"}
        self._write_json(f"releases/{release_id}/manifest.json", {**manifest, "tables": {t: self._digest(release_id, t) for t in tables}})
        self._point(release_id, at)

    def archived(self) -> DataFrame:
        """(name, sha256, content) of the shared archive: a folder for each release that added to it."""
        empty = self.spark.createDataFrame([], "name string, sha256 string, content binary")
        if not self._fs().exists(self._path("archive")):
            return empty
        folders = [str(f.getPath()) for f in self._fs().listStatus(self._path("archive")) if f.isDirectory()]
        return self.spark.read.schema(empty.schema).parquet(*folders) if folders else empty

    def _digest(self, release_id: str, table: str = "versions") -> dict:
        files = listing(self.spark, f"{self.root}/releases/{release_id}/{table}")
        # a digest of digests: files are gathered by the start of theirs, so no row has those of all files

        def of(column: str):
            return F.sha2(F.array_join(F.sort_array(F.collect_list(column)), ""), 256)

        ranges = files.groupBy(F.substring("sha256", 1, 4).alias("range")).agg(F.count("*").alias("n"), of("sha256").alias("digest"))
        one = ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), of("digest").alias("sha256")).first()
        return {"files": one["files"], "sha256": one["sha256"]}

    def _point(self, release_id: str, at: str) -> None:
        now = self._read_json("current.json") or {"previousReleaseIds": []}
        before = [now["currentReleaseId"], *now["previousReleaseIds"]] if "currentReleaseId" in now else []
        self._write_json("current.json", {"currentReleaseId": release_id, "previousReleaseIds": before[:HISTORY], "updatedAt": at})

    def load(self, release_id: str | None = None, archives: str = "optional", validate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """A release's versions (the current one by default), after the checks of ``load_release``."""
        return self.load_release(release_id, archives, validate).versions

    def load_release(self, release_id: str | None = None, archives: str = "required", validate: Callable[[DataFrame], DataFrame] | None = None) -> Release:
        """A release with its review log and what its archive lacks, after every table was checked against the manifest.

        ``archives``: "required" refuses a release with sources that are not in the archive (FILES_MISSING), "optional"
        lists them in ``missing``; one whose bytes were altered is refused either way (ARCHIVE_MISMATCH).
        ``validate`` gives the issues of the versions as ``publish_issues`` does; any refuses the release
        (VALIDATION_FAILED).
        """
        release_id = release_id or (self._read_json("current.json") or {}).get("currentReleaseId")
        manifest = release_id and self._read_json(f"releases/{release_id}/manifest.json")
        if not manifest:
            raise ReleaseError("RELEASE_NOT_FOUND", str(release_id))
        if manifest["releaseId"] != release_id:
            raise ReleaseError("MANIFEST_MISMATCH", release_id)
        for table, digest in manifest["tables"].items():
            if not self._fs().exists(self._path(f"releases/{release_id}/{table}")):
                raise ReleaseError("FILES_MISSING", f"{release_id} {table}")
            if self._digest(release_id, table) != digest:
                raise ReleaseError("HASH_MISMATCH", f"{release_id} {table}")
        read = lambda t: self.spark.read.parquet(f"{self.root}/releases/{release_id}/{t}") if t in manifest["tables"] else None
        sources, missing = read("sources"), None
        if sources is not None:
            present = self.archived().select("name", F.sha2("content", 256).alias("sha256"))
            state = archive_state(sources, present)
            counts = {r["state"]: r["count"] for r in state.groupBy("state").count().collect()}
            if "mismatch" in counts:
                raise ReleaseError("ARCHIVE_MISMATCH", release_id)
            if "absent" in counts and archives == "required":
                raise ReleaseError("FILES_MISSING", f"{release_id} lacks {counts['absent']} archived sources")
            missing = state.filter("state = 'absent'").select("name")
        versions = read("versions")
        if validate is not None and (found := validate(versions).limit(5).collect()):
            raise ReleaseError("VALIDATION_FAILED", "; ".join(f"{r[0]} {r[1]}" for r in found))
        return Release(release_id, manifest, versions, read("reviews"), missing)

    def rollback(self, at: str) -> str:
        """Point to the release before the current one, which must load in full first, its archived sources excepted."""
        now = self._read_json("current.json")
        if not now or not now["previousReleaseIds"]:
            raise ReleaseError("ROLLBACK_UNAVAILABLE")
        target, *rest = now["previousReleaseIds"]
        self.load(target)
        self._write_json("current.json", {"currentReleaseId": target, "previousReleaseIds": rest, "updatedAt": at})
        return target


def archive(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Files (path, sha256, ext ...) to add to a content-addressed archive: each digest once, none that is there."""
    fresh = files.dropDuplicates(["sha256"]).join(existing.select("sha256"), "sha256", "left_anti")
    return fresh.withColumn("name", F.concat_ws(".", "sha256", "ext"))


def archive_state(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Archived files as ok, absent or mismatch: ``wanted`` has name and sha256, ``present`` name and the digest found."""
    p = present.select("name", F.col("sha256").alias("found"))
    state = F.when(F.col("found").isNull(), "absent").when(F.col("found") != F.col("sha256"), "mismatch").otherwise("ok")
    return wanted.join(p, "name", "left").select("name", state.alias("state"))


def by_digest(store: DataFrame, digest: str) -> DataFrame:
    """The content with that digest; nothing if its bytes no longer have it."""
    return store.filter((F.col("name") == digest) & (F.sha2("content", 256) == F.lit(digest)))


def stored_documents(fetched: DataFrame) -> DataFrame:
    """Names and evidence of fetched documents (url, content_type, content, retrieved_at): the first twelve digits of the
    digest and the extension name the file, its evidence stands beside it as JSON. A document fetched twice has
    a row for each address."""
    t = fetched.withColumn("sha256", F.sha2("content", 256)).withColumn("stem", F.substring("sha256", 1, 12))
    evidence = F.to_json(F.struct(
        F.length("content").alias("byteLength"), F.col("content_type").alias("contentType"), F.lit(None).cast("string").alias("locator"), F.col("url").alias("officialSourceUrl"),
        F.col("retrieved_at").alias("retrievedAt"), F.col("sha256").alias("sourceSha256"),
    ), {"ignoreNullFields": "false"})
    return t.select("url", F.concat_ws(".", "stem", extension_for(F.col("content_type"), F.col("url"))).alias("name"), F.concat("stem", F.lit(".evidence.json")).alias("evidence_name"), evidence.alias("evidence"), "content")


def _rederived(versions: DataFrame, archives: DataFrame, derived: DataFrame) -> DataFrame:
    """``versions`` with the first issue of their re-derivation, null where the text comes out the same."""
    a = archives.select(F.col("sha256").alias("source_sha256"), "present")
    v = versions.join(a, "source_sha256", "left")
    d = derived.select("source_sha256", "provision_id", F.sha2("text", 256).alias("again"))
    readable = derived.select("source_sha256").distinct().withColumn("readable", F.lit(True))
    v = v.join(d, ["source_sha256", "provision_id"], "left").join(readable, "source_sha256", "left")
    issue = (
        F.when(F.col("present").isNull(), "EVIDENCE_NOT_ARCHIVED").when(~F.col("present"), "ARCHIVE_NOT_PRESENT").when(F.col("readable").isNull(), "SOURCE_NOT_DERIVABLE")
        .when(F.col("again").isNull(), "PROVISION_NOT_IN_SOURCE").when(F.col("again") != F.col("text_sha256"), "TEXT_MISMATCH")
    )
    return v.withColumn("issue", issue)


def chain_counts(versions: DataFrame, archives: DataFrame, derived: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row of what a verification of the same inputs covered: derived (records whose text came out the same), vouched,
    archived (sources there are) and unchecked (records whose archive is listed but not there: not looked at,
    which is not the same as failed)."""
    seen = _rederived(versions, archives, derived).agg(F.count_if(F.col("issue").isNull()).alias("derived"), F.count_if(F.coalesce(F.col("issue") == "ARCHIVE_NOT_PRESENT", F.lit(False))).alias("unchecked"))
    vouched = check_vouchers(versions.select(F.col("version_id").alias("target"), "status"), reviews).agg(F.count_if(F.col("voucher") == "ok").alias("vouched"))
    archived = archives.agg(F.count_if("present").alias("archived"))
    return seen.crossJoin(vouched).crossJoin(archived)  # one row each


def verify_chain(versions: DataFrame, archives: DataFrame, derived: DataFrame, reviews: DataFrame) -> DataFrame:
    """Issues of a release, re-derived from its archived sources: (locator, issue).

    ``versions`` has version_id, provision_id, text_sha256, status, source_sha256; ``archives`` sha256 and
    present (false: listed, but not there); ``derived`` source_sha256, provision_id and text as read again from
    the archived bytes; ``reviews`` target and method.
    """
    out = _rederived(versions, archives, derived).filter("issue is not null").select(F.col("version_id").alias("locator"), "issue")
    vouchers = check_vouchers(versions.select(F.col("version_id").alias("target"), "status"), reviews).filter("voucher <> 'ok'").select("target", "voucher")
    orphan = archives.select("sha256").join(versions.select(F.col("source_sha256").alias("sha256")), "sha256", "left_anti").select("sha256", F.lit("ORPHAN_ARCHIVE"))
    return out.union(vouchers).union(orphan)


def archived_sources(store: DataFrame, versions: DataFrame) -> DataFrame:
    """Files of the store (path, sha256 ...) that some record's evidence names: found by digest, not by name."""
    wanted = versions.select(F.explode("evidence.sourceSha256").alias("sha256")).distinct()
    return store.join(wanted, "sha256", "left_semi")
