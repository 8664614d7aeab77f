"""Resolution, catalog, sets, graph, crawl and releases on hand-made rows with known outcomes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import checks
from tessera.operators import graph, quality, sets, temporal
from tessera.plans import service
from tessera.sources import releases, web
from tessera.streaming import crawl

VERSION = "provision_id string, version_id string, valid_from date, valid_to date, known_from timestamp, known_to timestamp, status string, n_evidence int, text string, heading string, document_id string, document_number string, ord int"
D, T = dt.date, dt.datetime


def version(p, v, a, b=None, status="verified", text="", heading=None, doc="doc_a", number="1/2020/NĐ-CP", ord=0, known=T(2019, 1, 1), n=1):
    return (p, v, a, b, known, None, status, n, text, heading, doc, number, ord)


def ask(spark, rows):
    return spark.createDataFrame([(k, p, d, T(2026, 1, 1)) for k, (p, d) in enumerate(rows)], "question_id int, provision_id string, valid_at date, known_at timestamp")


def test_resolution(spark):
    v = spark.createDataFrame([
        version("p", "v1", D(2020, 1, 1), D(2024, 1, 1)), version("p", "v2", D(2024, 1, 1)),
        version("draft", "d1", D(2020, 1, 1), status="under_review"), version("c", "c1", D(2020, 1, 1)), version("c", "c2", D(2021, 1, 1)),
        version("late", "l1", D(2020, 1, 1), known=T(2027, 1, 1)), version("bare", "b1", D(2020, 1, 1), n=0),
    ], VERSION)
    q = ask(spark, [("p", D(2023, 12, 31)), ("p", D(2024, 1, 1)), ("draft", D(2022, 1, 1)), ("c", D(2022, 1, 1)), ("other", D(2022, 1, 1)), ("late", D(2022, 1, 1)), ("bare", D(2022, 1, 1)), ("p", D(2019, 1, 1))])
    got = {r["question_id"]: (r["status"], r["version_id"], r["reason"], list(r["candidates"])) for r in temporal.resolve(q, v).collect()}
    assert got == {
        0: ("resolved", "v1", None, ["v1"]), 1: ("resolved", "v2", None, ["v2"]), 2: ("unknown", None, "MATCH_ONLY_UNVERIFIED", ["d1"]), 3: ("conflict", None, None, ["c1", "c2"]),
        4: ("unknown", None, "NO_MATCHING_VERSION", []), 5: ("unknown", None, "NO_MATCHING_VERSION", []), 6: ("unknown", None, "MATCH_ONLY_UNVERIFIED", ["b1"]), 7: ("unknown", None, "NO_MATCHING_VERSION", []),
    }
    assert [(r["first_id"], r["second_id"]) for r in temporal.collisions(v).collect()] == [("c1", "c2")]
    assert temporal.resolve(q.limit(0), v).count() == 0


def test_catalog_takes_the_first_heading(spark):
    v = spark.createDataFrame([version("p", "v2", D(2024, 1, 1), ord=0), version("p", "v1", D(2020, 1, 1), ord=1, heading="first"), version("p", "v3", D(2025, 1, 1), ord=2, heading="later", status="unverified")], VERSION)
    (r,) = temporal.catalog(v).collect()
    assert r["provisions"][0]["heading"] == "first"
    assert [x["version_id"] for x in r["provisions"][0]["versions"]] == ["v1", "v2", "v3"]


def test_predicates(spark):
    rows = spark.createDataFrame([("2026-02-30",), ("2024-02-29",), ("0050-01-01",), ("2024-1-1",), (None,)], "d string")
    assert [r[0] for r in rows.select(checks.is_date(F.col("d"))).collect()] == [False, True, False, False, False]
    one = spark.range(1)
    ok = lambda c: one.select(c).first()[0]
    assert ok(checks.is_instant(F.lit("2024-01-01T23:59:59.999Z"))) and not ok(checks.is_instant(F.lit("2024-01-01T23:59:59Z")))
    assert ok(checks.is_tagged_id(F.lit("prov_a_B-1"), "prov")) and not ok(checks.is_tagged_id(F.lit("prov_A"), "prov"))
    assert ok(checks.is_safe_path(F.lit("a/b.json"))) and not any(ok(checks.is_safe_path(F.lit(p))) for p in ("/a", "a/../b", "a\\b", "", "c:x"))
    assert ok(checks.is_https_url(F.lit("https://a.b/c"))) and not ok(checks.is_https_url(F.lit("http://a.b")))
    assert ok(checks.host_allowed(F.lit("x.gov.vn"), ["gov.vn"])) and not ok(checks.host_allowed(F.lit("xgov.vn"), ["gov.vn"]))


def test_trace(spark):
    e = spark.createDataFrame([("a", "amending", "alpha", "verified"), ("b", "root", "amending", "verified"), ("c", "x", "alpha", "under_review"), ("d", "alpha", "alpha", "verified")], "edge_id string, source_id string, target_id string, status string")
    q = spark.createDataFrame([(1, "alpha")], "question_id int, provision_id string")
    assert {(r["edge_id"], r["depth"]) for r in service.trace_amendments(q, e, 1).collect()} == {("a", 1), ("d", 1)}
    assert {(r["edge_id"], r["depth"]) for r in service.trace_amendments(q, e, 2).collect()} == {("a", 1), ("b", 2), ("d", 1)}
    with pytest.raises(service.QueryError):
        service.trace_amendments(q, e, 3)


def test_linking(spark):
    s = "document_id string, provision_id string, heading string, ord int"
    a = spark.createDataFrame([("A", "prov_a_1", "Điều 1. Sửa đổi, bổ sung khoản 1 Điều 2", 1), ("A", "prov_a_2", "Điều 2. Sửa đổi Điều 5", 2), ("A", "prov_a_3", "Điều 3. Điều khoản thi hành", 3), ("A", "prov_a_4", "Điều 4. Hiệu lực", 4), ("A", "prov_a_5", "Điều 5. Bãi bỏ Điều 99", 5), ("A", "prov_a_1", "Điều 1. Sửa Điều 2", 6)], s)
    t = spark.createDataFrame([("B", "prov_b_2", "Điều 2. x", 1), ("B", "prov_b_5", "  Điều 5", 2), ("B", "prov_b_2bis", "Điều 2", 3)], s)
    r = spark.createDataFrame([("A", "B", "amends", "2024-01-01")], "document_id string, target_document_id string, relation string, effective_from string")
    got = sorted((x["provision_id"], x["status"], x["target_id"]) for x in graph.link_amendments(a, t, r).collect())
    assert got == [("prov_a_1", "duplicate", "prov_b_2"), ("prov_a_1", "linked", "prov_b_2"), ("prov_a_2", "linked", "prov_b_5"), ("prov_a_3", "NO_ARTICLE", None), ("prov_a_4", "NO_ARTICLE", None), ("prov_a_5", "NOT_FOUND", None)]


def test_sets(spark):
    rows = lambda *r: spark.createDataFrame(r, "k string, h string")
    d = sets.drift(rows(("a", "1"), ("b", "1"), ("c", "1")), rows(("a", "1"), ("b", "2"), ("d", "1")), "k", "h")
    assert {tuple(r) for r in d.collect()} == {("b", "CHANGED"), ("c", "MISSING"), ("d", "ADDED")}
    c = sets.cumulate(rows(("v1", "old"), ("v0", "x")), rows(("v1", "new"), ("v2", "y")), "k", "release", "rel_b")
    assert {tuple(r) for r in c.collect()} == {("v0", "x", "rel_b"), ("v1", "new", "rel_b"), ("v2", "y", "rel_b")}
    v = sets.check_vouchers(spark.createDataFrame([("a", "verified"), ("b", "machine_checked"), ("c", "verified"), ("d", "unverified")], "target string, status string"), spark.createDataFrame([("a", None), ("b", "human")], "target string, method string"))
    assert {r["target"]: r["voucher"] for r in v.collect()} == {"a": "ok", "b": "WRONG_VOUCHER", "c": "UNVOUCHED_RECORD"}


def test_seeded_draws_follow_the_sequence(spark):
    state, want = 42, []
    for _ in range(50):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        v = ((state ^ state >> 15) * (state | 1)) & 0xFFFFFFFF
        v ^= (v + (((v ^ v >> 7) * (v | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        want.append((v ^ v >> 14) / 2**32)
    got = [r[0] for r in spark.range(1, 51).orderBy("id").select(sets.seeded_draws(F.col("id"), 42)).collect()]
    assert got == want


def test_crawl(spark):
    disc = lambda *r: spark.createDataFrame(r, "url string, ord int, lastmod string")
    fetch = lambda *r: spark.createDataFrame(r, "url string, sha256 string")
    empty = spark.createDataFrame([], crawl.STATE)
    out, s1 = crawl.crawl_step(disc(("a", 1, None), ("b", 2, "d1")), empty, fetch(("a", "1"), ("b", "1")), 10, "t1")
    assert {r["outcome"] for r in out.collect()} == {"fetched"}
    out, s2 = crawl.crawl_step(disc(("a", 1, None), ("b", 2, "d1"), ("c", 3, None), ("d", 4, None)), s1, fetch(("a", "2"), ("c", "1")), 2, "t2")
    assert {r["url"]: r["outcome"] for r in out.collect()} == {"a": "fetched", "b": "skipped_lastmod", "c": "fetched", "d": "skipped_budget"}
    out, s3 = crawl.crawl_step(disc(("a", 1, "d2"), ("e", 2, None)), s2, fetch(("a", "2")), 9, "t3")
    assert {r["url"]: r["outcome"] for r in out.collect()} == {"a": "unchanged", "e": "failed"}
    state = {r["url"]: r for r in s3.collect()}
    assert (state["a"]["retrieved_at"], state["a"]["last_checked_at"], state["a"]["lastmod"]) == ("t2", "t3", "d2") and set(state) == {"a", "b", "c"}


def test_crawl_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, None), ("b", 2, None)], "url string, ord int, lastmod string").write.parquet(str(source))
    stream = spark.readStream.schema("url string, ord int, lastmod string").parquet(str(source))
    q = crawl.crawl_stream(stream, str(tmp_path / "state"), lambda urls: urls.withColumn("sha256", F.sha2("url", 256)), 10, str(tmp_path / "cp"), "t1")
    q.awaitTermination(60)
    assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "state/version=0")).count() == 2


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.zip$\n\nUser-agent: special\nDisallow: /\n"
    rules = web.parse_robots(spark.createDataFrame([("h", text), ("none", "")], "host string, text string"))
    q = spark.createDataFrame([(1, "h", "/private/x"), (2, "h", "/private/open/y"), (3, "h", "/a.zip"), (4, "h", "/a.zip?x"), (5, "none", "/private"), (6, "unknown", "/")], "request_id int, host string, path string")
    got = lambda agent: {r["request_id"]: r["allowed"] for r in web.robots_decision(q, rules, agent).collect()}
    assert got("tessera") == {1: False, 2: True, 3: False, 4: True, 5: True, 6: True}
    assert got("special")[2] is False


def test_robots_agents_end_at_any_field(spark):
    text = "User-agent: a\r\nCrawl-delay: 5\nUser-agent: b\nno field here\n# note\n\nUser-agent: C # also\nDisallow: /x\nDisallow:\nSitemap: s\nUser-agent: d\nAllow: /x\n"
    rules = web.parse_robots(spark.createDataFrame([("h", text)], "host string, text string"))
    assert sorted((r["agent"], r["pattern"], r["allow"]) for r in rules.filter("pattern is not null").collect()) == [("b", "/x", False), ("c", "/x", False), ("d", "/x", True)]
    assert {r["agent"] for r in rules.collect()} == {"a", "b", "c", "d"}


def test_payload_marks_and_records(spark):
    inner = '{"docNum":"1/2020","no":"title"}'
    record = '{"title":"A","key":"k","effStatus":{"name":"in force"},"extra":[1],"more":' + inner + ',"docNum":"2/2020"}'
    rows = [
        (1, "0:T3,abc\n1:Tzz,abc\n2:T4,\u00e9\u00e9 see 7:T3,xyz\na:T3,xyz\n3:Tff,short\n" + record), (2, '{"docNum":5,"title":"A"}'), (3, '{"docNum":"1","title":""}'),
        (4, '{"x":{"docNum":"1","title":"A","effFrom":7}}'), (5, '{"docNum":"1","title":"A","effFrom":null,"id":"i"}'), (6, '{"docNum":"1","title":"A"'), (7, None), (8, '{ not json {"docNum":"1","title":"A \\" }"} }'),
    ]
    got = {r["id"]: r for r in web.read_flight(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    assert list(got[1]["chunks"]) == ["abc", "\u00e9\u00e9"] and got[1]["metadata"] == record
    assert [got[k]["metadata"] for k in (2, 3, 4, 6, 7)] == [None] * 5
    assert got[5]["metadata"] == rows[4][1] and got[8]["metadata"] == '{"docNum":"1","title":"A \\" }"}'


def test_links(spark):
    html = '<a href="/b">x</a><a href="c?x=1&amp;y=2">x</a><a href="https://other.org/d">x</a><a href="e#f">x</a><a href="mailto:x@y">m</a><loc>https://h.org/b</loc><lastmod>2024</lastmod><loc>https://h.org/z</loc>'
    got = web.discover_links(spark.createDataFrame([(1, "https://h.org/a/p", html), (2, "https://h.org/", None)], "id int, url string, html string"), "id", "url", "html")
    assert [tuple(r) for r in got.orderBy("ord").collect()] == [(1, 1, "https://h.org/b", "2024"), (1, 2, "https://h.org/a/c?x=1&y=2", None), (1, 3, "https://h.org/z", None)]


def test_flight_and_relations(spark):
    html = "<p class='x'>Điều 1</p>"
    flight = '0:["a"]\n1:{"x":{"docNum":"1/2020","title":"T","effFrom":"2020-03-01","n":{"a":"}"}}}\n2:T%x,%s' % (len(html.encode()), html)
    (r,) = web.read_flight(spark.createDataFrame([(1, flight)], "id int, text string"), "id", "text").collect()
    assert list(r["chunks"]) == [html] and r["metadata"] == '{"docNum":"1/2020","title":"T","effFrom":"2020-03-01","n":{"a":"}"}}'
    payload = '1:{"documentNamesByType":{"10":[{"id":"d1","name":"A"}],"12":[{"id":"d2","name":"B"}],"3":[{"id":"d3","name":"C"}],"99":[{"id":"d4","name":"D"}]}}'
    known, unknown = web.relations(spark.createDataFrame([(1, payload)], "id int, text string"), "id", "text")
    assert {(x["relation"], x["target_document_id"]) for x in known.collect()} == {("amends", "d1"), ("replaces", "d2")}
    assert [tuple(x) for x in unknown.collect()] == [("99", 1)]


def test_release_store(spark, tmp_path):
    store = releases.Store(spark, f"file://{tmp_path}/store")
    v = spark.createDataFrame([version("p", "v1", D(2020, 1, 1))], VERSION)
    none = spark.createDataFrame([], "locator string, issue string")
    with pytest.raises(releases.ReleaseError, match="NOT_PUBLISHABLE"):
        store.publish(v, "rel_a", "someone", spark.createDataFrame([("v1", "X")], none.schema), "t")
    store.publish(v, "rel_a", "someone", none, "t1")
    with pytest.raises(releases.ReleaseError, match="RELEASE_EXISTS"):
        store.publish(v, "rel_a", "someone", none, "t1")
    with pytest.raises(releases.ReleaseError, match="ROLLBACK_UNAVAILABLE"):
        store.rollback("t")
    store.publish(v.withColumn("status", F.lit("machine_checked")), "rel_b", "someone", none, "t2")
    assert store.load().first()["status"] == "machine_checked"
    assert store.rollback("t3") == "rel_a" and store.load().first()["status"] == "verified"
    part = next((tmp_path / "store/releases/rel_b/versions").glob("*.parquet"))
    v.write.mode("overwrite").parquet(f"{tmp_path}/store/releases/rel_b/versions")
    assert not part.exists()
    with pytest.raises(releases.ReleaseError, match="HASH_MISMATCH"):
        store.load("rel_b")


def test_release_with_archive(spark, tmp_path):
    import hashlib
    import shutil

    store = releases.Store(spark, f"file://{tmp_path}/store")
    v = spark.createDataFrame([version("p", "v1", D(2020, 1, 1))], VERSION)
    none = spark.createDataFrame([], "locator string, issue string")
    reviews = spark.createDataFrame([("v1", "someone", "t", "human")], "target string, reviewed_by string, reviewed_at string, method string")
    row = lambda b: (hashlib.sha256(b).hexdigest(), "pdf", b)
    files = lambda *contents: spark.createDataFrame([row(c) for c in contents], "sha256 string, ext string, content binary")
    with pytest.raises(releases.ReleaseError, match="ARCHIVE_MISMATCH"):
        store.publish(v, "rel_a", "someone", none, "t", reviews, spark.createDataFrame([("0" * 64, "pdf", b"x")], "sha256 string, ext string, content binary"))
    store.publish(v, "rel_a", "someone", none, "t1", reviews, files(b"one", b"one", b"two"))
    store.publish(v, "rel_b", "someone", none, "t2", reviews, files(b"two", b"three"))
    assert store.archived().count() == 3
    loaded = store.load_release()
    assert (loaded.release_id, loaded.reviews.count(), loaded.missing.count()) == ("rel_b", 1, 0)
    with pytest.raises(releases.ReleaseError, match="VALIDATION_FAILED"):
        store.load_release(validate=lambda versions: versions.select("version_id", F.lit("BAD")))
    # what the first release archived is gone: the second lacks one of its files
    shutil.rmtree(tmp_path / "store/archive/rel_a")
    with pytest.raises(releases.ReleaseError, match="FILES_MISSING"):
        store.load_release("rel_b")
    assert [r["name"] for r in store.load_release("rel_b", "optional").missing.collect()] == [row(b"two")[0] + ".pdf"]
    altered = spark.createDataFrame([(row(b"two")[0] + ".pdf", row(b"two")[0], b"other")], "name string, sha256 string, content binary")
    altered.write.parquet(f"{tmp_path}/store/archive/rel_a")
    with pytest.raises(releases.ReleaseError, match="ARCHIVE_MISMATCH"):
        store.load_release("rel_b", "optional")
    shutil.rmtree(tmp_path / "store/releases/rel_b/reviews")
    with pytest.raises(releases.ReleaseError, match="FILES_MISSING"):
        store.load_release("rel_b", "optional")


def test_batch_outcomes(spark):
    from tessera.streaming import crawl

    batch = spark.createDataFrame([(u,) for u in "abcde"], "url string")
    results = spark.createDataFrame([("a", None, True), ("b", None, False), ("c", "TIMEOUT", None), ("d", "NO_ARTICLES", None)], "url string, error string, all_passed boolean")
    ledger = spark.createDataFrame([("a", "refused", "OLD", "t0"), ("z", "ingested", None, "t0")], "url string, status string, reason string, at string")
    out, after, tallies = crawl.batch_outcomes(batch, results, ledger, "t1")
    assert {tuple(r) for r in out.collect()} == {("a", "ingested", None), ("b", "needs_review", None), ("c", "transient", "TIMEOUT"), ("d", "refused", "NO_ARTICLES"), ("e", "refused", "NO_RESULT")}
    assert {(r["url"], r["status"], r["at"]) for r in after.collect()} == {("a", "ingested", "t1"), ("b", "needs_review", "t1"), ("d", "refused", "t1"), ("e", "refused", "t1"), ("z", "ingested", "t0")}
    assert {tuple(r) for r in tallies.collect()} == {("ingested", 1), ("needs_review", 1), ("transient", 1), ("refused", 2)}


def test_publish_gate(spark):
    e = "array<struct<url: string, retrieved_at: string>>"
    rows = [("v1", "p", "t", D(2020, 1, 1), None, [("https://a.gov.vn/x", "2024")]), ("v2", "p", "t", D(2021, 1, 1), None, [("https://evil.org/x", "2030")])]
    v = spark.createDataFrame(rows, f"version_id string, provision_id string, text string, valid_from date, valid_to date, evidence {e}")
    v = v.withColumn("status", F.lit("verified")).withColumn("known_from", F.lit(T(2020, 1, 1))).withColumn("known_to", F.lit(None).cast("timestamp")).withColumn("text_sha256", F.when(F.col("version_id") == "v1", F.sha2("text", 256)).otherwise("x"))
    am = spark.createDataFrame([("m1", "p", "verified"), ("m2", "gone", "under_review")], "amendment_id string, target_id string, status string")
    ap = spark.createDataFrame([("c1", "under_review")], "condition_id string, status string")
    got = {tuple(r) for r in quality.publish_issues(v, am, ap, "2025", ["gov.vn"]).collect()}
    assert got == {("v2", "TEXT_HASH_MISMATCH"), ("v2", "HOST_NOT_ALLOWED"), ("v2", "RETRIEVED_IN_FUTURE"), ("v2", "OVERLAPPING_VERSIONS"), ("m2", "AMENDMENT_NOT_VERIFIED"), ("m2", "TARGET_NOT_IN_RELEASE"), ("c1", "APPLICABILITY_NOT_VERIFIED")}


def test_chain_verification(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    v = spark.createDataFrame([("v1", "p1", sha("a"), "verified", "s1"), ("v2", "p2", sha("tampered"), "verified", "s1"), ("v3", "p3", sha("c"), "machine_checked", "s2"), ("v4", "p4", sha("d"), "verified", "s9"), ("v5", "p5", sha("e"), "verified", "s1")], "version_id string, provision_id string, text_sha256 string, status string, source_sha256 string")
    a = spark.createDataFrame([("s1", True), ("s2", False), ("s3", True)], "sha256 string, present boolean")
    d = spark.createDataFrame([("s1", "p1", "a"), ("s1", "p2", "b")], "source_sha256 string, provision_id string, text string")
    r = spark.createDataFrame([("v1", "human"), ("v2", None), ("v3", "machine"), ("v4", "machine")], "target string, method string")
    got = {tuple(x) for x in releases.verify_chain(v, a, d, r).collect()}
    assert got == {("v2", "TEXT_MISMATCH"), ("v3", "ARCHIVE_NOT_PRESENT"), ("v4", "EVIDENCE_NOT_ARCHIVED"), ("v5", "PROVISION_NOT_IN_SOURCE"), ("v4", "WRONG_VOUCHER"), ("v5", "UNVOUCHED_RECORD"), ("s3", "ORPHAN_ARCHIVE")}


def test_decoding(spark):
    import json

    version_ = {"datasetReleaseId": "rel_a", "documentId": "doc_a", "documentNumber": "1", "evidence": [{"evidenceId": "ev_1", "officialSourceUrl": "https://a", "retrievedAt": "t", "sourceSha256": "s"}], "heading": None, "legalText": "t", "legalTextSha256": "h", "primaryEvidenceId": "ev_1", "provisionId": "prov_a", "provisionVersionId": "pv_a", "reviewStatus": "verified", "systemTime": {"from": "2024-01-01T00:00:00.000Z"}, "validTime": {"from": "2024-01-01"}}
    good = {"schemaVersion": 1, "datasetReleaseId": "rel_a", "provisionVersions": [version_], "amendments": []}
    files = {"good": good, "key": {**good, "more": 1}, "inner": {**good, "provisionVersions": [{**version_, "more": 1}]}, "twice": {**good, "provisionVersions": [version_, version_]}, "other": {**good, "datasetReleaseId": "rel_b"}, "schema": {**good, "schemaVersion": 2}}
    df = spark.createDataFrame([(k, json.dumps(f)) for k, f in files.items()] + [("broken", "{")], "path string, value string")
    ok, issues = releases.decode(df)
    assert [r["path"] for r in ok.collect()] == ["good"]
    assert {tuple(r) for r in issues.collect() if r["path"] != "broken"} == {("key", "UNKNOWN_KEY"), ("inner", "UNKNOWN_KEY"), ("twice", "DUPLICATE_ID"), ("other", "OTHER_RELEASE"), ("schema", "SCHEMA_VERSION")}
    assert releases.versions_of(ok).first()["valid_from"] == D(2024, 1, 1)


def test_sessions_round_to_seconds(spark):
    at = lambda s, us=0: T(2024, 1, 1) + dt.timedelta(seconds=s, microseconds=us)
    # gaps in rounded seconds: 9 | 10 | 10 (a half down to 20, a half up to 10) | 9
    rows = [(1, at(0, 600_000)), (1, at(10, 400_000)), (2, at(0, 400_000)), (2, at(9, 600_000)), (3, at(10, 500_000)), (3, at(19, 500_001)), (4, at(10, 500_001)), (4, at(20, 499_999))]
    got = crawl.sessions(spark.createDataFrame(rows, "u int, ts timestamp_ntz"), "ts", "u", 10).groupBy("u").agg(F.count("*").alias("n"))
    assert {r["u"]: r["n"] for r in got.collect()} == {1: 1, 2: 2, 3: 2, 4: 1}


def test_trace_answers_each_edge_once(spark):
    import random

    from tessera.operators import graph

    rng = random.Random(5)
    edges = [(f"e{k}", rng.randint(0, 12), rng.choice([None, *range(13)]) if k % 9 == 0 else rng.randint(0, 12)) for k in range(40)]
    asked = [(k % 7, k) for k in range(13)]  # several provisions a question
    e = spark.createDataFrame(edges + edges[:5], "edge_id string, source_id int, target_id int")
    q = spark.createDataFrame(asked, "question_id int, provision_id int")
    for depth in (1, 2):
        want = {}
        for question, p in asked:
            first = [x for x in edges if p in x[1:]]
            for x in edges:
                if x in first:
                    want[question, x[0]] = 1
                elif depth == 2 and {s for _, s, _ in first} & set(x[1:]):
                    want.setdefault((question, x[0]), 2)
        answers = graph.trace(q, e, depth)
        assert sorted(tuple(r) for r in answers.collect()) == sorted((*k, d) for k, d in want.items())
    # answers are not shuffled again: above the join that makes them there is no aggregate
    plan = answers._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("Union")
