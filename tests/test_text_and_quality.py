"""Text functions, search, references, citations, differences, extraction and cross-checks on hand-made rows."""

import datetime as dt
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import citations, compare, extract, quality, references, search
from tessera.plans import service

D, T = dt.date, dt.datetime


def column(spark, f, *values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


def test_scalars(spark):
    assert column(spark, text.fold, "Trả lương ĐÚNG hạn", "Ångström ÉÈ", None) == ["tra luong dung han", "angstrom ee", None]
    (t,) = column(spark, text.tokens, "trả lương đúng hạn của a")
    assert t == ["tra", "luong", "dung", "han", "tra_luong", "luong_dung", "dung_han"]
    assert column(spark, text.tokens, "", "của") == [[], []]
    assert len(set(column(spark, text.citation_key, "100/2019/NĐ-CP", "100-2019-nd-cp", "100 2019 NĐ CP", "100/2019/ND-CP"))) == 1
    assert column(spark, text.heading_article_number, "Điều 12. x", "Điều 3đ", "Điều 3a", "  Điều 3", "Điều 0. x") == [12, 3, None, None, None]
    assert column(spark, text.own_article_number, "  Điều 7x", "x Điều 7", None) == [7, None, None]
    assert column(spark, text.referenced_article_number, "Điều 1. Sửa Điều 2 và Điều 9", "Điều 1. Điều khoản thi hành") == [9, None]
    assert column(spark, text.gazette_article_number, "Điều 4 : x", "Điều 4 x") == [4, None]
    assert column(spark, text.iso_from_spoken_date, "Hà Nội, NGÀY 9 tháng 8 năm 2026", "từ ngày 01/07/2026", "01/07/2026") == ["2026-08-09", "2026-07-01", None]
    assert column(spark, text.iso_from_day_month_year, " 1/2/2026 ", "1-2-2026") == ["2026-02-01", None]
    assert column(spark, text.slug, "127/2026/TT-BCA", "Đ") == ["1272026ttbca", "vanban"]
    assert column(spark, text.html_to_text, "a<br/>b &amp;lt; &#x1F600;&#233; &nbsp;c</p>  \n d", "plain") == ["a\nb &lt; 😀é  c\n d", "plain"]
    assert column(spark, text.plain_text, "<script>x</script><p>a&nbsp; b</p>") == ["a b"]
    assert column(spark, text.subject_of, "a b c d e f g h i j;") == ["a b c d e f g h"]
    assert column(spark, text.nfc_exact, unicodedata.normalize("NFD", "Điều é")) == ["Điều é"]
    assert [r for r in column(spark, lambda c: text.match_band(c.cast("double")), "1", "0.95", "0.5", None)] == ["exact", "close", "different", "not_checked"]


def test_search(spark):
    docs = spark.createDataFrame([(1, "Tiền lương", "Người sử dụng lao động trả lương đúng hạn."), (2, "Thời hạn", "Thời hạn trả lương là 30 ngày.\nKhác."), (3, "Nghỉ phép", "Người lao động nghỉ phép năm.")], "id int, heading string, text string")
    q = spark.createDataFrame([(1, "trả lương"), (2, "thuế thu nhập"), (3, "")], "query_id int, query string")
    hits = [(r["query_id"], r["id"]) for r in search.bm25(q, docs, "id", "text", "heading").orderBy("query_id", "rank").collect()]
    assert [h for h in hits if h[0] == 1] and {h[1] for h in hits} <= {1, 2} and {h[0] for h in hits} == {1}
    best = search.best_line(docs, "text", F.array(F.lit("khac"))).filter("id = 2").first()
    assert (best["hits"], best["snippet"]) == (1, "Khác.")
    v = docs.select(F.concat(F.lit("v"), "id").alias("version_id"), F.concat(F.lit("p"), "id").alias("provision_id"), "heading", "text", F.when(F.col("id") == 1, "under_review").otherwise("verified").alias("status"), F.lit(D(2020, 1, 1)).alias("valid_from"), F.when(F.col("id") == 2, F.lit(D(2022, 1, 1))).alias("valid_to"), F.lit(T(2020, 1, 1)).alias("known_from"), F.lit(None).cast("timestamp").alias("known_to"))
    asked = spark.createDataFrame([("q", "trả lương")], "query_id string, query string")
    found, flags = service.search_provisions(asked, v, D(2021, 1, 1), T(2026, 1, 1))
    assert [r["version_id"] for r in found.collect()] == ["v2"]
    found, flags = service.search_provisions(asked, v, D(2024, 1, 1), T(2026, 1, 1))
    assert found.count() == 0 and tuple(flags.first()) == ("q", False, True)
    found, flags = service.search_provisions(asked, v, D(2005, 1, 1), T(2026, 1, 1))
    assert tuple(flags.first()) == ("q", True, False)


def test_reference_spans():
    def short(t):
        return [(r["kind"], r["article"], r["clause"], r["point"], r["chapter"], r["number"], r["title"]) for r in references.find_references(t)]

    assert short("theo điểm a khoản 1 Điều 5 của Luật An ninh mạng và các luật") == [("named_document", 5, 1, "a", None, None, "An ninh mạng")]
    assert short("Điều 7 của Nghị định này và Chương IV của\nNghị định này") == [("same_document", 7, None, None, None, None, None), ("same_document", None, None, None, "IV", None, None)]
    assert short("khoản 2 Điều 1 Nghị định số 100/2019/NĐ-CP, sửa") == [("numbered_document", 1, 2, None, None, "100/2019/NĐ-CP", None)]
    assert short("điểm b khoản 1 Điều này") == [("same_document", None, 1, "b", None, None, None)]
    assert short("theo quy định của pháp luật có liên quan") == []
    t = "xem Điều 7 của Luật này"
    (r,) = references.find_references(t)
    assert t[r["start"] : r["end"]] == r["span"]


def test_reference_resolution(spark):
    schema = "provision_id string, version_id string, document_id string, document_number string, heading string, valid_from date, valid_to date, known_from timestamp, known_to timestamp, status string, n_evidence int, text string"
    k = T(2019, 1, 1)
    v = spark.createDataFrame([
        ("p1", "p1v1", "d", "1/2020/NĐ-CP", "Điều 1. x", D(2020, 1, 1), None, k, None, "verified", 1, "theo Điều 2 của Nghị định này; Điều 5 Luật An ninh mạng; Nghị định số 9/2019/NĐ-CP; Chương II của Nghị định này; khoản 1 Điều này"),
        ("p2", "p2v1", "d", "1/2020/NĐ-CP", "Điều 2. x", D(2020, 1, 1), D(2024, 1, 1), k, None, "verified", 1, "old"), ("p2", "p2v2", "d", "1/2020/NĐ-CP", "Điều 2. x", D(2024, 1, 1), None, k, None, "verified", 1, "new"),
    ], schema)
    q = spark.createDataFrame([(1, "p1", D(2023, 1, 1), T(2026, 1, 1)), (2, "p1", D(2025, 1, 1), T(2026, 1, 1))], "question_id int, provision_id string, valid_at date, known_at timestamp")
    got = {}
    for r in service.references_of(service.provision_at(q, v), v).collect():
        got.setdefault(r["span_id"].split("#")[0], []).append((r["start"], r["target_version_id"], r["reason"]))
    answers = {k: [x[1:] for x in sorted(v)] for k, v in got.items()}
    assert answers["1"] == [("p2v1", None), (None, "NOT_IN_CORPUS"), (None, "NOT_IN_CORPUS"), (None, "UNSUPPORTED"), ("p1v1", None)]
    assert answers["2"][0] == ("p2v2", None)


def test_citations(spark):
    schema = "provision_id string, version_id string, document_number string, heading string, valid_from date, valid_to date, known_from timestamp, known_to timestamp, status string, text string"
    k = T(2019, 1, 1)
    words = "người sử dụng lao động phải trả lương đúng hạn cho người lao động theo hợp đồng đã ký kết"
    v = spark.createDataFrame([("p1", "a", "100/2019/NĐ-CP", "Điều 1. x", D(2020, 1, 1), D(2024, 1, 1), k, None, "verified", "cũ"), ("p1", "b", "100/2019/NĐ-CP", "Điều 1. x", D(2024, 1, 1), None, k, None, "verified", words), ("p2", "c", "100/2019/NĐ-CP", "Điều 2. x", D(2030, 1, 1), None, k, None, "verified", "z"), ("p3", "d", "100/2019/NĐ-CP", "Điều 3", D(2020, 1, 1), None, k, None, "verified", "z"), ("p4", "e", "100/2019/NĐ-CP", "Điều 3", D(2020, 1, 1), None, k, None, "verified", "z")], schema)
    at = (D(2025, 1, 1), T(2026, 1, 1))
    q = [(1, "100-2019-nd-cp", 1, words), (2, "100/2019/NĐ-CP", 1, words + " thêm vài chữ"), (3, "100/2019/NĐ-CP", 1, "cũ"), (4, "1/1", 1, None), (5, "100/2019/NĐ-CP", 77, None), (6, "100/2019/NĐ-CP", 2, "z"), (7, "100/2019/NĐ-CP", 3, None), (8, "100 2019 ND CP", 1, None)]
    got = {r["question_id"]: (r["exists"], r["in_force"], r["band"], r["reason"]) for r in citations.check(spark.createDataFrame([(*x, *at) for x in q], "question_id int, document_number string, article int, quote string, valid_at date, known_at timestamp"), v).collect()}
    assert got == {
        1: (True, True, "exact", None), 2: (True, True, "close", None), 3: (True, True, "different", None), 4: (False, False, "not_checked", "DOCUMENT_NOT_IN_CORPUS"), 5: (False, False, "not_checked", "ARTICLE_NOT_IN_DOCUMENT"),
        6: (True, False, "not_checked", "NO_MATCHING_VERSION"), 7: (True, False, "not_checked", "ARTICLE_AMBIGUOUS"), 8: (True, True, "not_checked", None),
    }
    for bad in ({"article": 0}, {"query": " "}, {"limit": 21}, {"number": ""}, {"request_id": "short"}):
        with pytest.raises(service.QueryError, match="INVALID_INPUT"):
            service.validate(**bad)


def test_too_many_results(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "question_id int, x string")
    kept, refused = service.refuse_over(df, ["question_id"], 1)
    assert {tuple(r) for r in kept.collect()} == {(2, "c"), (None, "d")}
    assert [tuple(r) for r in refused.collect()] == [(1, "TOO_MANY_RESULTS")]


def test_differences(spark):
    rng = random.Random(1)
    for _ in range(150):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        chunks = compare.line_chunks(a, b)
        assert [x for op, ls in chunks if op != "added" for x in ls] == a
        assert [x for op, ls in chunks if op != "removed" for x in ls] == b
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        assert sum(len(ls) for op, ls in chunks if op == "unchanged") == best[0][0]
        assert all(x[0] != y[0] for x, y in zip(chunks, chunks[1:]))
    assert [op for op, _ in compare.line_chunks(["a", "x"], ["a", "y"])] == ["unchanged", "removed", "added"]
    df = spark.createDataFrame([(1, "a\n b\nc", "a\n b\nd"), (2, None, ""), (3, "\n" * 2000, "x")], "k int, a string, b string")
    got = {r["k"]: r["d"] for r in df.select("k", compare.diff_lines(F.col("a"), F.col("b")).alias("d")).collect()}
    assert [(c["operation"], c["lines"]) for c in got[1]] == [("unchanged", ["a", " b"]), ("removed", ["c"]), ("added", ["d"])]
    assert got[3] is None
    two = df.withColumn("s", compare.dice(F.col("a"), F.col("b"))).select("k", "s").join(compare.dice_by_counts(df, "k", "a", "b"), "k").collect()
    assert all(r["s"] == pytest.approx(r["similarity"]) for r in two)


LINE = "doc_id string, page int, page_width double, x double, font_size double, ord int, text string"


def gazette(doc, rows):
    return [(doc, r[1] if len(r) > 1 and isinstance(r[1], int) else 1, 595.0, r[2] if len(r) > 2 else 113.0, r[3] if len(r) > 3 else 19.9, k, r[0]) for k, r in enumerate(rows)]


def test_gazette(spark):
    good = [("CÔNG BÁO 1",), ("Số: 1/2026/TT-BCA",), ("Điều 1. Phạm vi",), ("1. Một",), ("Chương IV của Thông tư này.",), ("nhỏ", 1, 113.0, 14.1), ("Chương II QUY ĐỊNH",), ("ngoài",), ("CÔNG BÁO 2", 2), ("Điều 2. Hiệu lực", 2), ("Thông tư có hiệu lực từ ngày 01/07/2026.", 2), ("BỘ TRƯỞNG", 2, 400.0), ("Nguyễn A", 2, 420.0), ("CÔNG BÁO 3", 3), ("PHỤ LỤC I", 3), ("Điều 1. của phụ lục", 3), ("trang cuối", 3)]
    skipped = [("Điều 1. a",), ("Điều 3. b",)]
    lines = spark.createDataFrame(gazette("g", good) + gazette("s", skipped) + gazette("n", [("không có",)]), LINE)
    parts, documents = extract.segment_gazette(lines)
    part = {r["text"]: (r["part"], r["article"]) for r in parts.filter("doc_id = 'g'").collect()}
    assert part["CÔNG BÁO 1"][0] == part["CÔNG BÁO 3"][0] == "running" and part["Số: 1/2026/TT-BCA"][0] == "preamble" and part["nhỏ"][0] == "apparatus"
    assert part["Chương IV của Thông tư này."] == ("article", 1) and part["Chương II QUY ĐỊNH"][0] == "structure" and part["ngoài"][0] == "unassigned"
    assert part["BỘ TRƯỞNG"][0] == part["Nguyễn A"][0] == "signature" and part["PHỤ LỤC I"][0] == part["Điều 1. của phụ lục"][0] == "annex"
    assert {r["doc_id"]: (r["n_articles"], r["refusal"]) for r in documents.collect()} == {"g": (2, None), "s": (2, "ARTICLES_NOT_CONTINUOUS"), "n": (0, "NO_ARTICLES")}
    ref = spark.createDataFrame([("g", "1/2026/TT-BCA", "2026-07-01")], "doc_id string, document_number string, effective_from string")
    p = extract.gazette_provisions(parts, documents, ref).orderBy("article").collect()
    assert [(r["provision_id"], r["version_id"]) for r in p] == [("prov_congbao_12026ttbca_d1", "pv_congbao_12026ttbca_d1_e20260701"), ("prov_congbao_12026ttbca_d2", "pv_congbao_12026ttbca_d2_e20260701")]
    assert p[0]["text"] == "Điều 1. Phạm vi\n1. Một\nChương IV của Thông tư này."


def test_marked_pages(spark):
    html = '<p class="prov-chapter">Chương I</p><p class="prov-article" id="a">Điều 1. A &amp; B</p><p class="prov-content">một</p><p class="prov-new">hai</p><p class="prov-section">Mục 1</p><p class="prov-content">lạc</p><p class="prov-article">Điều 2. C</p>'
    paras = extract.paragraphs(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html")
    assert [r["role"] for r in paras.orderBy("ord").collect()] == ["structure", "article", "content", "unknown", "structure", "content", "article"]
    got = [(r["no"], r["heading"], r["text"]) for r in extract.marked_provisions(paras, "id").orderBy("no").collect()]
    assert got == [(1, "Điều 1. A & B", "một\nhai"), (2, "Điều 2. C", "Điều 2. C")]


def test_cross_checks(spark):
    ref = spark.createDataFrame([("d", "1/2026/TT-BCA", "2026-08-19", "2026-10-01")], "doc_id string, document_number string, issued_on string, effective_from string")
    pre = spark.createDataFrame([("d", 1, "Số: 1/2026/ TT-BCA"), ("d", 2, "Hà Nội, ngày 19 tháng 8 năm 2026")], "doc_id string, ord int, text string")
    body = spark.createDataFrame([("d", 1, 1, "Điều 1. x"), ("d", 1, 2, "1. a"), ("d", 1, 3, "a) x"), ("d", 1, 4, "b) x"), ("d", 1, 5, "3. c"), ("d", 1, 6, "a) x"), ("d", 1, 7, "2.1 không"), ("d", 2, 8, "1. Thông tư có hiệu lực từ ngày 01/10/2026"), *(("d", 2, 9 + k, f"{c}) x") for k, c in enumerate("abcdđeg"))], "doc_id string, article int, ord int, text string")
    two = spark.createDataFrame([("d", "a b", None)], "doc_id string, text string, second string")
    status = lambda df: df.first()["status"]
    assert [status(quality.check_number(pre, ref)), status(quality.check_issue_date(pre, ref)), status(quality.check_effective_date(body, ref))] == ["pass"] * 3
    other = ref.withColumn("effective_from", F.lit("2026-10-02")).withColumn("issued_on", F.lit("2026-08-18")).withColumn("document_number", F.lit("2/2026"))
    assert [status(quality.check_number(pre, other)), status(quality.check_issue_date(pre, other)), status(quality.check_effective_date(body, other))] == ["flag"] * 3
    assert [(r["article"], r["expected"], r["found"]) for r in quality.numbering_breaks(body).collect()] == [(1, "2", "3")]
    assert status(quality.check_second_reading(two)) == "not_available" and status(quality.check_second_reading(two.withColumn("second", F.lit("b a")))) == "pass"
    rolled = quality.roll_up(quality.check_number(pre, ref).union(quality.check_numbering(body, ref)).union(quality.check_second_reading(two))).first()
    assert (rolled["flagged"], rolled["not_available"], rolled["all_passed"]) == (["NUMBERING"], ["SECOND_EXTRACTOR"], False)
    records = spark.createDataFrame([("d", None, "Điều 1. x\n1. a")], "doc_id string, heading string, text string")
    left = quality.coverage(body.select("doc_id", "ord", "text"), records)
    assert 1 not in [r["ord"] for r in left.collect()] and 3 in [r["ord"] for r in left.collect()]


def test_drafts_from_payloads(spark):
    html = '<p class="prov-article" id="a1">Điều 1. A</p><p class="prov-content">một</p><p class="prov-clause">hai &gt; ba</p><p class="prov-article">Điều 2. không id</p><p class="prov-article" id="a3">Điều 3. C</p>'
    meta = '1:{"docNum":"1/2020","effFrom":"2020-03-01T00:00:00","effTo":null,"id":"77","title":"t"}'
    body = "2:T%x,%s" % (len(html.encode()), html)
    df = spark.createDataFrame([(1, f"0:x\n{meta}\n{body}"), (2, body), (3, meta.replace("2020-03-01T00:00:00", "x") + "\n" + body)], "id int, text string")
    drafts, issues = extract.draft_from_payloads(df, "id", "text")
    got = [(r["provision_id"], r["version_id"], r["document_id"], r["text"]) for r in drafts.orderBy("provision_id").collect()]
    assert got == [("prov_vbpl_a1", "pv_vbpl_a1_e20200301", "doc_vbpl_77", "một\nhai > ba"), ("prov_vbpl_a3", "pv_vbpl_a3_e20200301", "doc_vbpl_77", "Điều 3. C")]
    assert {tuple(r) for r in issues.collect()} == {(2, "document", "METADATA_NOT_FOUND"), (3, "document", "EFFECTIVE_DATE_MISSING"), (1, "article 2", "NO_ID")}


def test_review_queue(spark):
    rows = [(k, f"v{k}", ("verified", "machine_checked", "under_review")[k % 3]) for k in range(300)]
    q = quality.review_queue(spark.createDataFrame(rows, "ord int, version_id string, status string"), 0.3, 9)
    got = q.groupBy("queue", "status").count().collect()
    counts = {(r["queue"], r["status"]): r["count"] for r in got}
    assert counts[("must_read", "under_review")] == 100 and set(counts) == {("must_read", "under_review"), ("sampled", "machine_checked")}
    assert 15 < counts[("sampled", "machine_checked")] < 45


def test_promotion(spark):
    r = spark.createDataFrame([("v1", "under_review"), ("v2", "verified")], "version_id string, status string")
    out, audit = quality.promote(r, "v1", "someone", "t")
    assert out.filter("status = 'verified'").count() == 2 and audit.first()["method"] == "human"
    for target, who in (("v2", "x"), ("v9", "x"), ("v1", " ")):
        with pytest.raises(ValueError):
            quality.promote(r, target, who, "t")


def test_compare_versions(spark):
    v = spark.createDataFrame([("a", "p", "x\ny", "verified"), ("b", "p", "x\nz", "verified"), ("c", "q", "x", "verified"), ("d", "p", "x", "unverified")], "version_id string, provision_id string, text string, status string")
    q = spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "d", "c"), (4, "a", "none"), (5, "a", "a")], "question_id int, from_id string, to_id string")
    got = {r["question_id"]: (r["error"], r["changed"]) for r in service.compare_versions(q, v).collect()}
    assert {k: x[0] for k, x in got.items()} == {1: None, 2: "DIFFERENT_PROVISIONS", 3: "VERSION_NOT_SERVABLE", 4: "VERSION_NOT_FOUND", 5: None}
    assert got[1][1] is True and got[5][1] is False


def test_reference_spans_read_whole_texts(spark, tmp_path):
    """References in the text itself are found, at the places where a search by hand has them."""
    from tessera.plans import registry

    long = "từ " * 30_000
    texts = {0: None, 1: "", 2: "xem Điều 5 của Luật này, Điều 7 của Luật này.", 3: long + "khoản 3 Điều này" + long}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.QUERIES["reference_spans"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["article"] or 0) for r in rows) == [(0, 1), (1, 0), (2, 3), (2, 5), (2, 7), (3, 0), (3, 4)]
    have = registry.QUERIES["reference_spans_whole"](spark, str(tmp_path)).collect()
    sentences = {0: "khoản 2 Điều 1 của Nghị định này", 1: "Nghị định số 1/2019/NĐ-CP", 2: "điểm a khoản 1 Điều 3 Luật An ninh mạng", 3: "khoản 2 Điều 4 của Nghị định này"}
    tails = {0: ("theo ", "."), 1: ("theo ", " của Chính phủ"), 2: ("", " và các luật khác"), 3: ("theo ", ".")}
    for i, t in texts.items():
        sentence, half = sentences[i].join(tails[i]), len(t or "") // 2
        whole = sentence if t is None else "\n".join((t[:half], sentence, t[half:], sentence))
        if t is None:
            whole += "\n" + sentence
        wanted = [sentences[i], "Điều 5 của Luật này", "Điều 7 của Luật này", "khoản 3 Điều này"]
        brute = sorted((k, k + len(w), w) for w in wanted for k in range(len(whole)) if whole.startswith(w, k))
        assert [(r["start"], r["end"], r["span"]) for r in sorted((r for r in have if r["doc_id"] == i), key=lambda r: r["ord"])] == brute


def test_search_covers_unlabelled_documents(spark, tmp_path):
    """The search of all documents finds an unlabelled one; review states decide where they are asked for."""
    from tessera.plans import registry

    spark.createDataFrame([(k, t, "s", "en") for k, t in enumerate(["harbour crane", "harbour wall", "river crane", "none"])], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(9, "harbour crane")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {name: [r["doc_id"] for r in registry.QUERIES[name](spark, str(tmp_path)).orderBy("rank").collect()] for name in ("bm25_topk_all", "bm25_topk")}
    assert found["bm25_topk_all"] == [0]
    assert found["bm25_topk"] == [1]


def test_blanks_are_collapsed_as_runs(spark):
    import re

    wide = "       　﻿ "
    rng = random.Random(3)
    ts = ["".join(rng.choice("ab é​⿿ \t\n\x0b\r" + wide) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    old = re.compile(f"[ \t\n\x0b\f\r{wide}]+")
    assert column(spark, text.collapse, *ts) == [old.sub(" ", t).strip(" ") for t in ts]
    assert column(spark, text.normalise_line, *ts) == [re.sub("[ \t ]+", " ", unicodedata.normalize("NFC", t)).strip(" ") for t in ts]


def test_similarity_of_asked_rows_only(spark):
    rng = random.Random(4)
    side = lambda: " ".join(rng.choice(["É", "é", "a1", "٣", "x_y", "Đ", "ß", "-"]) for _ in range(rng.randint(0, 9)))
    rows = spark.createDataFrame([(k, side(), side()) for k in range(80)] + [(80, None, "a"), (81, None, None)], "k int, a string, b string")
    got = dict(rows.select("k", compare.dice(F.col("a"), F.col("b"), F.col("k") % 2 == 0)).collect())
    want = dict(compare.dice_by_counts(rows, "k", "a", "b").collect())
    assert {k for k, v in got.items() if v is None} == {k for k in want if k % 2}
    assert all(v is None or abs(v - want[k]) < 1e-12 for k, v in got.items())


def test_segments_deal_lines_once(spark):
    rng = random.Random(6)
    rows = [(d, rng.choice([1, 2, 3, None]), 595.0, 100.0, rng.choice([9.0, 12.0, 12.0, None]), k, rng.choice(["trang 1", "trang 2", "x", None, "Điều 1. a"])) for d in ("a", "b", "c") for k in range(30)]
    lines = spark.createDataFrame(rows, "doc_id string, page int, page_width double, x double, font_size double, ord int, text string").cache()
    sizes = {r["doc_id"]: r["font_size"] for r in extract.font_histogram(lines).filter("body").collect()}
    assert {(r["doc_id"], r["body_size"]) for r in extract._body_size(lines).collect()} == set(sizes.items())
    keys = {(r["doc_id"], r["key"]) for r in extract.running_lines(lines).collect()}
    marked = extract._page_edges(lines).withColumn("key", text.running_key(F.col("text"))).filter("is_running").collect()
    assert {(r["doc_id"], r["key"]) for r in marked} == {k for k in keys if k[1] is not None}
    parts, _ = extract.segment_gazette(lines)
    assert parts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    assert parts.count() == len(rows)


def test_whole_texts_go_to_python_in_bounded_batches(spark):
    from tessera.functions.batches import BYTES, OUR_BYTES
    from tessera.sources import web

    was = spark.conf.get(BYTES, None)
    try:
        for read in (lambda d: references.extract_references(d, "k", "t"), lambda d: web.read_flight(d, "k", "t", with_text=True)):
            spark.conf.unset(BYTES)
            d = spark.createDataFrame([(1, "xem Điều 7 của Luật này"), (2, None), (3, "số")], "k int, t string")
            out = read(d)
            assert spark.conf.get(BYTES) == str(OUR_BYTES)
            assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
            spark.conf.set(BYTES, "7")
            read(d)
            assert spark.conf.get(BYTES) == "7"
        assert sorted((r["k"], r["text"], r["metadata"]) for r in out.collect()) == [(1, "xem Điều 7 của Luật này", None), (2, None, None), (3, "số", None)]
    finally:
        spark.conf.unset(BYTES) if was is None else spark.conf.set(BYTES, was)


def test_payloads_are_read_without_a_join(spark):
    p = spark.createDataFrame([(1, "no metadata")], "k int, t string")
    drafts, refused = extract.draft_from_payloads(p, "k", "t")
    assert "Join" not in drafts._jdf.queryExecution().optimizedPlan().toString() and [tuple(r) for r in refused.collect()] == [(1, "document", "METADATA_NOT_FOUND")]


ODD = [None, "", "a", "của", "Trả lương đúng hạn, của trả lương; TRẢ_LƯƠNG", "e\u0301t e\u0301 été", "ß İstanbul ΣΑΣ \U0001d400\U0001d401 x² ½½", "12 ab34 _ __a", "one", "va va va hoac", "\u00a0từ\u2028ngữ\n\nngữ từ"]


def test_terms_are_counted_where_texts_are_read(spark):
    """Counts by document and by term are those of ``tokens``, with no grouping by document."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD * 3)], "id int, text string")
    t = docs.select("id", text.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    want = {(r["id"], r["term"]): r["n"] for r in t.select("id", F.explode("t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("n")).collect()}
    rows = search.counted(docs, "id", "text").collect()
    assert {(r["id"], r["term"]): r["tf"] for r in rows if r["term"]} == want and len(rows) == len(want) + docs.count()
    assert {r["id"]: r["len"] for r in rows if not r["term"]} == {r["id"]: len(r["t"]) for r in t.collect()}
    by_term = {}
    for (_, term), n in want.items():
        tf, df = by_term.get(term, (0, 0))
        by_term[term] = (tf + n, df + 1)
    assert {r["term"]: (r["tf"], r["df"]) for r in search.term_stats(docs, "text").collect()} == by_term
    assert "Aggregate" not in search.counted(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_sums_of_a_search_are_dealt_by_their_number(spark, monkeypatch, rows):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 7}x" for j in range(1, 9))) for k in range(40)], "id int, text string")
    q = spark.createDataFrame([(k, f"w{k}x w{k + 1}x") for k in range(6)], "query_id int, query string")
    want = sorted(map(tuple, search.bm25(q, docs, "id", "text").collect()))
    monkeypatch.setattr(search, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(search, "TASK_ROWS", 10)
    out = search.bm25(q, docs, "id", "text")
    assert want and sorted(map(tuple, out.collect())) == want
    parts = [int(n) for n in re.findall(r"hashpartitioning\(id#\d+, (\d+)\)", out._jdf.queryExecution().executedPlan().toString())]
    joined = sum(len(set(t["t"]) & set(u["t"])) for t in docs.select(text.tokens(F.col("text")).alias("t")).collect() for u in q.select(text.tokens(F.col("query")).alias("t")).collect())
    assert joined // 10 + 1 in parts


def test_references_are_tried_at_their_first_words():
    words = ["điểm a", "khoản 2", "khoản", "Điều 12", "Điều", "của Nghị định này", "của", "Luật An ninh mạng và", "Bộ luật", "số", "Nghị định số 100/2019/NĐ-CP", "Điều này", "Chương IV của Luật này", ",", "\ufeff", "xLuật", "điểmx"]
    rng = random.Random(7)
    n = 0
    for _ in range(3000):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\u00a0", "\ufeff", ""]) for _ in range(14))
        starts = [m.start() for m in references.STARTS.finditer(t)]
        for _, shape in references.SHAPES:
            want = [m.span() for m in shape.finditer(t)]
            assert [m.span() for m in references._matches(shape, t, starts)] == want
            n += len(want)
    assert n > 100


def test_references_are_looked_for_once(spark):
    v = spark.createDataFrame([("p1", "v1", "d", "1/2020/NĐ-CP", "Điều 1. x", D(2020, 1, 1), None, T(2019, 1, 1), None, "verified", 1, "khoản 1 Điều này")], "provision_id string, version_id string, document_id string, document_number string, heading string, valid_from date, valid_to date, known_from timestamp, known_to timestamp, status string, n_evidence int, text string")
    q = spark.createDataFrame([(1, "p1", D(2023, 1, 1), T(2026, 1, 1))], "question_id int, provision_id string, valid_at date, known_at timestamp")
    kept = []

    def store(df, name):
        kept.append(df._jdf.queryExecution().optimizedPlan().toString())
        return spark.createDataFrame(df.collect(), df.schema)

    out = service.references_of(service.provision_at(q, v), v, store)
    assert [(r["span_id"], r["target_version_id"]) for r in out.collect()] == [("1#0", "v1")]
    assert [p.count("MapInArrow") for p in kept] == [1] and "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_coverage_deals_lines_by_document_only(spark):
    """Lines are found among lines, headings and within texts of their own document, without a join by line."""
    lines = spark.createDataFrame([(1, 1, "a\u00a0 b"), (1, 2, "b  c"), (1, 3, "Head  1"), (1, 4, " \t"), (1, 5, "gone"), (1, 6, "gone"), (1, 7, "y x"), (1, 8, "x y"), (1, 9, "c d"), (2, 1, "a b"), (3, 1, "z"), (4, 1, "q")], "doc_id long, ord int, text string")
    records = spark.createDataFrame([(1, "Head 1", "x\r\n \n\u3000y\na b", 2), (1, None, "a\tb c\n d", 1), (2, "h", None, 1), (4, None, "\ufeffq\n", 1)], "doc_id long, heading string, text string, ord int")
    left = quality.coverage(lines, records)
    assert sorted(map(tuple, left.collect())) == [(1, 5, "gone"), (1, 6, "gone"), (1, 7, "y x"), (2, 1, "a b"), (3, 1, "z")]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join ") == 1


def test_numbering_is_checked_in_all_articles(spark, tmp_path):
    import duckdb

    from tessera.plans import registry, usecases  # noqa: F401  (the last registers its queries)

    texts = ["1. một\na) x\nc) y\n3. ba\nz) z", "một\n2.1. không\n\t1.\n2147483647. lớn\n1. một\n99999999999. quá lớn", None, "b) x", "không"]
    spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in registry.QUERIES["numbering_breaks"](spark, str(tmp_path)).collect())
    assert got == [(1, "2", "3"), (1, "a", "z"), (1, "b", "c"), (2, "2", "2147483647"), (2, "2147483648", "1"), (4, "a", "b"), (5, "b", "d")]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.ORACLES["numbering_breaks"]).fetchall())
