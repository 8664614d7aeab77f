"""The pipeline end to end: each stage's rows against a plain computation on the rows of the stage before."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, mixing, quality
from tests.llm.test_operators import components

SF = "/root/testdata/sf0.01"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r for r in docs.collect()}
    out, seen = [], docs
    for name, stage in corpus_pipeline.STAGES:
        seen = spark.createDataFrame(stage(spark, seen, SF).toArrow())
        out.append(seen)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen.columns == docs.columns
    ids = [sorted(r["doc_id"] for r in df.select("doc_id").collect()) for df in out]

    good = {r["doc_id"] for r in quality.op1_quality_classifier(spark, SF).filter("predicted = 1").collect()}
    assert ids[0] == sorted(good)

    groups = {}
    for i in ids[0]:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", texts[i]["text"] or ""), []).append((-len(texts[i]["text"] or ""), i))
    assert ids[1] == sorted(min(g)[1] for g in groups.values())

    assert ids[2] == sorted({name for _, n, name in components([(i, texts[i]["text"]) for i in ids[1]])})

    mix = mixing.mix_sources(out[2]).collect()
    assert ids[3] == sorted(r["doc_id"] for r in mix for _ in range(r["copies"]))
    for s in {r["source"] for r in mix}:
        mine = [r for r in mix if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) / 2 + 1e-6

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    last = out[4].collect()
    assert ids[4] == ids[3]
    for r in last:
        got = t.encode(texts[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(got) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, got)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(got, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", None, "a", 0)]])
def test_pipeline_of_hardly_anything(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
    assert docs.count() == 0
    assert docs.filter(F.col("n_tokens") < 0).count() == 0
