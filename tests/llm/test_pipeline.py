from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from driftwright.llm import common, near_duplicates, toxicity

from .helpers import awkward, awkward_rows, empty
from .test_near_duplicates import brute


def test_stages_agree_with_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {"toxicity": None}
    for name, stage in cp.STAGES:
        before = docs
        docs = common.materialise(stage(spark, docs, sf), f"test-{name}")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
        kept[name] = docs
        if name != "encoding":
            assert docs.columns == columns
    scores = {r["doc_id"]: r["score"] for r in toxicity.op6_toxicity(spark, sf).collect()}
    assert {r["doc_id"] for r in kept["toxicity"].collect()} == {i for i, s in scores.items() if s < 0.5}
    groups = brute([(r["doc_id"], r["text"]) for r in kept["toxicity"].collect()])
    assert {r["doc_id"] for r in kept["near_duplicates"].collect()} == {i for i, (_, c) in groups.items() if i == c}
    texts = {r["doc_id"]: r["text"] for r in kept["near_duplicates"].collect()}
    for r in kept["secrets"].collect():
        assert not re.search(r'token = "[0-9a-f]{40}"', r["text"]) and r["n_chars"] == len(r["text"])
        assert re.sub(r'token = "[0-9a-f]{40}"', 'token = "[SECRET]"', texts[r["doc_id"]]) == r["text"]
    assert kept["secrets"].count() == len(texts)
    tokens = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    assert kept["mixture"].agg(tokens).first()[0] <= 0.9 * kept["secrets"].agg(tokens).first()[0]
    assert kept["mixture"].count() > 0.6 * kept["secrets"].count()
    got = sorted(tuple(r) for r in cp.run(spark, sf).collect())
    assert got == sorted(tuple(r) for r in kept["encoding"].collect())


def test_awkward_and_empty_tables(spark, tmp_path):
    for name, frame, some in (("awkward", awkward(spark), True), ("empty", empty(spark), False)):
        folder = f"{tmp_path}/{name}"
        frame.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(3, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        rows = cp.run(spark, folder)
        assert rows.count() <= len(awkward_rows()) and (rows.count() > 0) == some


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    rows = [(i, "a shared line of several words that is copied here and there " + ("again" if i % 2 else "again"), "en", "s", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in near_duplicates.drop_near_duplicates(docs).collect()] == [0]
