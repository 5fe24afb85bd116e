"""Every registered query with SQL is compared with DuckDB; the others with plain Python where small."""

from __future__ import annotations

import math
import unicodedata
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from driftwright import plans
from driftwright.functions import text as tx

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    session = duckdb.connect()
    for name in TABLES:
        session.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return session


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    frame = plans.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    relation = duck.sql(plans.ORACLES[name])
    order = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in relation.fetchall()), key=repr)


def test_every_inventory_key_is_registered():
    assert len(plans.QUERIES) == 96 and {n for n in plans.QUERIES if n not in plans.ORACLES} == {"html_unescape", "html_body_text", "compact_variant", "bootstrap_ci", "ncd_pairs"}


def test_queries_do_not_depend_on_partitioning(spark, sf, monkeypatch):
    from driftwright.plans import base

    names = ["stratified_capped_topk", "matched_upper_quartile", "bootstrap_ci", "ncd_pairs", "first_last_by_order", "loo_1nn_confusion"]
    before = {n: sorted(map(repr, plans.QUERIES[n](spark, sf).collect())) for n in names}
    for module in [m for m in map(vars, (base, __import__("driftwright.plans.selection_queries", fromlist=["x"]), __import__("driftwright.plans.audit_queries", fromlist=["x"]), __import__("driftwright.plans.pair_queries", fromlist=["x"])))]:
        monkeypatch.setitem(module, "table", lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet").repartition(7))
    assert {n: sorted(map(repr, plans.QUERIES[n](spark, sf).collect())) for n in names} == before


def test_pages_match_plain_python(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in plans.QUERIES["html_body_text"](spark, sf).collect():
        for strict, column in ((True, "strict_chars"), (False, "aware_chars")):
            want = tx.body_text(pages[r["page_id"]], tx.by_tag("article"), strict)
            assert r[column] == (len(want) or None)


def test_compression_pairs_match_plain_python(spark, sf):
    docs = {r["doc_id"]: " ".join(unicodedata.normalize("NFKC", r["text"]).split())[:1000].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = plans.QUERIES["ncd_pairs"](spark, sf).collect()
    assert rows

    def c(x):
        return len(zlib.compress(x, 9))

    for r in rows[:300]:
        a, b = docs[r["idx_a"]], docs[r["idx_b"]]
        assert r["ncd"] == round((c(a + b) - min(c(a), c(b))) / max(c(a), c(b)), 6)


def test_variants_and_unescaped_titles(spark, sf):
    assert {r["kind"] for r in plans.QUERIES["compact_variant"](spark, sf).collect()} == {"object"}
    assert not any("&amp;" in r["title"] for r in plans.QUERIES["html_unescape"](spark, sf).collect())


def test_plans_are_what_they_should_be(spark, sf):
    def plan(name):
        return plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan("char_ngram_entropy") and "Generate" not in plan("char_ngram_entropy")
    assert "WindowGroupLimit" in plan("stratified_capped_topk")
    assert "TakeOrderedAndProject" in plan("hash_topk_sample") and "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in plan("author_overlap")
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in plan("public_projection")


def test_entry_runs_and_names_agree(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
