from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from driftwright.sources import readers, sinks
from driftwright.streaming.candidates import first_seen

URLSET = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x.example/1</loc><lastmod>2022-01-01T00:00:00+09:00</lastmod></url><url><loc> </loc></url><url><loc>https://x.example/2</loc></url></urlset>'
INDEX = URLSET.replace("urlset", "sitemapindex").replace("<url>", "<sitemap>").replace("</url>", "</sitemap>")


def test_json_report_and_catalog(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"n": 2, "rows": [{"a": 1, "b": "x"}, {"a": 2, "b": None}]}, indent=1), encoding="utf-8")
    rows = readers.json_report(spark, f"{tmp_path}/r.json", "n int, rows array<struct<a: int, b: string>>", "rows")
    assert [tuple(r) for r in rows.collect()] == [(0, 1, "x"), (1, 2, None)]
    catalog = '[[tool]]\nid = "a"\nversion = "1"\n[[tool]]\nid = "b"\n'
    assert [tuple(r) for r in readers.toml_table(spark, catalog, "tool", "id string, version string").collect()] == [("a", "1"), ("b", None)]


def test_json_lines_name_the_bad_line(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"a": 1}\n\n  \n{"b": null}\r\n')
    got = readers.json_lines(spark, f"{tmp_path}/ok.jsonl").select(F.to_json("record").alias("r")).collect()
    assert sorted(r[0] for r in got) == ['{"a":1}', '{"b":null}']
    assert readers.bad_json_lines(spark, f"{tmp_path}/ok.jsonl").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n[1]\n{"c": 2}\nnope\n')
    with pytest.raises(Exception, match="not a JSON object in .*bad.jsonl"):
        readers.json_lines(spark, f"{tmp_path}/*.jsonl").collect()
    bad = readers.bad_json_lines(spark, f"{tmp_path}/*.jsonl").collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["line"]) for r in bad) == [("bad.jsonl", 3), ("bad.jsonl", 5)]


def test_landed_pages_decode_and_carry_errors(spark, tmp_path):
    rows = [("u1", 200, "text/html; charset=utf-8", b"a\xff\xe3\x81b", None), ("u2", 404, "text/html", b"x", None), ("u3", 200, "image/png", b"x", None), ("u4", 200, "text/html", b"", None), ("u5", None, None, None, "TimeoutError")]
    spark.createDataFrame(rows, "url string, status int, content_type string, body binary, error string").write.parquet(f"{tmp_path}/p")
    got = {r["url"]: (r["text"], r["error"]) for r in readers.landed_pages(spark, f"{tmp_path}/p", "html").collect()}
    assert got == {"u1": (b"a\xff\xe3\x81b".decode("utf-8", "replace"), None), "u2": (None, "status 404"), "u3": (None, "content type image/png"), "u4": (None, "empty body"), "u5": (None, "TimeoutError")}


def test_robots_verdict(spark):
    def verdict(*lines):
        rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(("User-agent: *", *lines))], "file string, line_no int, raw string")
        got = readers.robots_verdict(readers.robots_rules(rows), "https://x.example/sitemaps/", {"api": "/api/*", "search": "/search"}).first()
        return (got["sitemap"], got["fault"])

    site = "Sitemap: https://x.example/sitemaps/a.xml"
    assert verdict(site, "Disallow: /api/*", "Disallow: /search") == ("https://x.example/sitemaps/a.xml", None)
    assert verdict(site, "Disallow: /api/v1", "Disallow: /searching")[1] == "search is not disallowed"
    assert verdict(site, "Disallow: /search")[1] == "api is not disallowed"
    assert verdict("Sitemap: https://y.example/a.xml", "Disallow: /api/", "Disallow: /search") == (None, "no official sitemap")


def test_job_parameters_and_check(spark, sf, tmp_path):
    from driftwright import job

    chosen = job.parameters(["label_counts", "--input", sf, "--output", f"{tmp_path}/o"])
    job.run(spark, chosen)
    assert spark.read.parquet(f"{tmp_path}/o").count() > 0
    job.run(spark, job.parameters(["label_counts", "--input", sf, "--output", f"{tmp_path}/o", "--check"]))
    with pytest.raises(SystemExit):
        job.run(spark, job.parameters(["label_counts", "--input", sf, "--output", f"{tmp_path}/o", "--check", "--limit", "1"]))
    for wrong in (["nothing", "--input", sf, "--output", "x"], ["label_counts", "--input", sf], ["label_counts", "--input", sf, "--output", "x", "--limit", "0"]):
        with pytest.raises(SystemExit):
            job.parameters(wrong)


def test_sitemaps(spark, tmp_path):
    (tmp_path / "a.xml").write_text(URLSET)
    (tmp_path / "b.bin").write_bytes(gzip.compress(URLSET.encode()))
    got = readers.sitemap_urls(spark, f"{tmp_path}/*").select("pos", "loc", "lastmod").distinct().orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(0, "https://x.example/1", "2022-01-01T00:00:00+09:00"), (2, "https://x.example/2", None)]
    (tmp_path / "c.idx").write_text(INDEX)
    assert readers.sitemap_urls(spark, f"{tmp_path}/c.idx", "sitemap").count() == 2
    kinds = {r["kind"]: r["entries"] for r in readers.sitemap_kinds(spark, f"{tmp_path}/*").collect()}
    assert kinds == {"urlset": 3, "sitemapindex": 3}
    with pytest.raises(Exception, match="urlset expected"):
        readers.sitemap_urls(spark, f"{tmp_path}/c.idx").collect()


def test_robots_scope(spark):
    text = "# c\nUser-agent: bot\nDisallow: /b\nSitemap: https://x.example/s.xml\nUser-agent: *\nDisallow: /api/ # no\nDisallow:\nDisallow: /search\nUser-agent: z\nDisallow: /z"
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "file string, line_no int, raw string")
    got = {(r["kind"], r["value"]) for r in readers.robots_rules(lines).collect()}
    assert got == {("sitemap", "https://x.example/s.xml"), ("disallow", "/api/"), ("disallow", "/search")}


def test_reports_are_canonical_and_staleness_is_seen(spark, tmp_path):
    path = f"{tmp_path}/deep/r.json"
    sinks.write_report({"b": "é", "a": 1}, path)
    assert open(path, encoding="utf-8").read() == '{\n  "a": 1,\n  "b": "é"\n}\n'
    assert not sinks.is_stale({"a": 1, "b": "é"}, path) and sinks.is_stale({"a": 2}, path) and sinks.is_stale({}, f"{path}x")
    frame = spark.createDataFrame([(2, None), (1, "x")], "url int, a string")
    sinks.write_json_lines(frame, f"{tmp_path}/out", ["url"])
    assert [r[0] for r in spark.read.text(f"{tmp_path}/out").collect()] == ['{"a":"x","url":1}', '{"a":null,"url":2}']
    assert sinks.same_rows(frame, frame.repartition(3)) and not sinks.same_rows(frame, frame.limit(1))
    assert sinks.public_columns(frame.withColumn("text", F.lit("t"))).columns == ["url", "a"]
    with pytest.raises(RuntimeError, match="1 rows failed"):
        sinks.fail_on_errors(frame.withColumnRenamed("a", "error"))
    sinks.fail_on_errors(frame.filter("a IS NULL").withColumnRenamed("a", "error"))


def test_candidate_stream_drops_repeats(spark, tmp_path):
    frame = spark.createDataFrame([("u", "2024-01-01"), ("u", "2024-01-02"), ("v", "2024-01-01")], "url string, at string").withColumn("at", F.to_timestamp("at"))
    frame.write.parquet(f"{tmp_path}/in")
    stream = first_seen(spark, f"{tmp_path}/in", "url string, at timestamp", "url", "at").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    assert sorted(r["url"] for r in spark.table("seen").collect()) == ["u", "v"]
