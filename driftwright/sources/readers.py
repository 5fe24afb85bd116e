"""Readers of landed snapshots: JSON reports, JSON lines, catalogs, sitemaps, robots files, pages."""

from __future__ import annotations

import gzip
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftwright.functions.text import decode_utf8

NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
ENTRY = "loc string, lastmod string"


def json_report(spark: SparkSession, path: str, schema: str | StructType, array: str | None = None) -> DataFrame:
    """A whole-file JSON document; with ``array`` one row per element of that field, ``idx`` its position."""
    report = spark.read.json(path, schema=schema, multiLine=True)
    return report if array is None else report.select(F.posexplode(array).alias("idx", "r")).select("idx", "r.*")


def _json_objects(raw: Column) -> tuple[Column, Column]:
    parsed = F.try_parse_json(raw)
    return parsed, F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, record VARIANT): blank lines are skipped; a line that is no JSON object stops the job.

    Files are split and read line by line, so their size does not matter. The error shows the file and the line's
    beginning; ``bad_json_lines`` numbers it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.btrim("value", F.lit(" \t\r\n")).alias("raw")).filter("raw <> ''")
    record, is_object = _json_objects(F.col("raw"))
    fault = F.raise_error(F.concat(F.lit("not a JSON object in "), "file", F.lit(": "), F.left("raw", F.lit(80))))
    return lines.select("file", F.when(is_object, record).otherwise(fault.cast("variant")).alias("record"))


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of lines that are no JSON objects, numbered from 1. Only the files that have any are read whole."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.btrim("value", F.lit(" \t\r\n")).alias("raw")).filter("raw <> ''")
    files = [r["file"] for r in lines.filter(~_json_objects(F.col("raw"))[1]).select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], "file string, line int")
    whole = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r\n|\n|\r")).alias("pos", "raw"))
    whole = whole.select("file", (F.col("pos") + 1).alias("line"), F.btrim("raw", F.lit(" \t\r\n")).alias("raw")).filter("raw <> ''")
    return whole.filter(~_json_objects(F.col("raw"))[1]).select("file", "line")


def landed_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Fetched responses as they were landed, (url, status, content_type, body BINARY, error) in Parquet, with their text.

    Collection is not done here: requests, their pacing and their guard on hosts and paths belong to the collector; this is the
    format that it leaves. ``text`` is the body as UTF-8 with U+FFFD for what is malformed, null with an ``error`` when the
    response is not a success, not of the expected kind, or empty.
    """
    rows = spark.read.schema("url string, status int, content_type string, body binary, error string").parquet(path)
    error = F.coalesce(
        F.col("error"),
        F.when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("unknown")))),
        F.when(~F.coalesce(F.contains(F.lower("content_type"), F.lit(kind)), F.lit(False)), F.concat(F.lit("content type "), F.coalesce("content_type", F.lit("unknown")))),
        F.when(F.coalesce(F.octet_length("body"), F.lit(0)) == 0, F.lit("empty body")),
    )
    return rows.select("url", "status", error.alias("error"), "body").select("url", "status", F.when(F.col("error").isNull(), decode_utf8("body")).alias("text"), "error")


def toml_table(spark: SparkSession, text: str, name: str, schema: str) -> DataFrame:
    """An array of tables of a TOML document, parsed on the driver: catalogs are a handful of rows."""
    fields = StructType.fromDDL(schema).fieldNames()
    rows = [tuple(entry.get(f) for f in fields) for entry in tomllib.loads(text).get(name, [])]
    return spark.createDataFrame(rows, schema)


def sitemap_urls(spark: SparkSession, path: str, tag: str = "url") -> DataFrame:
    """(file, pos, loc, lastmod) of a urlset (``tag`` url) or an index (``tag`` sitemap); lastmod stays a string.

    Files may be gzipped, told by their first bytes; another root element is an error.
    """
    root = {"url": "urlset", "sitemap": "sitemapindex"}[tag]

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                tree = ET.fromstring(decode_xml(bytes(content)))
                if tree.tag.rpartition("}")[2] != root:
                    raise ValueError(f"{file}: {root} expected, {tree.tag} found")
                for pos, node in enumerate(tree.findall(f"{{{NAMESPACE}}}{tag}")):
                    loc = (node.findtext(f"{{{NAMESPACE}}}loc") or "").strip()
                    if loc:
                        rows.append((file, pos, loc, node.findtext(f"{{{NAMESPACE}}}lastmod")))
            yield pd.DataFrame(rows, columns=["file", "pos", "loc", "lastmod"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(entries, "file string, pos int, loc string, lastmod string")


def decode_xml(content: bytes) -> bytes:
    """Unpacked if gzipped."""
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def sitemap_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, entries, first): urlset, sitemapindex or an error, entries and the first ten locations."""

    def inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                tree = ET.fromstring(decode_xml(bytes(content)))
                kind = tree.tag.rpartition("}")[2]
                if kind not in ("urlset", "sitemapindex"):
                    raise ValueError(f"{file}: unknown root {tree.tag}")
                locs = [x for x in (n.findtext(f"{{{NAMESPACE}}}loc") for n in tree) if x]
                rows.append((file, kind, len(tree), locs[:10]))
            yield pd.DataFrame(rows, columns=["file", "kind", "entries", "first"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(inspect, "file string, kind string, entries long, first array<string>")


def robots_rules(lines: DataFrame, agent: str = "*", file: str = "file", pos: str = "line_no", raw: str = "raw") -> DataFrame:
    """(file, kind, value): Disallow rules in the scope of an agent (its line is the last agent line above) and all sitemaps."""
    text = F.trim(F.regexp_replace(raw, "#.*$", ""))
    rows = lines.select(file, pos, F.lower(F.trim(F.substring_index(text, ":", 1))).alias("key"), F.trim(F.regexp_extract(text, r"^[^:]*:(.*)$", 1)).alias("value"))
    above = Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("agent", F.last(F.when(F.col("key") == "user-agent", F.col("value")), ignorenulls=True).over(above))
    wanted = (F.col("value") != "") & (((F.col("key") == "disallow") & (F.col("agent") == agent)) | (F.col("key") == "sitemap"))
    return rows.filter(wanted).select(file, F.col("key").alias("kind"), "value")


def robots_verdict(rules: DataFrame, sitemap_prefix: str, forbidden: dict[str, str], file: str = "file") -> DataFrame:
    """(file, sitemap, fault) of ``robots_rules``: the first official sitemap, and the first part of the contract that is broken.

    ``forbidden`` names what must be disallowed: a path that ends in ``*`` by any rule that begins so, another by itself.
    """
    official = F.min(F.when((F.col("kind") == "sitemap") & F.col("value").startswith(sitemap_prefix), F.col("value")))
    found = {}
    for name, path in forbidden.items():
        hit = F.col("value").startswith(path[:-1]) if path.endswith("*") else F.col("value") == path
        found[name] = F.coalesce(F.max((F.col("kind") == "disallow") & hit), F.lit(False))
    rows = rules.groupBy(file).agg(official.alias("sitemap"), *[c.alias(f"has_{i}") for i, c in enumerate(found.values())])
    fault = F.when(F.col("sitemap").isNull(), F.lit("no official sitemap"))
    for i, name in enumerate(found):
        fault = fault.when(~F.col(f"has_{i}"), F.lit(f"{name} is not disallowed"))
    return rows.select(file, "sitemap", fault.alias("fault"))
