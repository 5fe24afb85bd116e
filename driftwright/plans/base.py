"""How the audit's notions map onto the tables, once as DataFrames and once as SQL, and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwright.functions import text as tx
from driftwright.operators.selection import capped_sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# queries over whole tables where the inventory's query takes a sample, kept apart from the inventory
WHOLE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
WHOLE_ORACLES: dict[str, str] = {}

YEARS, MONTHS, TARGET = (2022, 2023, 2024, 2025, 2026), range(1, 8), 12


def query(sql: str | None, queries: dict = QUERIES, oracles: dict = ORACLES):
    """Register a function under its name, with its SQL if there is one."""

    def register(f):
        queries[f.__name__] = f
        if sql is not None:
            oracles[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def article_index(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    """Documents as articles without their text: position, year, month, author, medium, URL and length."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"),
        (F.lit(2022) + F.col("doc_id") % 5).cast("int").alias("year"),
        (F.lit(1) + F.expr("doc_id div 5") % 7).cast("int").alias("month"),
        F.col("source").alias("author"),
        F.col("lang").alias("medium"),
        F.concat(F.lit("https://corpus.example/"), "source", F.lit("/articles/"), F.col("doc_id").cast("string")).alias("url"),
        "n_chars",
        *more,
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the normalised text."""
    return article_index(spark, sf_dir, tx.normalize_text("text").alias("body"))


ARTICLES = r"""articles AS (SELECT doc_id AS idx, CAST(2022 + doc_id % 5 AS INTEGER) AS year, CAST(1 + (doc_id // 5) % 7 AS INTEGER) AS month,
  source AS author, lang AS medium, 'https://corpus.example/' || source || '/articles/' || doc_id AS url, n_chars,
  trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM documents)"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of at least a window: length and n-gram entropies of the window, in bits."""
    rows = article_index(spark, sf_dir, tx.window_stats(F.col("text")).alias("m")).filter(F.col("m.chars") >= tx.WINDOW)
    names = {"chars": "chars", "bigram": "entropy_2", "bi_total": "total_2", "bi_kinds": "distinct_2", "trigram": "entropy_3", "tri_total": "total_3", "tri_kinds": "distinct_3"}
    return rows.withColumns({name: F.col(f"m.{field}") for name, field in names.items()}).drop("m")


def sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen sample of articles of at least a window, with their windows: chosen first, so that only its rows are measured."""
    rows = article_index(spark, sf_dir, tx.normalized_window(F.col("text")).alias("m")).filter(F.col("m.chars") >= tx.WINDOW)
    return manifest(rows.select("idx", "year", "month", "author", "medium", "url", F.col("m.window").alias("win")))


def measured_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen sample with the bigram entropy of its windows."""
    return tx.with_ngram_stats(sample_windows(spark, sf_dir), "win", 2, "bi").withColumn("bigram", F.col("bi.entropy")).drop("win", "bi")


MEASURED = (
    ARTICLES
    + r""", windows AS (SELECT *, CAST(length(body) AS BIGINT) AS chars, substring(body, 1, 1000) AS win FROM articles WHERE length(body) >= 1000),
grams AS (SELECT idx, n, substring(win, CAST(i AS INTEGER), n) AS g, count(*) AS c FROM windows, (VALUES (2), (3)) t(n), unnest(range(1, 1000)) u(i)
  WHERE i <= length(win) - n + 1 GROUP BY ALL),
entropies AS (SELECT idx, n, CAST(sum(c) AS BIGINT) AS total, count(*) AS kinds, log2(CAST(sum(c) AS DOUBLE)) - sum(c * log2(CAST(c AS DOUBLE))) / sum(c) AS h FROM grams GROUP BY ALL),
measured AS (SELECT w.*, b.h AS bigram, b.total AS bi_total, b.kinds AS bi_kinds, t.h AS trigram, t.total AS tri_total, t.kinds AS tri_kinds
  FROM windows w JOIN entropies b ON b.idx = w.idx AND b.n = 2 JOIN entropies t ON t.idx = w.idx AND t.n = 3)"""
)


def manifest(rows: DataFrame) -> DataFrame:
    """The frozen sample: per year and month twelve articles in hash order, one an author."""
    return capped_sample(rows, ["year", "month"], "author", "url", TARGET)


def manifest_sql(source: str) -> str:
    return f"""authors AS (SELECT *, row_number() OVER (PARTITION BY year, month, author ORDER BY sha256(url), url) AS ar FROM {source}),
manifest AS (SELECT * EXCLUDE (ar) FROM (SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY sha256(url), url) AS rank FROM authors WHERE ar <= 1) WHERE rank <= {TARGET})"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as collected candidates: type, letters, publication string, URL, author hash, reactions."""
    offset = F.when(F.col("o_orderstatus") == "O", "+09:00").when(F.col("o_orderstatus") == "F", "Z").otherwise("")
    host = F.when(F.col("o_orderpriority") == "2-HIGH", "https://other.example/").otherwise("https://corpus.example/")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idx"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "idea").otherwise("tech").alias("article_type"),
        F.floor(F.col("o_totalprice") / 100).cast("long").alias("letters"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), offset).alias("published_at"),
        F.concat(host, F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/articles/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.when(F.col("o_custkey") % 50 == 0, "").otherwise(F.sha2(F.col("o_custkey").cast("string"), 256)).alias("author"),
        F.floor("o_totalprice").cast("long").alias("reactions"),
        "o_custkey",
        "o_orderdate",
    )


CANDIDATES = """candidates AS (SELECT o_orderkey AS idx, CASE WHEN o_orderpriority = '1-URGENT' THEN 'idea' ELSE 'tech' END AS article_type,
  CAST(floor(o_totalprice / 100) AS BIGINT) AS letters,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE o_orderstatus WHEN 'O' THEN '+09:00' WHEN 'F' THEN 'Z' ELSE '' END AS published_at,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 'https://other.example/' ELSE 'https://corpus.example/' END || 'c' || o_custkey || '/articles/' || o_orderkey AS url,
  CASE WHEN o_custkey % 50 = 0 THEN '' ELSE sha256(CAST(o_custkey AS VARCHAR)) END AS author, CAST(floor(o_totalprice) AS BIGINT) AS reactions, o_custkey, o_orderdate FROM orders)"""
