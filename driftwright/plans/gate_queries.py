"""Fail-closed gates over counted evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from .audit_queries import COVERAGE, coverage
from .base import ARTICLES, CANDIDATES, article_index, candidates, manifest, manifest_sql, query, table

#: what each signal may be used for is a decision on record, not computed from its evidence
SIGNALS = [("bigram_entropy", "measured", False), ("trigram_entropy", "measured", False), ("compression_distance", "rejected", False), ("detector", "rejected", False)]


@query(
    "WITH s(signal, status, may_label) AS (VALUES " + ", ".join(f"('{n}', '{s}', {str(u).lower()})" for n, s, u in SIGNALS) + """)
SELECT count(*) AS signals, count(*) FILTER (WHERE may_label) AS usable, CASE WHEN count(*) FILTER (WHERE may_label) > 0 THEN 'validated_ready' ELSE 'measurement_only' END AS status,
  count(*) FILTER (WHERE may_label) > 0 AS year_label_allowed FROM s"""
)
def signal_gate(spark, d):
    usable = F.count_if(F.col("may_label"))
    rows = spark.createDataFrame(SIGNALS, "signal string, status string, may_label boolean")
    return rows.agg(F.count("*").alias("signals"), usable.alias("usable"), F.when(usable > 0, "validated_ready").otherwise("measurement_only").alias("status"), (usable > 0).alias("year_label_allowed"))


@query(
    f"""WITH {ARTICLES}, {manifest_sql('articles')} SELECT count(*) AS n, count(DISTINCT url) = count(*) AS unique_urls, count(*) FILTER (WHERE year = 2022) AS n_first, count(*) FILTER (WHERE year = 2026) AS n_last,
  count(*) FILTER (WHERE year = 2022) = count(*) FILTER (WHERE year = 2026) AND count(DISTINCT url) = count(*) AND count(*) <= 420 AS holds FROM manifest"""
)
def selection_contract(spark, d):
    n, urls, first, last = F.count("*"), F.countDistinct("url"), F.count_if(F.col("year") == 2022), F.count_if(F.col("year") == 2026)
    return manifest(article_index(spark, d)).agg(n.alias("n"), (urls == n).alias("unique_urls"), first.alias("n_first"), last.alias("n_last"), ((first == last) & (urls == n) & (n <= 420)).alias("holds"))


@query(
    f"""WITH {CANDIDATES}, c AS (SELECT substr(published_at, 1, 4) AS year, count(*) FILTER (WHERE idx % 401 = 0) AS blocking, count(*) FILTER (WHERE published_at IS NULL) AS undated, count(*) FILTER (WHERE idx % 97 = 0) AS unavailable FROM candidates GROUP BY 1)
SELECT year, blocking, undated, unavailable, CASE WHEN blocking > 9 OR undated > 0 THEN 'blocked' WHEN unavailable > 0 THEN 'compatible_with_unavailable_records' ELSE 'compatible' END AS status FROM c"""
)
def audit_status(spark, d):
    rows = candidates(spark, d).groupBy(F.substring("published_at", 1, 4).alias("year")).agg(
        F.count_if(F.col("idx") % 401 == 0).alias("blocking"), F.count_if(F.col("published_at").isNull()).alias("undated"), F.count_if(F.col("idx") % 97 == 0).alias("unavailable")
    )
    status = F.when((F.col("blocking") > 9) | (F.col("undated") > 0), "blocked").when(F.col("unavailable") > 0, "compatible_with_unavailable_records").otherwise("compatible")
    return rows.withColumn("status", status)


@query(f"WITH {COVERAGE} SELECT pages, CASE WHEN titled >= 0.8 * pages THEN 'passed' ELSE 'failed' END AS title_gate, CASE WHEN dated >= 0.8 * pages THEN 'passed' ELSE 'failed' END AS date_gate, titled = pages AND with_lang = pages AND with_article = pages AS all_fields FROM coverage")
def coverage_gate(spark, d):
    def gate(counted: str):
        return F.when(F.col(counted) >= 0.8 * F.col("pages"), "passed").otherwise("failed")

    every = (F.col("titled") == F.col("pages")) & (F.col("with_lang") == F.col("pages")) & (F.col("with_article") == F.col("pages"))
    return coverage(spark, d).select("pages", gate("titled").alias("title_gate"), gate("dated").alias("date_gate"), every.alias("all_fields"))


@query(
    """SELECT event_type, count(*) AS tried, count(*) FILTER (WHERE value > 1) AS succeeded,
  CASE count(*) FILTER (WHERE value > 1) WHEN 0 THEN 'blocked' WHEN count(*) THEN 'executes_not_validated' ELSE 'partial' END AS status FROM events GROUP BY 1"""
)
def probe_status(spark, d):
    tried, good = F.count("*"), F.count_if(F.col("value") > 1)
    status = F.when(good == 0, "blocked").when(good == tried, "executes_not_validated").otherwise("partial")
    return table(spark, d, "events").groupBy("event_type").agg(tried.alias("tried"), good.alias("succeeded"), status.alias("status"))
