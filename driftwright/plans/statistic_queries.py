"""Effect sizes, intervals, correlation and sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwright.functions import stats as st
from driftwright.functions.scalars import tidy

from .audit_queries import FEATURES, PAIR_COMPLETE, feature_columns, pair_complete
from .base import ARTICLES, MEASURED, measured, measured_sample, query, table


def g_sql(value: str, left: str, right: str) -> str:
    """SQL of ``stats.hedges_g``."""
    n, m = f"count({value}) FILTER (WHERE {left})", f"count({value}) FILTER (WHERE {right})"
    va, vb = f"var_samp({value}) FILTER (WHERE {left})", f"var_samp({value}) FILTER (WHERE {right})"
    a, b = f"avg({value}) FILTER (WHERE {left})", f"avg({value}) FILTER (WHERE {right})"
    pooled = f"((({n}) - 1) * ({va}) + (({m}) - 1) * ({vb})) / nullif(({n}) + ({m}) - 2, 0)"
    return f"CASE WHEN {n} < 2 OR {m} < 2 THEN NULL WHEN {pooled} <= 0 THEN CASE WHEN {a} = {b} THEN 0.0 END ELSE (({b}) - ({a})) / sqrt({pooled}) * (1.0 - 3.0 / (4.0 * (({n}) + ({m}) - 2) - 1)) END"


@query(f"SELECT o_orderpriority, round(CAST({g_sql('o_totalprice', 'year(o_orderdate) = 1995', 'year(o_orderdate) = 2001')} AS DOUBLE), 6) + 0.0 AS g FROM orders GROUP BY 1")
def hedges_g(spark, d):
    year = F.year("o_orderdate")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(tidy(st.hedges_g(F.col("o_totalprice"), year == 1995, year == 2001)).alias("g"))


@query(
    f"""WITH {MEASURED}, long AS (SELECT medium, year, 'bigram' AS metric, bigram AS v FROM measured UNION ALL SELECT medium, year, 'trigram', trigram FROM measured)
SELECT medium, metric, count(*) FILTER (WHERE year = 2022) AS n_left, count(*) FILTER (WHERE year = 2026) AS n_right,
  round(avg(v) FILTER (WHERE year = 2026) - avg(v) FILTER (WHERE year = 2022), 6) + 0.0 AS mean_difference, round(CAST({g_sql('v', 'year = 2022', 'year = 2026')} AS DOUBLE), 5) + 0.0 AS g FROM long GROUP BY 1, 2"""
)
def endpoint_comparison(spark, d):
    rows = measured(spark, d).select("medium", "year", F.explode(F.create_map(F.lit("bigram"), "bigram", F.lit("trigram"), "trigram")).alias("metric", "v"))
    left, right, v = F.col("year") == 2022, F.col("year") == 2026, F.col("v")
    return rows.groupBy("medium", "metric").agg(
        F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"),
        tidy(F.avg(F.when(right, v)) - F.avg(F.when(left, v))).alias("mean_difference"), tidy(st.hedges_g(v, left, right), 5).alias("g"),
    )


@query(None)
def bootstrap_ci(spark, d):
    """Intervals over the frozen sample, whose size the selection bounds, as the exact resampling of one seed needs."""
    rows = measured_sample(spark, d).select("idx", "medium", "year", "bigram")
    found = st.bootstrap(rows, "medium", "year", "bigram", "idx", 2022, 2026)
    return found.select(F.col("grp").alias("medium"), tidy(F.col("lo")).alias("lo"), tidy(F.col("hi")).alias("hi"))


@query(
    """WITH s AS (SELECT l_returnflag AS feature, year(l_shipdate) AS year, count(*) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std FROM lineitem GROUP BY 1, 2)
SELECT a.feature, round(b.mean - a.mean, 4) AS change, round((b.mean - a.mean) / sqrt(((a.n - 1) * a.std * a.std + (b.n - 1) * b.std * b.std) / (a.n + b.n - 2)), 6) + 0.0 AS d
FROM s a JOIN s b USING (feature) WHERE a.year = 1996 AND b.year = 2000"""
)
def cohens_d_from_summary(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("feature"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_extendedprice").alias("std"))
    a, b = rows.filter("year = 1996").alias("a"), rows.filter("year = 2000").alias("b")
    both = a.join(b, "feature")
    effect = st.cohens_d(F.col("a.n"), F.col("a.mean"), F.col("a.std"), F.col("b.n"), F.col("b.mean"), F.col("b.std"))
    return both.select("feature", F.round(F.col("b.mean") - F.col("a.mean"), 4).alias("change"), tidy(effect).alias("d"))


@query(
    """WITH s AS (SELECT l_returnflag AS feature, avg(l_quantity) - 25.5 AS m, 1.96 * stddev_samp(l_quantity) / sqrt(CAST(count(*) AS DOUBLE)) AS h FROM lineitem GROUP BY 1)
SELECT feature, round(m - h, 6) AS lo, round(m + h, 6) AS hi, m - h <= 0 AND 0 <= m + h AS includes_zero FROM s"""
)
def ci_includes_zero(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("feature")).agg((F.avg("l_quantity") - 25.5).alias("m"), (F.lit(1.96) * F.stddev_samp("l_quantity") / F.sqrt(F.count("*").cast("double"))).alias("h"))
    lo, hi = F.col("m") - F.col("h"), F.col("m") + F.col("h")
    return rows.select("feature", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), ((lo <= 0) & (hi >= 0)).alias("includes_zero"))


@query(
    f"""WITH {PAIR_COMPLETE} SELECT count(*) FILTER (WHERE year = 2022) AS n_left, count(*) FILTER (WHERE year = 2026) AS n_right, (SELECT count(*) FROM matches) AS excluded_pairs,
  round(avg(value) FILTER (WHERE year = 2026) - avg(value) FILTER (WHERE year = 2022), 6) + 0.0 AS mean_difference, round(CAST({g_sql('value', 'year = 2022', 'year = 2026')} AS DOUBLE), 6) + 0.0 AS g FROM complete"""
)
def pair_complete_sensitivity(spark, d):
    from .audit_queries import matched_counterpart

    left, right, v = F.col("year") == 2022, F.col("year") == 2026, F.col("value")
    out = pair_complete(spark, d).agg(
        F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"), tidy(F.avg(F.when(right, v)) - F.avg(F.when(left, v))).alias("mean_difference"), tidy(st.hedges_g(v, left, right)).alias("g")
    )
    excluded = matched_counterpart(spark, d).agg(F.count("*").alias("excluded_pairs"))
    return out.join(F.broadcast(excluded), F.lit(True))


@query("SELECT round(count(*) FILTER (WHERE toxic = quality) / CAST(count(*) AS DOUBLE), 6) AS accuracy, round(count(*) FILTER (WHERE toxic = quality) / CAST(count(*) AS DOUBLE) - 1.0 / count(DISTINCT quality), 6) + 0.0 AS lift FROM labels")
def accuracy_lift(spark, d):
    accuracy = F.count_if(F.col("toxic") == F.col("quality")) / F.count("*").cast("double")
    return table(spark, d, "labels").agg(F.round(accuracy, 6).alias("accuracy"), tidy(accuracy - F.lit(1.0) / F.countDistinct("quality")).alias("lift"))


@query(
    f"""WITH {ARTICLES}, {FEATURES}, base AS (SELECT medium, avg(punct_count) AS mp, stddev_samp(punct_count) AS sp, avg(title_case_count) AS mt, stddev_samp(title_case_count) AS st FROM features GROUP BY 1)
SELECT idx, base.medium, round(sqrt((power((punct_count - mp) / sp, 2) + power((title_case_count - mt) / st, 2)) / 2), 6) + 0.0 AS rms FROM features, base WHERE sp > 0 AND st > 0"""
)
def rms_zscore_distance(spark, d):
    """Every article against every medium's baseline; baselines are one row a medium."""
    rows = feature_columns(spark, d).select("idx", "medium", "punct_count", "title_case_count")
    base = rows.groupBy("medium").agg(F.avg("punct_count").alias("mp"), F.stddev_samp("punct_count").alias("sp"), F.avg("title_case_count").alias("mt"), F.stddev_samp("title_case_count").alias("st"))
    baselines = base.filter("sp > 0 AND st > 0").agg(F.collect_list(F.struct("medium", "mp", "sp", "mt", "st")).alias("b"))
    rows = rows.drop("medium").join(F.broadcast(baselines), F.lit(True)).select("idx", "punct_count", "title_case_count", F.explode("b").alias("b"))

    def z(value: str, mean: str, std: str):
        return F.pow((F.col(value) - F.col(f"b.{mean}")) / F.col(f"b.{std}"), F.lit(2))

    return rows.select("idx", "b.medium", tidy(F.sqrt((z("punct_count", "mp", "sp") + z("title_case_count", "mt", "st")) / 2)).alias("rms"))
