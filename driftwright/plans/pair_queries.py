"""Pairs of the frozen sample: partitions, gaps, correlation, compression distance and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwright.functions import stats as st
from driftwright.functions.scalars import tidy
from driftwright.operators import pairs as pr
from driftwright.operators.selection import top_per_group

from .audit_queries import described
from .base import MEASURED, WHOLE, WHOLE_ORACLES, manifest_sql, measured_sample, query, sample_windows, table

PAIRS = f"""{MEASURED}, {manifest_sql('measured')}, sample AS (SELECT idx, year, month, author, bigram FROM manifest),
pairs AS (SELECT a.idx AS idx_a, b.idx AS idx_b, a.year AS year_a, b.year AS year_b, a.year = b.year AS same_year, a.author = b.author AS same_author,
  CAST(abs((b.year * 12 + b.month) - (a.year * 12 + a.month)) AS INTEGER) AS gap, abs(a.bigram - b.bigram) AS distance FROM sample a JOIN sample b ON a.idx < b.idx)"""


def pairs(spark, d):
    """Pairs of the measured sample; the distance is that of the windows' bigram entropies."""
    return pr.labelled_pairs(measured_sample(spark, d), ["bigram"]).withColumn("distance", F.abs(F.col("bigram_a") - F.col("bigram_b")))


@query(f"WITH {PAIRS} SELECT idx_a, idx_b, same_author, gap, round(distance, 6) + 0.0 AS distance FROM pairs")
def unordered_pairs(spark, d):
    return pairs(spark, d).select("idx_a", "idx_b", "same_author", "gap", tidy(F.col("distance")).alias("distance"))


PARTS = {"overall": "true", "within_year": "same_year", "between_year": "NOT same_year", "same_author": "same_author", "different_author": "NOT same_author"}


@query(f"WITH {PAIRS}, named AS (SELECT distance, unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in PARTS.items()) + f"], lambda x: x IS NOT NULL)) AS part FROM pairs) SELECT part, {described('distance', 'distance')} FROM named GROUP BY 1")
def pair_partitions(spark, d):
    names = F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in PARTS.items()])
    return pairs(spark, d).select("distance", F.explode(F.array_compact(names)).alias("part")).groupBy("part").agg(*st.describe(F.col("distance"), "distance"))


@query(f"WITH {PAIRS} SELECT least(year_a, year_b) AS year_low, greatest(year_a, year_b) AS year_high, {described('distance', 'distance')} FROM pairs GROUP BY 1, 2")
def by_year_pair(spark, d):
    return pairs(spark, d).groupBy(F.least("year_a", "year_b").alias("year_low"), F.greatest("year_a", "year_b").alias("year_high")).agg(*st.describe(F.col("distance"), "distance"))


@query(f"WITH {PAIRS} SELECT gap, {described('distance', 'distance', False)} FROM pairs GROUP BY 1")
def by_month_gap(spark, d):
    return pairs(spark, d).groupBy("gap").agg(*st.describe(F.col("distance"), "distance", spread=False))


@query(f"WITH {PAIRS} SELECT round(avg(distance) FILTER (WHERE NOT same_year) - avg(distance) FILTER (WHERE same_year), 6) + 0.0 AS difference FROM pairs")
def between_minus_within(spark, d):
    same, v = F.col("same_year"), F.col("distance")
    return pairs(spark, d).agg(tidy(F.avg(F.when(~same, v)) - F.avg(F.when(same, v))).alias("difference"))


R_SQL = "covar_pop(distance, CAST(gap AS DOUBLE)) / nullif(stddev_pop(distance) * stddev_pop(CAST(gap AS DOUBLE)), 0)"


@query(f"WITH {PAIRS} SELECT same_author, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN {R_SQL} END, 5) + 0.0 AS r FROM pairs GROUP BY 1")
def pearson_gap(spark, d):
    return pairs(spark, d).groupBy("same_author").agg(F.count("*").alias("n"), tidy(st.pearson(F.col("gap").cast("double"), F.col("distance")), 5).alias("r"))


@query(
    f"""WITH {PAIRS} SELECT count(*) AS n, round({R_SQL}, 5) + 0.0 AS r_all, count(*) FILTER (WHERE same_author) AS n_same, min(gap) FILTER (WHERE same_author) AS least_gap, max(gap) FILTER (WHERE same_author) AS most_gap,
  round(avg(distance) FILTER (WHERE same_author), 6) + 0.0 AS same_mean FROM pairs"""
)
def time_distance(spark, d):
    same, gap, v = F.col("same_author"), F.col("gap"), F.col("distance")
    return pairs(spark, d).agg(
        F.count("*").alias("n"), tidy(st.pearson(gap.cast("double"), v), 5).alias("r_all"), F.count_if(same).alias("n_same"), F.min(F.when(same, gap)).alias("least_gap"),
        F.max(F.when(same, gap)).alias("most_gap"), tidy(F.avg(F.when(same, v))).alias("same_mean"),
    )


@query(None)
def ncd_pairs(spark, d):
    found = pr.compression_distance(pr.labelled_pairs(sample_windows(spark, d), ["win"]), "win_a", "win_b")
    return found.select("idx_a", "idx_b", "year_a", "year_b", "gap", "same_author", tidy(F.col("ncd")).alias("ncd"))


@query(
    """WITH s AS (SELECT vec_id, label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256(CAST(vec_id AS VARCHAR)), vec_id) AS r FROM embeddings) WHERE r <= 12),
p AS (SELECT a.vec_id, a.label AS actual, b.vec_id AS other, b.label AS predicted, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: power(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2)))), 6) AS dist FROM s a JOIN s b ON a.vec_id <> b.vec_id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, other) AS r FROM p) WHERE r = 1)
SELECT actual, predicted, count(*) AS n FROM n GROUP BY 1, 2"""
)
def loo_1nn_confusion(spark, d):
    """Leave-one-out nearest neighbour over twelve vectors a label in hash order."""
    vectors = table(spark, d, "embeddings").withColumn("key", F.col("vec_id").cast("string"))
    sample = top_per_group(vectors, ["label"], [F.sha2("key", 256), "vec_id"], 12).select(F.col("vec_id").alias("idx"), "label", "embedding")
    squares = F.zip_with("embedding_a", "embedding_b", lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    found = pr.unordered_pairs(sample, ["idx", "label", "embedding"]).withColumn("dist", F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)), 6))
    return pr.nearest_other(found, "idx", "label", "dist").groupBy("actual", "predicted").agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT a.vec_id, a.label AS actual, b.vec_id AS other, b.label AS predicted, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: power(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2)))), 6) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
n AS (SELECT vec_id, actual, arg_min(predicted, (dist, other)) AS predicted FROM p GROUP BY 1, 2)
SELECT actual, predicted, count(*) AS n FROM n GROUP BY 1, 2""",
    WHOLE,
    WHOLE_ORACLES,
)
def loo_1nn_all(spark, d):
    """The same over every vector of the table, each against all others."""
    found = pr.nearest_in_blocks(table(spark, d, "embeddings"), "vec_id", "label", "embedding")
    return found.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
