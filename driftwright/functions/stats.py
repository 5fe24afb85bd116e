"""Descriptive statistics and effect sizes as aggregate expressions; the seeded bootstrap as a grouped function."""

from __future__ import annotations

import math
import random
from statistics import fmean

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import tidy


def describe(value: Column, name: str, spread: bool = True) -> list[Column]:
    """n, mean, median, (population) deviation, least and greatest; all but n are null for no value."""
    stats = {"n": F.count(value), "mean": F.avg(value), "median": F.median(value), "std": F.stddev_pop(value), "min": F.min(value), "max": F.max(value)}
    return [(c if k == "n" else tidy(c)).alias(f"{name}_{k}") for k, c in stats.items() if spread or k != "std"]


def quartiles(value: Column, name: str) -> list[Column]:
    """Quartiles by linear interpolation, and their distance."""
    q1, q3 = F.percentile(value, F.lit(0.25)), F.percentile(value, F.lit(0.75))
    return [tidy(q1).alias(f"{name}_q1"), tidy(q3).alias(f"{name}_q3"), tidy(q3 - q1).alias(f"{name}_iqr")]


def hedges_g(value: Column, left: Column, right: Column) -> Column:
    """Standardised mean difference right minus left with the small-sample correction, in one aggregation."""
    a, b = F.when(left, value), F.when(right, value)
    n, m = F.count(a), F.count(b)
    df = n + m - 2
    pooled = F.try_divide((n - 1) * F.var_samp(a) + (m - 1) * F.var_samp(b), df)
    gap = F.avg(b) - F.avg(a)
    g = gap / F.sqrt(pooled) * (F.lit(1.0) - F.lit(3.0) / (F.lit(4.0) * df - 1))
    return F.when((n < 2) | (m < 2), F.lit(None)).when(pooled <= 0, F.when(gap == 0, F.lit(0.0))).otherwise(g)


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null for fewer than two rows or no variance."""
    return F.when(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 2, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def cohens_d(n_a: Column, mean_a: Column, std_a: Column, n_b: Column, mean_b: Column, std_b: Column) -> Column:
    """From summary rows with sample deviations: (b - a) over the pooled deviation; null if that is 0."""
    pooled = F.sqrt(F.try_divide((n_a - 1) * std_a * std_a + (n_b - 1) * std_b * std_b, n_a + n_b - 2))
    return F.when(pooled > 0, (mean_b - mean_a) / pooled)


def bootstrap_interval(left: list[float], right: list[float], replicates: int = 10_000, seed: int = 20260820) -> tuple[float, float] | None:
    """95 % interval of the difference of means; the generator draws the left sample before the right one."""
    if not left or not right:
        return None
    rng = random.Random(seed)
    n, m = len(left), len(right)
    found = []
    for _ in range(replicates):
        first = fmean([left[rng.randrange(n)] for _ in range(n)])
        found.append(fmean([right[rng.randrange(m)] for _ in range(m)]) - first)
    found.sort()
    return found[math.floor(0.025 * (replicates - 1))], found[math.ceil(0.975 * (replicates - 1))]


def bootstrap(df: DataFrame, group: str, side: str, value: str, order: str, left, right, replicates: int = 10_000, seed: int = 20260820) -> DataFrame:
    """(group, lo, hi) per group, values drawn in the order of ``order``."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("o")
        found = bootstrap_interval(part.v[part.s == left].tolist(), part.v[part.s == right].tolist(), replicates, seed) or (None, None)
        return pd.DataFrame({"grp": [part.g.iloc[0]], "lo": [found[0]], "hi": [found[1]]})

    rows = df.select(F.col(group).cast("string").alias("g"), F.col(side).alias("s"), F.col(value).cast("double").alias("v"), F.col(order).alias("o"))
    return rows.filter(F.col("s").isin(left, right) & F.col("v").isNotNull()).groupBy("g").applyInPandas(run, "grp string, lo double, hi double")
