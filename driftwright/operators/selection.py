"""Deterministic samples: hash order, strata, caps per author, matched quartiles, carry-forward and last-wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str) -> list[Column]:
    """Order by SHA-256 of a key, then the key."""
    return [F.sha2(key, 256), F.col(key)]


def top_per_group(df: DataFrame, group: list[str], order: list, k: int | Column, rank: str = "rank") -> DataFrame:
    """The first k rows of every group, ranked from 1."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def capped_sample(df: DataFrame, stratum: list[str], author: str, key: str, target: int, cap: int = 1) -> DataFrame:
    """Per stratum the first ``target`` rows in hash order with at most ``cap`` of one author.

    Ranking authors first and strata second equals the greedy walk, since a skipped row never uses up quota.
    """
    per_author = top_per_group(df, [*stratum, author], hash_order(key), cap, "_author_rank").drop("_author_rank")
    return top_per_group(per_author, stratum, hash_order(key), target)


def matched_quartile(df: DataFrame, stratum: str, side: str, sides: tuple, score: str, key: str) -> DataFrame:
    """Per stratum and side the same number of top rows: a quarter, rounded up, of the smaller side."""
    sizes = df.groupBy(stratum).agg(*[F.count(F.when(F.col(side) == s, 1)).alias(f"n{i}") for i, s in enumerate(sides)])
    sizes = sizes.select(stratum, F.least(*[F.ceil(F.col(f"n{i}") / 4) for i in range(len(sides))]).cast("int").alias("matched"))
    rows = df.filter(F.col(side).isin(*sides)).join(sizes, stratum)
    return top_per_group(rows, [stratum, side], [F.desc(score), *hash_order(key)], F.col("matched"))


def keep_last(df: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of every key in the given (descending) order."""
    return top_per_group(df, [key], order, 1, "_last").drop("_last")


def carry_forward(df: DataFrame, group: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Add the last non-null value up to and with the current row."""
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def head_tail(df: DataFrame, order: str, k: int) -> DataFrame:
    """The first and the last k rows if there are more than k, else all; ``part`` says which. Middle rows of a
    short table come twice."""
    head = df.orderBy(order).limit(k).withColumn("part", F.lit("head"))
    tail = df.orderBy(F.desc(order)).limit(k).withColumn("part", F.lit("tail"))
    more = df.orderBy(order).limit(k + 1).agg((F.count("*") > k).alias("more"))
    return head.unionByName(tail.join(F.broadcast(more.filter("more")).select(F.lit(True).alias("_m")), F.lit(True)).drop("_m"))
