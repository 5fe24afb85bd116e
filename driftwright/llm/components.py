"""Connected components by alternating large-star and small-star steps over a written edge table.

A round is two joins of pairs with one row a node. A node of more than ``HUB_PAIRS`` pairs is dealt over as many tasks as
its number asks for; which nodes those are is known from the count that ends the round before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deal_hot_keys, materialise

HUB_PAIRS = 100_000


def _with_least(pairs: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    """Join (u, v) with (u, m, n), n the number of u's pairs."""
    least = least.select(F.col("u").alias("w"), "m", "n")
    if not hubs:
        return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")
    return deal_hot_keys(pairs, "u", F.xxhash64("v"), least, "w", "n", HUB_PAIRS).select("u", "v", "m")


def _state(edges: DataFrame) -> tuple[bool, int]:
    """Whether no node has several neighbours below it or some both below and above it, and the most neighbours of a node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    roles = ends.groupBy("node").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    found = roles.agg(F.max(F.expr("below > 1 OR below > 0 AND above > 0")).alias("tangled"), F.max(F.col("below") + F.col("above")).alias("most")).first()
    return not found["tangled"], found["most"] or 0


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node. Loops and repeats are allowed."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = materialise(now, "edges")
    while True:
        stars, most = _state(now)
        if stars:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both, least, most > HUB_PAIRS).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, most > HUB_PAIRS).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
