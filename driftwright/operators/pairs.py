"""Unordered pairs of a bounded sample, compression distance, and what is computed over pairs."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwright.functions import nearest as near
from driftwright.functions.scalars import month_gap


def unordered_pairs(sample: DataFrame, columns: list[str], idx: str = "idx") -> DataFrame:
    """Every pair of rows once, the one with the smaller position as ``a``; equal contents still pair.

    N(N-1)/2 rows by definition: made for samples whose size the selection bounds.
    """
    a = sample.select(*[F.col(c).alias(f"{c}_a") for c in columns])
    b = sample.select(*[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, F.col(f"{idx}_a") < F.col(f"{idx}_b"))


def labelled_pairs(sample: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of a sample with year, month and author, with what they share."""
    pairs = unordered_pairs(sample, ["idx", "year", "month", "author", *columns])
    return pairs.withColumns(
        {
            "same_year": F.col("year_a") == F.col("year_b"),
            "same_author": F.col("author_a") == F.col("author_b"),
            "gap": month_gap(F.col("year_a"), F.col("month_a"), F.col("year_b"), F.col("month_b")),
        }
    )


def deflated_size(data: bytes) -> int:
    return len(zlib.compress(data, 9))


def compression_distance(pairs: DataFrame, left: str, right: str, name: str = "ncd", size: Callable[[bytes], int] = deflated_size) -> DataFrame:
    """Add the normalised compression distance of two text columns; the left text comes first in the joint one."""

    @F.pandas_udf("double")
    def distance(xs: pd.Series, ys: pd.Series) -> pd.Series:
        known: dict[bytes, int] = {}

        def alone(data: bytes) -> int:
            if data not in known:
                known[data] = size(data)
            return known[data]

        out = []
        for x, y in zip(xs, ys, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            x, y = x.encode(), y.encode()
            cx, cy = alone(x), alone(y)
            out.append((size(x + y) - min(cx, cy)) / max(cx, cy))
        return pd.Series(out, dtype="float64")

    return pairs.withColumn(name, distance(left, right))


def nearest_other(pairs: DataFrame, idx: str, label: str, distance: str) -> DataFrame:
    """Per row its own label and its nearest other row's (ties by position)."""
    a = pairs.select(F.col(f"{idx}_a").alias("idx"), F.col(f"{label}_a").alias("actual"), F.col(f"{idx}_b").alias("other"), F.col(f"{label}_b").alias("predicted"), distance)
    b = pairs.select(F.col(f"{idx}_b").alias("idx"), F.col(f"{label}_b").alias("actual"), F.col(f"{idx}_a").alias("other"), F.col(f"{label}_a").alias("predicted"), distance)
    nearest = F.min_by("predicted", F.struct(distance, "other")).alias("predicted")
    return a.unionByName(b).groupBy("idx", "actual").agg(nearest)


def nearest_in_blocks(vectors: DataFrame, idx: str, label: str, vector: str, block: int = 30_000) -> DataFrame:
    """Per row (idx, actual) the nearest other row of the whole table, by distance to six places, then position: (dist, other, predicted).

    Every pair of blocks of at most about ``block`` rows meets once, in one task, and gives the nearest of each row both ways. Time grows
    with the square of the rows by definition; a task holds two blocks. Rows without position or vector take no part; a row
    alone has no nearest. All vectors must have one length.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    rows = vectors.filter(F.col(idx).isNotNull() & F.col(vector).isNotNull()).select(F.col(idx).alias("idx"), F.col(label).alias("label"), F.col(vector).cast(kind).alias("vector"))
    n = rows.count()
    blocks = max(-(-n // block), min(8, n // 1000), 1)
    width = F.size("vector")
    packed = rows.groupBy(F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int").alias("b")).agg(F.collect_list(F.struct("idx", "label", "vector")).alias("m"), F.min(width).alias("least"), F.max(width).alias("most"))
    packed = packed.select("b", F.col("m.idx").alias("idx"), F.col("m.label").alias("label"), F.flatten("m.vector").alias("vector"), "least", "most")
    sent = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("b", "other"), F.greatest("b", "other")
    sent = sent.withColumn("pair", (high * (high + 1) / 2 + low).cast("int"))
    met = sent.repartitionById(blocks * (blocks + 1) // 2, "pair")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                first = waiting.pop(r.pair, None)
                if len({r.least, r.most, *((first[0].least, first[0].most) if first else ())}) > 1:
                    raise ValueError("vectors of different lengths")
                ids = np.asarray(r.idx)
                here = r, near.Side.of(ids, np.asarray(r.vector).reshape(len(ids), r.most))
                if first is None and r.b != r.other:
                    waiting[r.pair] = here
                    continue
                x, y = first or here, here
                for (one, two), (at, dist, other) in zip([(x[0], y[0]), (y[0], x[0])], near.nearest(x[1], y[1]), strict=False):
                    labels, others = np.asarray(one.label, dtype=object), np.asarray(two.label, dtype=object)
                    yield pd.DataFrame({"idx": np.asarray(one.idx)[at], "actual": labels[at], "dist": dist, "other": np.asarray(two.idx)[other], "predicted": others[other]})

    kinds = dict(rows.dtypes)
    found = met.mapInPandas(search, f"idx {kinds['idx']}, actual {kinds['label']}, dist double, other {kinds['idx']}, predicted {kinds['label']}")
    best = F.min(F.struct("dist", "other", "predicted")).alias("n")
    return found.groupBy("idx", "actual").agg(best).select("idx", "actual", "n.dist", "n.other", "n.predicted")


def counterpart(df: DataFrame, keys: list[str], side: str, missing: str, left, right) -> DataFrame:
    """Rows on the left that lack a measurement, with the right-hand row of equal keys."""
    a = df.filter((F.col(side) == left) & F.col(missing).isNull()).select(*keys, F.col("idx").alias("idx_left"))
    b = df.filter((F.col(side) == right) & F.col(missing).isNotNull()).select(*keys, F.col("idx").alias("idx_right"))
    return a.join(b, keys)


def first_last(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """First and last value of every group by an explicit order."""
    return df.groupBy(*group).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def running_rank(df: DataFrame, group: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
