"""Shared plumbing: tables in the cluster's shared folder and distributed running totals."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftwright-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later jobs and lost executors restart from files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/driftwright-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once the results that read them have been written."""
    root = f"{shared_folder(spark)}/driftwright-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def deal_hot_keys(rows: DataFrame, key: str, mark: Column, single: DataFrame, single_key: str, weight: str, per_task: int) -> DataFrame:
    """Inner join of rows with one row a key that tells how many rows to expect (``weight``).

    A key of more than ``per_task`` rows meets them in as many shares as that takes, dealt by the hash ``mark``. The table of
    such keys is shorter than the rows by that factor; it is written, so that Spark sees its size before it chooses a join.
    """
    shares = F.ceil(F.col(weight) / per_task).cast("int")
    hot = materialise(single.filter(F.col(weight) > per_task).select(F.col(single_key).alias("hot_key"), shares.alias("hot_shares")), "hot-keys")
    rows = rows.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("hot_share", F.pmod(mark, F.coalesce("hot_shares", F.lit(1))).cast("int"))
    single = single.withColumn("its_share", F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1)))
    found = rows.join(single, (F.col(key) == F.col(single_key)) & (F.col("hot_share") == F.col("its_share")))
    return found.drop("hot_key", "hot_shares", "hot_share", "its_share")


PAGE_BITS = 15
MOST_BITS = 27


def split_by_ids(rows: DataFrame, key: str, ids: DataFrame, id_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not one of the ids, the others), without moving a row; null keys are among the first.

    ``ids`` is a written table. Its hashes set bits in a bitmap of 16 to 32 bits an id, at most 2 ** ``MOST_BITS`` (16 MB) in all,
    which every task gets; so an exact join with the ids has to move only their rows and a few hundredths of the rest. More
    ids than fill the bitmap leave more rows to that join and lose none.
    """
    bits = min(max((16 * ids.count()).bit_length(), PAGE_BITS), MOST_BITS)

    def place(column: str) -> tuple[Column, Column]:
        slot = F.shiftrightunsigned(F.xxhash64(F.col(column).cast("long")), 64 - bits)
        return F.shiftright(slot, PAGE_BITS), slot.bitwiseAND(F.lit((1 << PAGE_BITS) - 1))

    page, at = place(id_key)
    pages = ids.filter(F.col(id_key).isNotNull()).groupBy(page.alias("bitmap_page")).agg(F.bitmap_construct_agg(at).alias("bitmap_bits"))
    page, at = place(key)
    page = F.when(F.col(key).isNotNull(), page)
    met = rows.withColumns({"row_page": page, "row_at": at}).join(F.broadcast(pages), F.col("row_page") == F.col("bitmap_page"), "left")
    byte = F.conv(F.hex(F.expr("substring(bitmap_bits, CAST(shiftright(row_at, 3) AS INT) + 1, 1)")), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, F.col("row_at").bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    own = ["row_page", "row_at", "bitmap_page", "bitmap_bits"]
    return met.filter(~found).drop(*own), met.filter(found).drop(*own)


def block_count(spark: SparkSession) -> int:
    """Blocks for range-partitioned work: a few for each shuffle partition, independent of the rows."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


LEAST = -(2**63)


def cut_points(df: DataFrame, key: str, blocks: int, within: str | None = None) -> list[tuple[int, int]]:
    """At most ``blocks - 1`` ascending cuts (value of an integer column, least value of ``within``) into blocks of similar row counts.

    A value that would fill several blocks by itself is cut at its rows' quantiles of ``within``, an integer
    column; without one it stays whole.
    """
    if blocks < 2:
        return []
    marks = [i / blocks for i in range(1, blocks)]
    found = Counter(df.agg(F.percentile_approx(key, marks, 10 * blocks).alias("cuts")).first()["cuts"] or [])
    cuts = {(k, LEAST) for k in found}
    hot = {k: n for k, n in found.items() if n > 1}
    if hot and within is not None:
        grid = max(hot.values()) + 1
        inner = df.filter(F.col(key).isin(list(hot))).groupBy(key).agg(F.percentile_approx(within, [i / grid for i in range(1, grid)], 10 * grid).alias("cuts"))
        for row in inner.collect():  # fewer numbers in all than there are blocks, on a grid as long as the hottest value's
            parts = hot[row[key]] + 1
            cuts |= {(row[key], row["cuts"][i * (grid - 1) // parts]) for i in range(1, parts)}
    return sorted(cuts)


def number_list(values: list[int]) -> str:
    """SQL of a constant array, written as one string: an expression for each number would take longer to plan than to run."""
    return f"cast(split('{','.join(map(str, values))}', ',') AS array<bigint>)" if values else "cast(array() AS array<bigint>)"


def block_of(key: str, cuts: list[tuple[int, int]], within: str | None = None) -> Column:
    """How many cuts are not above the row, by binary search in a constant array; null keys fall in block 0."""
    if not cuts:
        return F.lit(0)
    at = "shiftright(s.lo + s.hi, 1)"
    below = f"{key} < {number_list([k for k, _ in cuts])}[{at}]"
    if within is not None:
        equal = f"{key} = {number_list([k for k, _ in cuts])}[{at}]"
        below = f"({below} OR {equal} AND {within} < {number_list([w for _, w in cuts])}[{at}])"
    step = f"IF(s.lo >= s.hi, s, IF({below}, named_struct('lo', s.lo, 'hi', {at}), named_struct('lo', {at} + 1, 'hi', s.hi)))"
    search = f"aggregate(sequence(1, {len(cuts).bit_length()}), named_struct('lo', 0, 'hi', {len(cuts)}), (s, x) -> {step}, s -> s.lo)"
    return F.expr(f"IF({key} IS NULL, 0, {search})")


def running_totals(df: DataFrame, block: str, order: list, values: dict[str, Column]) -> DataFrame:
    """Add for each value ``before_<name>``, its sum over all earlier rows, and ``all_<name>``, its grand total.

    Rows run by (block, order). Every block is summed in its own task; only one row a block is then
    scanned in sequence, and that table, as long as the number of blocks, is what gets broadcast.
    """
    df = df.withColumns({f"v_{n}": c.cast("long") for n, c in values.items()})
    earlier = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(block).agg(*[F.sum(f"v_{n}").alias(f"t_{n}") for n in values])
    heads = totals.select(
        F.col(block).alias("head_block"),
        *[F.coalesce(F.sum(f"t_{n}").over(earlier), F.lit(0)).alias(f"o_{n}") for n in values],
        *[F.sum(f"t_{n}").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"all_{n}") for n in values],
    )
    inside = Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"i_{n}": F.coalesce(F.sum(f"v_{n}").over(inside), F.lit(0)) for n in values})
    df = df.join(F.broadcast(heads), F.col(block) == F.col("head_block"))
    df = df.withColumns({f"before_{n}": F.col(f"o_{n}") + F.col(f"i_{n}") for n in values})
    return df.drop("head_block", *[f"{p}_{n}" for n in values for p in "voi"])
