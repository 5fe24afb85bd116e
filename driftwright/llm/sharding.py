"""Sharding by global byte-size prefix sums: contiguous shards cut at equal byte targets.

A document's size is its UTF-8 bytes plus 1; a null text has none. Rows run by (id, size, checksum), null
ids first, so repeated rows are interchangeable. Blocks of rows are summed in their own tasks (an id or the null ids that
would fill several blocks are cut by size and checksum; only rows equal in all three stay together), block totals
give each block its offset, and a row goes to the shard that holds the middle of its byte span. An empty
table gives no rows; with fewer rows than shards some shards stay empty. Only id, size and checksum of a
row are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LEAST, block_count, block_of, cut_points, materialise, read_table, running_totals


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16) -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot (0, 1, ... within the shard) and its byte offset in the shard order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = materialise(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")),
        "sizes",
    )
    # ids and, where one fills several blocks, size and checksum tell a row's block
    keyed = narrow.withColumns({"k": F.coalesce("doc_id", F.lit(LEAST)).cast("long"), "w": F.least("size", F.lit(2**30)) * 2**32 + F.col("text_crc32")})
    cuts = cut_points(keyed, "k", block_count(docs.sparkSession), "w")
    rows = keyed.withColumn("block", block_of("k", cuts, "w")).drop("k", "w")
    rows = running_totals(rows, "block", [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")], {"bytes": F.col("size"), "rows": F.lit(1)})
    middle = F.expr(f"((2 * before_bytes + size) * {n_shards}) div (2 * all_bytes)")
    rows = rows.select("doc_id", "size", "text_crc32", F.least(middle, F.lit(n_shards - 1)).cast("int").alias("shard"), F.col("before_bytes").alias("offset"), F.col("before_rows").alias("row"))
    rows = materialise(rows, "shards")
    firsts = rows.groupBy("shard").agg(F.min("row").alias("first_row")).withColumnRenamed("shard", "its_shard")
    rows = rows.join(F.broadcast(firsts), F.col("shard") == F.col("its_shard"))
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"), "offset")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_by_bytes(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "offset")
