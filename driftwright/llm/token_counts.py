"""Token counts: the exact histogram of encoded lengths answers every context limit.

Each whole text is encoded once; only (length, documents) leaves the scan. Suffix sums over the
histogram give, for every length taken as a context limit, the documents and tokens at or above it,
what truncation keeps, and quantiles. A null text counts as empty (length 0); repeated rows count
each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_count, block_of, cut_points, materialise, read_table, running_totals

RANKS = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_length(text, path: str | None = None, pattern: str | None = None):
    """Column of token counts of a string column under a byte-level BPE rank file."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            yield batch.map(lambda x: len(encode(x)) if x else 0).astype("int64")

    return count(text)


def length_histogram(docs: DataFrame, text_col: str = "text", **tokenizer) -> DataFrame:
    """(length, docs): how many documents encode to each length."""
    lengths = docs.select(encoded_length(F.col(text_col), **tokenizer).alias("length"))
    return lengths.groupBy("length").agg(F.count("*").alias("docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """Per length L: docs and tokens at or above L, tokens that truncation at L keeps, padding at L, and the
    share of documents of at most L tokens (so the q-quantile is the first L whose share reaches q)."""
    hist = materialise(histogram, "lengths")
    cuts = cut_points(hist, "length", block_count(hist.sparkSession))
    rows = hist.withColumn("block", block_of("length", cuts))
    rows = running_totals(rows, "block", [F.col("length")], {"docs": F.col("docs"), "tokens": F.col("length") * F.col("docs")})
    above = F.col("all_docs") - F.col("before_docs")
    return rows.select(
        "length",
        "docs",
        above.alias("docs_at_least"),
        (F.col("all_tokens") - F.col("before_tokens")).alias("tokens_at_least"),
        (F.col("before_tokens") + F.col("length") * above).alias("tokens_truncated"),
        (F.col("length") * F.col("all_docs") - (F.col("before_tokens") + F.col("length") * above)).alias("padding"),
        ((F.col("before_docs") + F.col("docs")) / F.col("all_docs").cast("double")).alias("share_at_most"),
        F.col("all_tokens").alias("tokens_total"),
    )


def quantile(table: DataFrame, q: float) -> int | None:
    """Smallest length that at least the share ``q`` of documents does not exceed."""
    return table.filter(F.col("share_at_most") >= q).agg(F.min("length").alias("x")).first()["x"]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_table(length_histogram(read_table(spark, sf_dir, "documents")))
