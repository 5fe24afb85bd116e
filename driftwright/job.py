"""Run a registered query as a job: ``python -m driftwright.job QUERY --input DIR --output PATH [--limit N] [--check]``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from driftwright import plans
from driftwright.sources.sinks import same_rows


def parameters(arguments: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Run a registered query.")
    parser.add_argument("query", choices=sorted(plans.QUERIES | plans.WHOLE))
    parser.add_argument("--input", required=True, help="folder of the tables")
    parser.add_argument("--output", required=True, help="Parquet folder of the result")
    parser.add_argument("--limit", type=int, help="at most so many rows")
    parser.add_argument("--check", action="store_true", help="write nothing; fail if the output differs from what would be written")
    chosen = parser.parse_args(arguments)
    if chosen.limit is not None and chosen.limit < 1:
        parser.error("--limit must be at least 1")
    return chosen


def run(spark: SparkSession, chosen: argparse.Namespace) -> None:
    rows = (plans.QUERIES | plans.WHOLE)[chosen.query](spark, chosen.input)
    if chosen.limit is not None:
        rows = rows.orderBy(*rows.columns).limit(chosen.limit)
    if not chosen.check:
        rows.write.mode("overwrite").parquet(chosen.output)
    elif not same_rows(rows, spark.read.parquet(chosen.output)):
        raise SystemExit(f"{chosen.output} is stale")


if __name__ == "__main__":
    run(SparkSession.builder.appName("driftwright").getOrCreate(), parameters())
