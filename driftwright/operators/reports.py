"""Joining summaries of one frozen sample into a report, and refusing to when they do not belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_status(status: str, allowed: set[str]) -> None:
    """A stage runs only on inputs whose own stage ended well."""
    if status not in allowed:
        raise ValueError(f"status {status!r} is none of {sorted(allowed)}")


def require_collection_contract(sitemap: dict, pages: dict, paths: set[str], policy: str) -> None:
    """Both reports compatible, no forbidden path used, the declared paths among those collected, and the policy stated."""
    require_status(sitemap.get("status"), {"compatible"})
    require_status(pages.get("status"), {"compatible"})
    if pages.get("forbidden_paths_used") is not False:
        raise ValueError("a forbidden path was used, or it is not said that none was")
    collected = pages.get("collection_paths")
    if not isinstance(collected, list) or not paths <= set(collected):
        raise ValueError("the collected paths lack those of the contract")
    if not isinstance(sitemap.get("collector_policy"), str) or policy not in sitemap["collector_policy"]:
        raise ValueError("the collector's policy is not stated")


def consistent_manifest(reports: DataFrame) -> str:
    """The one manifest hash of (report, manifest, n); different hashes or row counts are an error."""
    found = reports.agg(F.countDistinct("manifest").alias("hashes"), F.countDistinct("n").alias("counts"), F.min("manifest").alias("manifest")).first()
    if found["hashes"] != 1:
        raise ValueError("the reports come from different manifests")
    if found["counts"] != 1:
        raise ValueError("the reports measure different numbers of rows")
    return found["manifest"]


def research_summary(reports: DataFrame, endpoints: DataFrame, gaps: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: manifest, rows, endpoint differences with their intervals by metric, gap correlations and label counts.

    ``endpoints`` has (metric, mean_difference, lo, hi), ``gaps`` one row of correlations, ``labels`` (label, n).
    """
    manifest = consistent_manifest(reports)
    zero = ((F.col("lo") <= 0) & (F.col("hi") >= 0)).alias("includes_zero")
    ends = endpoints.agg(F.array_sort(F.collect_list(F.struct("metric", "mean_difference", "lo", "hi", zero))).alias("endpoints"), F.every((F.col("lo") <= 0) & (F.col("hi") >= 0)).alias("all_include_zero"))
    counted = labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    rows = reports.agg(F.lit(manifest).alias("manifest"), F.max("n").alias("n"))
    for part in (ends, gaps.select(F.struct("*").alias("gaps")), counted):
        rows = rows.join(F.broadcast(part), F.lit(True))  # one row each
    return rows.withColumn("status", F.when(F.col("all_include_zero"), "no_stable_signal").otherwise("needs_validation"))
