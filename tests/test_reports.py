from __future__ import annotations

import pytest

from driftwright.operators import reports as rp


def reports(spark, *rows):
    return spark.createDataFrame(list(rows), "report string, manifest string, n long")


def test_summary_of_one_manifest(spark):
    same = reports(spark, ("entropy", "m", 5), ("pairs", "m", 5))
    endpoints = spark.createDataFrame([("tri", 0.2, 0.1, 0.3), ("bi", 0.1, -0.1, 0.2)], "metric string, mean_difference double, lo double, hi double")
    gaps = spark.createDataFrame([(0.01, 10)], "r double, n long")
    labels = spark.createDataFrame([("b", 2), ("a", 3)], "label string, n long")
    row = rp.research_summary(same, endpoints, gaps, labels).first()
    assert (row["manifest"], row["n"], row["labels"], row["gaps"]["r"], row["status"]) == ("m", 5, {"a": 3, "b": 2}, 0.01, "needs_validation")
    assert [(e["metric"], e["includes_zero"]) for e in row["endpoints"]] == [("bi", True), ("tri", False)]


@pytest.mark.parametrize("other, message", [(("pairs", "x", 5), "different manifests"), (("pairs", "m", 6), "different numbers")])
def test_mixed_reports_are_refused(spark, other, message):
    with pytest.raises(ValueError, match=message):
        rp.consistent_manifest(reports(spark, ("entropy", "m", 5), other))


def test_status_is_required():
    rp.require_status("compatible", {"compatible"})
    with pytest.raises(ValueError, match="blocked"):
        rp.require_status("blocked", {"compatible"})


def test_collection_contract():
    from driftwright.operators.reports import require_collection_contract

    site = {"status": "compatible", "collector_policy": "robots+sitemap only, public pages"}
    pages = {"status": "compatible", "forbidden_paths_used": False, "collection_paths": ["/sitemaps/*", "/a/*", "/more"]}
    wanted = ({"/sitemaps/*", "/a/*"}, "robots+sitemap only")
    require_collection_contract(site, pages, *wanted)
    for a, b in [({"status": "failed"}, {}), ({}, {"status": "failed"}), ({}, {"forbidden_paths_used": None}), ({}, {"collection_paths": ["/a/*"]}), ({}, {"collection_paths": None}), ({"collector_policy": None}, {})]:
        with pytest.raises(ValueError):
            require_collection_contract(site | a, pages | b, *wanted)
