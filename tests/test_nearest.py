from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from driftwright import plans
from driftwright.functions import nearest as near
from driftwright.operators import pairs as pr

DRAW = np.random.default_rng(5)


def vectors(kind: str, n: int) -> np.ndarray:
    found = DRAW.normal(size=(n, 6))
    if kind == "ties":
        return DRAW.integers(0, 3, (n, 3)).astype(float)
    if kind == "below the rounding":
        return np.round(found, 1) * 1e-6
    if kind == "far from zero":
        return found * 1e-3 + 1e4
    if kind == "not finite":
        found[:4, 0] = [math.nan, math.inf, -math.inf, 1e160]
    return found


def brute(ids, rows, other_ids, others) -> dict:
    """Per position the least (undefined, distance, id) among rows of another id."""
    out = {}
    for k, (i, v) in enumerate(zip(ids, rows, strict=True)):
        with np.errstate(all="ignore"):
            dist = np.round(np.sqrt(((v - others) ** 2).sum(axis=1)), 6)
        found = [(bool(np.isnan(x)), 0.0 if np.isnan(x) else x, j) for x, j in zip(dist, other_ids, strict=True) if j != i]
        if found:
            out[k] = min(found)
    return out


@pytest.mark.parametrize("kind", ["usual", "ties", "below the rounding", "far from zero", "not finite", "repeated ids"])
def test_screened_search_equals_brute_force(kind):
    a, b = vectors(kind, 150), vectors(kind, 700)
    ids = DRAW.integers(0, 90, 150) if kind == "repeated ids" else DRAW.permutation(150)
    others = DRAW.permutation(700) + 1000
    x, y = near.Side.of(ids, a), near.Side.of(others, b)
    for found, wanted in [(near.nearest(x, y), [(ids, a, others, b), (others, b, ids, a)]), (near.nearest(x, x), [(ids, a, ids, a)])]:
        assert len(found) == len(wanted)
        for (at, dist, other), (p, v, q, w) in zip(found, wanted, strict=True):
            got = {int(k): (bool(np.isnan(d)), 0.0 if np.isnan(d) else d, q[o]) for k, d, o in zip(at, dist, other, strict=True)}
            assert got == brute(p, v, q, w)


def test_few_distances_are_computed_also_for_equal_vectors(monkeypatch):
    plain, seen = near.distances, []
    monkeypatch.setattr(near, "distances", lambda x, y: seen.append(max(x.shape[:-1] or (1,))) or plain(x, y))
    rows = DRAW.normal(size=(3000, 16))
    rows[:1500] = rows[0]
    side = near.Side.of(np.arange(3000), rows)
    near.nearest(side, side)
    assert sum(seen) < 20 * 3000


def test_undefined_vectors_cost_no_other_row_its_neighbour(spark, tmp_path):
    rows = [(i, i % 3, [float(x) for x in DRAW.normal(size=4)]) for i in range(40)]
    rows[7] = (7, 1, [math.nan] * 4)
    rows[8] = (8, 2, [math.inf, 0.0, 0.0, 0.0])
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    session = duckdb.connect()
    session.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(tuple(r) for r in plans.WHOLE["loo_1nn_all"](spark, str(tmp_path)).collect())
    assert got == sorted(session.sql(plans.WHOLE_ORACLES["loo_1nn_all"]).fetchall())
    blocks = pr.nearest_in_blocks(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), "vec_id", "label", "embedding", block=9)
    assert blocks.count() == 40


def test_vectors_of_different_lengths_are_refused(spark):
    table = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", [1.0])], "vec_id long, label string, embedding array<double>")
    with pytest.raises(Exception, match="different lengths"):
        pr.nearest_in_blocks(table, "vec_id", "label", "embedding").collect()
