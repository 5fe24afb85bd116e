from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.util import PythonEvalType

from driftwright import plans
from driftwright.functions import text as tx


def optimized(spark, sf, name):
    return plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def streamed(plan):
    nodes = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    return bool(nodes) and all(line.endswith(f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}") for line in nodes)


@pytest.mark.parametrize("name", ["rms_zscore_distance", "surface_features", "normalize_text", "measure_projection"])
def test_normalised_texts_are_streamed(spark, sf, name):
    assert streamed(optimized(spark, sf, name))


def test_results_leave_python_by_rows_and_code_points(monkeypatch):
    seen, plain = [], pa.array
    batch = pa.array([*["a"] * 2500, *["b" * 600_000] * 5, None])
    monkeypatch.setattr(tx.pa, "array", lambda rows, kind: seen.append(len(rows)) or plain(rows, kind))
    out = pa.concat_arrays(tx.normalize_text.func(iter([batch, batch[:0]])))
    assert out.equals(batch) and seen == [tx.HELD_ROWS, tx.HELD_ROWS, 502, 2, 2]


def test_length_gates_take_no_text_back(spark, sf):
    for name in ("length_gate_strict", "length_gate_retain"):
        plan = optimized(spark, sf, name)
        assert streamed(plan) and "length(" not in plan
    texts = ["ﬁ  x", None, "", "数学　数学"] * 700
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalized_length("t").alias("n")).collect()
    assert [r["n"] for r in got] == [None if t is None else len(tx.normalized(t)) for t in texts]


@pytest.mark.parametrize("name", ["char_ngram_entropy", "ngram_profile", "endpoint_comparison", "unordered_pairs"])
def test_windows_are_streamed(spark, sf, name):
    lines = [line for line in optimized(spark, sf, name).splitlines() if "ArrowEvalPython" in line and "(text" in line]
    assert lines and all(streamed(line) for line in lines)
