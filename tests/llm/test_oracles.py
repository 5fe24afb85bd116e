"""Operators that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from driftwright.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_operator_equals_sql(spark, sf, name):
    session = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        session.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    relation = session.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]

    def row(values):
        return tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in values)

    assert sorted((row(r[c] for c in columns) for r in frame.collect()), key=repr) == sorted((row(r[i] for i in order) for r in relation.fetchall()), key=repr)
