"""Reports: canonical JSON and JSON lines, staleness checks, privacy projection and fail-closed endings."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_text(report: dict, canonical: bool = True) -> str:
    """Indented JSON that keeps non-ASCII characters and ends in a newline; canonical sorts the keys."""
    return json.dumps(report, ensure_ascii=False, indent=2, sort_keys=canonical) + "\n"


def write_report(report: dict, path: str, canonical: bool = True) -> None:
    """Aggregates only: a report is assembled on the driver from collected summary rows."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(report_text(report, canonical), encoding="utf-8")


def is_stale(report: dict, path: str, canonical: bool = True) -> bool:
    """Whether the file's bytes differ from what would be written now."""
    target = Path(path)
    return not target.exists() or target.read_text(encoding="utf-8") != report_text(report, canonical)


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows in order, keys sorted, nulls written, as text files that keep that order."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.orderBy(*order).select(line.alias("value")).write.mode("overwrite").text(path)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def public_columns(df: DataFrame, private: tuple[str, ...] = ("text", "html", "body", "window")) -> DataFrame:
    """Without the columns that hold contents."""
    return df.drop(*private)


def fail_on_errors(df: DataFrame, error: str = "error") -> None:
    """Stop the job if any row carries an error, naming how many and the first few."""
    bad = df.filter(F.col(error).isNotNull())
    count = bad.count()
    if count:
        shown = [r[0] for r in bad.select(error).orderBy(error).limit(5).collect()]
        raise RuntimeError(f"{count} rows failed: {shown}")
