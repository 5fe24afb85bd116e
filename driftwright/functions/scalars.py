"""Dates inside strings, URLs, categories and ordered reasons, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def published_year(published: Column) -> Column:
    """Year in the string's own offset."""
    return F.try_to_number(F.substring(published, 1, 4), F.lit("9999")).cast("int")


def published_month(published: Column) -> Column:
    return F.try_to_number(F.substring(published, 6, 2), F.lit("99")).cast("int")


def is_published_valid(published: Column) -> Column:
    """ISO date and time with an offset that names a real moment; null is not."""
    parsed = F.try_to_timestamp(published)
    return F.coalesce(published.rlike(ISO_WITH_OFFSET) & parsed.isNotNull(), F.lit(False))


def first_match(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches with something in it; else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def first_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(20\d{2})", 1), F.lit("")).cast("int")


def leading_year(text: Column) -> Column:
    head = F.substring(text, 1, 4)
    return F.when(head.rlike(r"^\d{4}$"), head.cast("int"))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def canonical_url(url: Column) -> Column:
    """https, lower-case host, path without a slash at its end, neither query nor fragment."""
    return F.concat(F.lit("https://"), url_host(url), F.regexp_replace(url_path(url), "/+$", ""))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that a row breaks (null counts as broken); null if it keeps all."""
    out = None
    for name, keeps in rules:
        broken = ~F.coalesce(keeps, F.lit(False))
        out = F.when(broken, F.lit(name)) if out is None else out.when(broken, F.lit(name))
    return out


def classify(text: Column, tokens: list[str], other: str = "other") -> Column:
    """The first token, in the given order, that the lower-cased text contains."""
    out = None
    for token in tokens:
        hit = F.contains(F.lower(text), F.lit(token))
        out = F.when(hit, F.lit(token)) if out is None else out.when(hit, F.lit(token))
    return out.otherwise(F.lit(other))


def month_gap(year_a: Column, month_a: Column, year_b: Column, month_b: Column) -> Column:
    return F.abs((year_b * 12 + month_b) - (year_a * 12 + month_a)).cast("int")


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(value, digits) + F.lit(0.0)
