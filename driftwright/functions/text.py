"""Text expressions: normalisation, fixed windows, character n-gram statistics and HTML extraction.

Everything that Spark can express is a built-in expression; Unicode NFKC, counts of n-grams (sorted as whole numbers, several
times cheaper than sorting strings in interpreted array functions) and HTML parsing are Arrow-batched functions.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

WINDOW = 1000


def normalized(text: str) -> str:
    """NFKC, runs of Unicode white space to one space, no space at either end."""
    return " ".join(unicodedata.normalize("NFKC", text).split())


@F.pandas_udf(StringType())
def decode_utf8(body: pd.Series) -> pd.Series:
    """Bytes as UTF-8, U+FFFD for every malformed part; null stays null."""
    return body.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="replace"))


def with_errors(result_type: str, function: Callable):
    """Arrow function over one column: struct(value, error), the error naming the type of what ``function`` raised for a row."""

    @F.pandas_udf(f"value {result_type}, error string")
    def guarded(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            try:
                rows.append((function(value), None))
            except Exception as fault:  # noqa: BLE001 - a row's failure is its result
                rows.append((None, f"{type(fault).__name__}: {fault}"))
        return pd.DataFrame(rows, columns=["value", "error"])

    return guarded


def _once(function):
    """Marked non-deterministic, so that no filter on its result is pushed below it and evaluates it again."""
    return function.asNondeterministic()


#: rows and code points of texts after which results of ``_each`` leave Python
HELD_ROWS, HELD_POINTS = 1000, 1_000_000


def _each(result_type, arrow_type: pa.DataType, one: Callable):
    """Arrow function of a text (or None) at a time. Beside Arrow's own batch, whose rows and bytes the session bounds, a worker
    holds one text and the results of a million code points, whatever the number of rows."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows, points = [], 0
            for scalar in batch:
                text = scalar.as_py()
                rows.append(one(text))
                points += len(text or "")
                if len(rows) >= HELD_ROWS or points >= HELD_POINTS:
                    yield pa.array(rows, arrow_type)
                    rows, points = [], 0
            if rows:
                yield pa.array(rows, arrow_type)

    return _once(F.arrow_udf(run, result_type))


#: ``normalized``; null stays null.
normalize_text = _each(StringType(), pa.string(), lambda t: None if t is None else normalized(t))

#: Code points of the normalised text, which itself stays in Python; null for null.
normalized_length = _each(LongType(), pa.int64(), lambda t: None if t is None else len(normalized(t)))


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """Character references to characters; null stays null."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def window(text: Column, size: int = WINDOW) -> Column:
    """The first ``size`` code points."""
    return F.substring(text, 1, size)


def gram_stats(text: str, n: int) -> tuple[int, int, float] | None:
    """(total, distinct, entropy in bits) of the overlapping n-grams of code points; None for a text shorter than n.

    Grams are whole numbers, three code points to a word; longer ones are built on the ranks of the shorter.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    total = len(points) - n + 1
    if total < 1:
        return None
    grams = points[:total]
    for k in range(1, n):
        if k > 2:
            grams = np.unique(grams, return_inverse=True)[1].astype(np.uint64)
        grams = (grams << np.uint64(21)) | points[k : k + total]
    grams = np.sort(grams)
    runs = np.diff(np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1], [True]])))
    many = runs[runs > 1].astype(np.float64)
    return total, len(runs), float(np.log2(total) - (many * np.log2(many)).sum() / total)


def _positive(sizes: tuple[int, ...]) -> None:
    if any(n < 1 for n in sizes):
        raise ValueError("n must be at least 1")


def with_ngram_stats(df: DataFrame, text_col: str, n: int, name: str) -> DataFrame:
    """Add ``name``: struct(total, distinct, entropy) of overlapping character n-grams of ``text_col``; null for a text
    shorter than n. The grams are counted inside their row, so nothing is exploded or shuffled."""
    _positive((n,))

    @_once
    @F.pandas_udf("total long, distinct long, entropy double")
    def stats(texts: pd.Series) -> pd.DataFrame:
        rows = [(None if t is None else gram_stats(t, n)) or (None, None, None) for t in texts]
        return pd.DataFrame(rows, columns=["total", "distinct", "entropy"]).astype({"total": "Int64", "distinct": "Int64"})

    df = df.withColumn(name, stats(text_col))
    return df.withColumn(name, F.when(F.col(f"{name}.total").isNotNull(), F.col(name)))


def normalized_window(text: Column, size: int = WINDOW) -> Column:
    """struct(chars, window): length of the normalised text and its first ``size`` code points."""

    def cut(text: str | None) -> dict:
        whole = None if text is None else normalized(text)
        return {"chars": None if whole is None else len(whole), "window": None if whole is None else whole[:size]}

    return _each("chars long, window string", pa.struct([("chars", pa.int64()), ("window", pa.string())]), cut)(text)


def window_stats(text: Column, sizes: tuple[int, ...] = (2, 3), size: int = WINDOW) -> Column:
    """struct(chars, and for each n total_n, distinct_n, entropy_n) of the first ``size`` code points of the normalised
    text, in one crossing to Python; a text shorter than ``size`` has its length and no statistics."""
    _positive(sizes)
    fields = [("chars", "long"), *[(f"{kind}_{n}", "double" if kind == "entropy" else "long") for n in sizes for kind in ("total", "distinct", "entropy")]]

    def stats(text: str | None) -> dict:
        whole = None if text is None else normalized(text)
        row = [None if whole is None else len(whole)]
        if whole is not None and len(whole) >= size:
            row += [v for n in sizes for v in gram_stats(whole[:size], n) or (None,) * 3]
        return dict(zip((name for name, _ in fields), row, strict=False))

    arrow_type = pa.struct([(name, pa.float64() if kind == "double" else pa.int64()) for name, kind in fields])
    return _each(", ".join(f"{name} {kind}" for name, kind in fields), arrow_type, stats)(text)


def finite(value: Column) -> Column:
    """The value, null when it is not a finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


# Elements without an end tag (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(["script", "style", "noscript"])


class _BodyText(HTMLParser):
    """Collects text inside containers by counting open tags.

    ``strict`` counts every start and end tag alike, as a counter that knows no void elements does; else void
    elements are skipped. ``self_closing`` tells if ``<x/>`` counts as a start and an end.
    """

    def __init__(self, is_container: Callable[[str, dict], bool], strict: bool, self_closing: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.is_container, self.strict, self.self_closing = is_container, strict, self_closing
        self.level = self.hidden = 0
        self.found: list[str] = []

    def _ignored(self, tag: str) -> bool:
        return not self.strict and tag in VOID

    def handle_starttag(self, tag, attrs):
        if self.level:
            if not self._ignored(tag):
                self.level += 1
                self.hidden += tag in HIDDEN
        elif self.is_container(tag, {k: v or "" for k, v in attrs}):
            self.level = 1

    def handle_startendtag(self, tag, attrs):
        if self.self_closing:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.level and not self._ignored(tag):
            if tag in HIDDEN and self.hidden:
                self.hidden -= 1
            self.level -= 1

    def handle_data(self, data):
        if self.level and not self.hidden:
            self.found.append(data)


def by_class(token: str) -> Callable[[str, dict], bool]:
    return lambda tag, attrs: token in attrs.get("class", "").split()


def by_tag(name: str) -> Callable[[str, dict], bool]:
    return lambda tag, attrs: tag == name


def by_data_name_or_class(name: str, token: str) -> Callable[[str, dict], bool]:
    return lambda tag, attrs: attrs.get("data-name") == name or token in attrs.get("class", "").split()


def body_text(source: str | None, is_container: Callable[[str, dict], bool], strict: bool = True, self_closing: bool = False) -> str | None:
    """Normalised text inside the containers of a page; null for null."""
    if source is None:
        return None
    parser = _BodyText(is_container, strict, self_closing)
    parser.feed(source)
    parser.close()
    return normalized(" ".join(parser.found))


def html_body(is_container: Callable[[str, dict], bool], strict: bool = True, self_closing: bool = False):
    """Arrow function over a column of pages: struct(value, error); an empty body is an error."""

    @F.pandas_udf("value string, error string")
    def extract(pages: pd.Series) -> pd.DataFrame:
        values = [body_text(p, is_container, strict, self_closing) for p in pages]
        return pd.DataFrame({"value": [v or None for v in values], "error": [None if v else "no body text" for v in values]})

    return extract


class _Buttons(HTMLParser):
    """Texts of buttons, apart those whose label names a reaction."""

    def __init__(self, label: str) -> None:
        super().__init__(convert_charrefs=True)
        self.label, self.open, self.named = label, False, False
        self.parts: list[str] = []
        self.buttons: list[tuple[bool, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "button":
            self.open, self.parts = True, []
            self.named = any(self.label in (v or "") for _, v in attrs)

    def handle_endtag(self, tag):
        if tag == "button" and self.open:
            self.buttons.append((self.named, "".join(self.parts).strip().replace(",", "")))
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.parts.append(data)


def button_numbers(label: str):
    """Arrow function: struct(labelled, numeric), the numbers shown on labelled and on all buttons of a page."""

    @F.pandas_udf("labelled array<long>, numeric array<long>")
    def numbers(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            parser = _Buttons(label)
            parser.feed(page or "")
            shown = [(named, int(t)) for named, t in parser.buttons if t.isascii() and t.isdigit()]
            rows.append(([v for named, v in shown if named], [v for _, v in shown]))
        return pd.DataFrame(rows, columns=["labelled", "numeric"])

    return numbers


# The keys under which pages state their reactions.
REACTION_KEYS = ["likeCount", "likesCount", "like_count"]


def reaction_count(page: Column, label: str, keys: list[str] = REACTION_KEYS) -> Column:
    """Reactions that a page shows: those of the first stated key; else the one number of its labelled buttons; else the
    one number of all its buttons; else null. As text, as pages write it."""
    stated = F.coalesce(*[F.nullif(F.regexp_extract(page, rf'"{key}"\s*:\s*(\d+)', 1), F.lit("")) for key in keys])
    shown = F.when(page.isNotNull() & stated.isNull(), button_numbers(label)(page))
    as_text = lambda name: F.transform(shown[name], lambda x: x.cast("string"))
    return unambiguous(stated, as_text("labelled"), as_text("numeric"))


def scored(text: Column, features: Callable[[str], dict], predict: Callable[[str], dict]) -> Column:
    """struct(features, label, probability, error) of a text by an injected scorer.

    ``features`` gives numbers by name, ``predict`` a dict with ``label`` and a numeric ``probability``; anything else is the row's
    error, as is an exception. A null text has neither values nor an error.
    """

    def number(value) -> float:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise TypeError(f"number expected, {type(value).__name__} found")
        return float(value)

    def one(content: str) -> tuple:
        found, prediction = features(content), predict(content)
        if not isinstance(found, dict) or not isinstance(prediction, dict):
            raise TypeError(f"dicts expected, {type(found).__name__} and {type(prediction).__name__} found")
        if prediction.get("label") is None or "probability" not in prediction:
            raise ValueError("label or probability is missing")
        return {str(k): number(v) for k, v in found.items()}, str(prediction["label"]), number(prediction["probability"]), None

    @F.pandas_udf("features map<string, double>, label string, probability double, error string")
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for content in texts:
            try:
                rows.append((None,) * 4 if content is None else one(content))
            except Exception as fault:  # noqa: BLE001 - a row's failure is its result
                rows.append((None, None, None, f"{type(fault).__name__}: {fault}"))
        return pd.DataFrame(rows, columns=["features", "label", "probability", "error"])

    return score(text)


def unambiguous(structured: Column, labelled: Column, numeric: Column) -> Column:
    """The structured value; else the one distinct labelled value; else the one distinct value; else null."""

    def only(values: Column) -> Column:
        kinds = F.array_distinct(values)
        return F.when(F.size(kinds) == 1, F.get(kinds, 0))

    return F.coalesce(structured, only(labelled), only(numeric))
