"""Document fingerprints by locally consistent parsing.

A level takes a text as a string of symbols. Runs of one symbol become one symbol. Deterministic coin tossing
then relabels every symbol by the lowest bit in which it differs from its left neighbour, four times
over, which leaves a few small labels of which neighbours differ; local maxima of the labels start phrases.
A phrase is named by a hash of its symbols in order, and the names are the symbols of the next level. Where a
phrase starts depends on a few neighbours only, so equal substrings have the same phrases inside,
wherever they stand. The fingerprint is a min-hash sketch of the names from the second level up (phrases of
about ten characters and more) together with the name of the whole text; the likeness of two fingerprints is the
share of equal lanes, which estimates the likeness of the two sets of names.

Texts are parsed many at a time in one array, cut where a text begins. The next document (by descending id,
ties by text, rows without id last, after the last row the first) comes from a range partitioning of the
ids and, where an id fills several ranges, of the texts' first bytes: each range also gets the first row of the range below it.

Null texts count as empty; empty texts share one fingerprint. Repeated rows are rows of their own, each the next
of the other. A single row is its own next document. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LEAST, block_count, block_of, cut_points, number_list, read_table

LANES, FIRST_LEVEL, TOSSES = 48, 2, 4
GROUP_CHARS = 300_000

_DRAWN = np.random.RandomState(19).randint(0, 2**32, (2, LANES), dtype=np.uint64).astype(np.uint32)
_TIMES, _PLUS = (_DRAWN[0] | np.uint32(1))[:, None], _DRAWN[1][:, None]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _SPREAD
    x ^= x >> np.uint64(29)
    x *= _ODD
    x ^= x >> np.uint64(32)
    return x


def _merge_runs(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One symbol for each maximal run within a text."""
    head = first.copy()
    head[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(head)
    if len(at) == len(x):
        return x, first
    runs = np.diff(at, append=len(x)).astype(np.uint64)
    x = x[at]
    long = runs > 1
    x[long] = _mix(x[long] ^ (runs[long] * _SPREAD))
    return x, first[at]


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest bit that differs from the left neighbour, plus that bit; a text's first symbol takes bit 0."""
    one = x.dtype.type(1)
    differ = np.empty_like(x)
    differ[0] = one
    np.bitwise_xor(x[1:], x[:-1], out=differ[1:])
    differ[first] = one
    low = np.bitwise_count((differ & (~differ + one)) - one)
    bit = (x >> low.astype(x.dtype)) & one
    return (low << np.uint8(1)) | bit.astype(np.uint8)


def _phrases(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of every text, and which of them begin a text."""
    x, first = _merge_runs(x, first)
    label = x
    for _ in range(TOSSES):
        label = _toss(label, first)
    start = first.copy()
    if len(x) > 2:
        start[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    at = np.flatnonzero(start)
    place = np.arange(len(x)) - np.repeat(at, np.diff(at, append=len(x)))
    return _mix(np.add.reduceat(_mix(x + (place.astype(np.uint64) * _ODD)), at)), first[at]


def _sketch(names: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """(texts, lanes): minima of lane-wise hashes over each text's names."""
    low, high = names.astype(np.uint32), (names >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begins), LANES), dtype=np.uint16)
    ends = np.append(begins[1:], len(names))
    at = 0
    while at < len(begins):
        upto = max(at + 1, int(np.searchsorted(ends, begins[at] + 4096, "right")))
        least = np.full((LANES, upto - at), 2**32 - 1, dtype=np.uint32)
        for lo in range(begins[at], ends[upto - 1], 8192):
            hi = min(lo + 8192, ends[upto - 1])
            x = low[lo:hi] * _TIMES + _PLUS
            x ^= x >> np.uint32(15)
            x ^= high[lo:hi]
            x *= _TIMES
            x ^= x >> np.uint32(13)
            cuts = np.maximum(begins[at:upto], lo) - lo
            live = np.flatnonzero((begins[at:upto] < hi) & (ends[at:upto] > lo))
            least[:, live] = np.minimum(least[:, live], np.minimum.reduceat(x, cuts[live], axis=1))
        out[at:upto] = (least & np.uint32(0xFFFF)).T
        at = upto
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """Hexadecimal sketches of the texts' phrase names."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    full = np.flatnonzero(sizes)
    out = ["f" * (4 * LANES)] * len(texts)
    if not len(full):
        return out
    x = _mix(np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + _ODD)
    owner = full
    begins = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    first = np.zeros(len(x), dtype=bool)
    first[begins] = True
    names, owners, level = [], [], 0
    while len(owner):
        x, first = _phrases(x, first)
        level += 1
        begins = np.flatnonzero(first)
        counts = np.diff(begins, append=len(x))
        whole = counts == 1
        keep = np.repeat(whole | (level >= FIRST_LEVEL), counts)
        names.append(x[keep])
        owners.append(np.repeat(owner, counts)[keep])
        stay = np.repeat(~whole, counts)
        x, first, owner = x[stay], first[stay], owner[~whole]
    names, owners = np.concatenate(names), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    names, owners = names[order], owners[order]
    marks = np.flatnonzero(np.diff(owners, prepend=-1))
    for i, lanes in zip(owners[marks], _sketch(names, marks), strict=True):
        out[i] = lanes.astype(">u2").tobytes().hex()
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal lanes of two fingerprints."""
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / LANES if a != b else 1.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many leading ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (block, halo, descending id): each row meets the one after it in its block."""

    def done(rows: list[tuple]) -> pd.DataFrame:
        """Results of all rows but the last, and of none that was only lent to the block."""
        texts = [r[3] for r in rows]
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        changed = [edited(texts[i], texts[i + 1]) for i in pairs]
        marks = fingerprints(texts + changed)
        out = []
        for k, i in enumerate(pairs):
            own, new = marks[i], marks[len(texts) + k]
            sha = hashlib.sha256(changed[k].encode()).hexdigest()
            out.append((rows[i][2], len(texts[i]), sha, own, new, likeness(own, new), likeness(own, marks[i + 1])))
        return pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})

    rows: list[tuple] = []
    chars = 0
    for batch in batches:
        for row in zip(batch["block"], batch["halo"], (None if pd.isna(i) else int(i) for i in batch["doc_id"]), batch["text"], strict=True):
            rows.append(row)
            chars += len(row[3])
            if chars >= GROUP_CHARS and len(rows) > 1:
                yield done(rows)
                rows, chars = rows[-1:], len(row[3])
    if len(rows) > 1:
        yield done(rows)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: fingerprints of the text and of its edited text, and their likeness to each other and to the next document's."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a row's place: its id and, downwards, the first bytes of its text, so that rows of one id need not share a block
    head = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    rows = rows.withColumns({"k": F.coalesce("doc_id", F.lit(LEAST)), "w": -head})
    blocks = block_count(docs.sparkSession)
    cuts = cut_points(rows.select("k", "w"), "k", blocks, "w")
    rows = rows.withColumn("block", block_of("k", cuts, "w"))
    tops = rows.groupBy("block").agg(F.max(F.struct("k", "w")).alias("top")).select("block", "top.*")
    tops = sorted(tuple(r) for r in tops.collect())  # one row a block
    place = {name: [0] * (len(cuts) + 1) for name in ("k", "w", "to")}
    for i, (block, k, w) in enumerate(tops):
        place["k"][block], place["w"][block], place["to"][block] = k, w, tops[(i + 1) % len(tops)][0]

    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("halo"))
    lent = F.struct(F.expr(f"{number_list(place['to'])}[block]").cast("int").alias("block"), F.lit(True).alias("halo"))
    is_top = F.expr(f"k = {number_list(place['k'])}[block] AND w = {number_list(place['w'])}[block]")
    rows = rows.select("doc_id", "text", "k", F.explode(F.when(is_top, F.array(own, lent)).otherwise(F.array(own))).alias("to"))
    rows = rows.select("doc_id", "text", "k", "to.block", "to.halo").repartitionById(len(cuts) + 1, "block")
    rows = rows.sortWithinPartitions("block", "halo", F.desc("k"), "text").select("block", "halo", "doc_id", "text")
    return rows.mapInPandas(_compare, RESULT)


def op8_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))
