from __future__ import annotations

import hashlib
import random

import numpy as np

from driftwright.llm import phrase_fingerprints as pf

from .helpers import awkward, awkward_rows, empty


def slow_phrases(symbols):
    """One level of one text, symbol by symbol."""

    def mix(x):
        return int(pf._mix(np.array([x % 2**64], dtype=np.uint64))[0])

    merged, i = [], 0
    while i < len(symbols):
        j = i
        while j < len(symbols) and symbols[j] == symbols[i]:
            j += 1
        merged.append(symbols[i] if j - i == 1 else mix(symbols[i] ^ (j - i) * int(pf._SPREAD) % 2**64))
        i = j
    labels = merged
    for _ in range(pf.TOSSES):
        tossed = []
        for k, x in enumerate(labels):
            low = 0
            if k:
                differ = x ^ labels[k - 1]
                while not differ >> low & 1:
                    low += 1
            tossed.append(2 * low + (x >> low & 1))
        labels = tossed
    starts = [0] + [k for k in range(1, len(labels) - 1) if labels[k - 1] < labels[k] > labels[k + 1]] + [len(labels)]
    return [mix(sum(mix(merged[k] + (k - a) * int(pf._ODD)) for k in range(a, b))) for a, b in zip(starts, starts[1:], strict=False)]


def test_parsing_matches_the_slow_one():
    draw = random.Random(2)
    texts = ["".join(draw.choice("ab c") for _ in range(n)) for n in (1, 2, 3, 50, 400)] + ["aaaaaaa", "abababab", "zzzy" * 9]
    for text in texts:
        fast, slow = np.array([ord(c) for c in text], dtype=np.uint64), [ord(c) for c in text]
        first = np.zeros(len(fast), dtype=bool)
        first[0] = True
        while len(slow) > 1:
            fast, first = pf._phrases(fast, first)
            slow = slow_phrases(slow)
            assert fast.tolist() == slow and first.tolist() == [True] + [False] * (len(slow) - 1)


def test_texts_parsed_together_equal_texts_parsed_alone():
    texts = ["", "a", "aa", "the cat sat " * 20, "", "x" * 500, "naïve 😀 text", "the cat sat " * 20] + ["".join(random.Random(i).choice("abcdef ") for _ in range(i)) for i in range(60)]
    together = pf.fingerprints(texts)
    assert together == [pf.fingerprints([t])[0] for t in texts]
    assert together[3] == together[7] and together[0] == together[4]


def test_equal_substrings_share_phrases_at_any_offset():
    draw = random.Random(8)
    text = " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(600))
    own, shifted, other = pf.fingerprints([text, "zq! " + text, "".join(reversed(text))])
    assert pf.likeness(own, shifted) > 0.9 and pf.likeness(own, other) < 0.1 and pf.likeness(own, own) == 1.0


def test_every_row_meets_its_next_document(spark):
    rows = awkward_rows()
    got = pf.fingerprint_documents(awkward(spark)).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (doc, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        changed = pf.edited(text, following)
        half = len(text) // 2
        assert changed == text[: len(text) - half] + following[: min(half, len(following))]
        own, new, after = pf.fingerprints([text, changed, following])
        want.append((str(doc), len(text), hashlib.sha256(changed.encode()).hexdigest(), own, new, pf.likeness(own, new), pf.likeness(own, after)))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert pf.fingerprint_documents(empty(spark)).count() == 0
    single = pf.fingerprint_documents(awkward(spark).filter("doc_id = 9")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0


def test_query_over_more_blocks_than_rows(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in pf.op8_phrase_fingerprints(spark, sf).collect()}
    assert set(got) == set(docs)
    for i in docs:
        changed = pf.edited(docs[i], docs[(i - 1) % len(docs)])
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and got[i]["n_chars"] == len(docs[i])
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.25 > 0.05 > np.mean([r["near_next"] for r in got.values()])
