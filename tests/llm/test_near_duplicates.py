from __future__ import annotations

import random
import re

import numpy as np
import pytest

from driftwright.llm import common
from driftwright.llm import near_duplicates as nd
from driftwright.llm.common import materialise
from driftwright.llm.components import connected_components

from .helpers import SCHEMA, awkward, awkward_rows, empty


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    """{id: (set size, component)} of rows (id, text)."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i][0]), find(i)) for i in ids}


def check(spark, rows):
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == sorted((i, len(shingles(t)), want[i][1], want[i][1] == i) for i, t in rows)


def test_small_buckets_match_brute_force(spark):
    draw = random.Random(4)
    base = [[f"w{draw.randrange(5000)}" for _ in range(draw.choice([3, 6, 40, 200]))] for _ in range(25)]
    rows = []
    for i in range(150):
        words = list(base[i % 25])
        for _ in range(draw.randrange(4)):
            words[draw.randrange(len(words))] = f"x{i}"
        rows.append((1000 - i, " ".join(words).upper() if i % 4 == 0 else "\t".join(words)))
    check(spark, rows)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Variants of one text in crowded buckets, many of which link only with some that are not the least one."""
    monkeypatch.setattr(nd, "SMALL", 4)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 3000)
    draw = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(110):
        words = list(base)
        for _ in range(draw.randrange(0, 7)):
            words[draw.randrange(120)] = f"e{draw.randrange(9)}"
        rows.append((i + 1, " ".join(words)))
    check(spark, rows)


def words(draw, n, of="w"):
    return " ".join(f"{of}{draw.randrange(10**6)}" for _ in range(n))


def test_rows_of_one_id_are_one_node(spark):
    draw = random.Random(2)
    a, b, c = (words(draw, 30) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (7, b), (9, b)]
    check(spark, rows)
    assert {r["component_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {3}
    check(spark, [*rows, (5, ""), (5, b), (4, None), (4, c), (2, c), (8, ""), (8, None), (1, c + " x"), *[(6, b)] * 50])
    many = [(draw.randrange(20), draw.choice([a, b, c, words(draw, 12), words(draw, 4), a + " y", ""])) for _ in range(60)]
    check(spark, many)
    for parts in (1, 4):
        frame = spark.createDataFrame([*rows, (9, c)], "doc_id long, text string").repartition(parts)
        assert [tuple(r) for r in nd.drop_near_duplicates(frame).collect()] == [(3, a)]
    two = [(1, b, 7), (1, a, 7), (1, a, 5), (2, a, 1)]
    for parts in (1, 4):
        kept = nd.drop_near_duplicates(spark.createDataFrame(two, "doc_id long, text string, n int").repartition(parts)).collect()
        assert [tuple(r) for r in kept] == [min((r for r in two if r[0] == 1), key=lambda r: (r[1], str(r[2])))]


def test_a_passage_of_all_documents_joins_none_and_costs_little(spark, monkeypatch):
    """Every document begins with one passage, so all share buckets; only the planted copies are linked, and no block holds more than these."""
    monkeypatch.setattr(nd, "SMALL", 4)
    monkeypatch.setattr(nd, "HOT_ROWS", 50)
    compared = spark.sparkContext.accumulator(0)
    real = nd._linked_in_block

    def counted(block):
        compared.add(int(block["outer"].sum()) * int((~block["outer"]).sum()))
        return real(block)

    monkeypatch.setattr(nd, "_linked_in_block", counted)
    draw = random.Random(6)
    passage = words(draw, 12, "p")
    rows = [(i, f"{passage} {words(draw, 9)}") for i in range(400)]
    rows += [(1000 + i, t + " z") for i, t in rows[:20]]
    check(spark, rows)
    assert compared.value < 5 * len(rows)


def test_texts_that_nothing_is_near_to_are_not_shuffled(spark):
    """With no table small enough to be broadcast, what moves is the signatures and the texts of the copies, not all texts."""
    draw = random.Random(8)
    rows = [(i, words(draw, 3000)) for i in range(200)]
    rows += [(1000 + i, t + " z") for i, t in rows[:5]]
    frame = materialise(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "texts")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = nd.drop_near_duplicates(frame).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r["doc_id"], r["text"]) for r in kept) == rows[:200]
    assert shuffled() - before < 0.3 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("most", [15, 27])
def test_rows_of_ids_are_split_off(spark, monkeypatch, most):
    """All rows of the ids are in the second part and all rows in one of the two, however full the bitmap is."""
    monkeypatch.setattr(common, "MOST_BITS", most)
    ids = spark.range(0, 60_000, 3).selectExpr("id * 7919 AS a")
    rows = spark.range(60_000).selectExpr("id * 7919 AS doc_id", "id AS n").unionByName(spark.sql("SELECT CAST(NULL AS long) AS doc_id, -1L AS n"))
    plain, others = common.split_by_ids(rows, "doc_id", ids, "a")
    plain, others = {r["n"] for r in plain.collect()}, {r["n"] for r in others.collect()}
    assert plain.isdisjoint(others) and plain | others == set(range(-1, 60_000)) and -1 in plain
    assert others >= set(range(0, 60_000, 3))
    assert most < 27 or len(others) < 20_000 + 0.1 * 40_000


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = nd.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(rows)
    named = brute([(r[0], r[1]) for r in rows if r[0] is not None])
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == named[r["doc_id"]]
    kept = nd.drop_near_duplicates(awkward(spark)).collect()
    ids = [r["doc_id"] for r in kept]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in named.items() if i == c)
    assert ids.count(None) == 1 and set(kept[0].asDict()) == set(x.split()[0] for x in SCHEMA.split(", "))
    assert nd.near_duplicates(empty(spark)).count() == 0 and nd.drop_near_duplicates(empty(spark)).count() == 0


def test_keys_meet_every_pair_within_the_distance():
    rng = np.random.RandomState(1)
    for _ in range(300):
        a = rng.randint(0, 1 << 16, 48).astype(np.uint16)
        b = a.copy()
        off = rng.choice(48, nd.DISTANCE, replace=False)
        b[off] ^= rng.randint(1, 1 << 16, nd.DISTANCE).astype(np.uint16)
        differ = (a != b).reshape(nd.CHUNKS, nd.LANES).sum(axis=1)
        assert differ.min() <= 1


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9)], [(i, i + 1) for i in range(40)] + [(100, i) for i in range(60, 90)]])
def test_connected_components(spark, edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(parent)}
