from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from driftwright import plans
from driftwright.operators import pairs as pr
from driftwright.operators import selection as sel


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def articles(n=400, seed=1):
    draw = random.Random(seed)
    return [(i, draw.randint(1, 3), draw.randint(1, 2), f"a{draw.randint(0, 15)}", f"https://x.example/{i}") for i in range(n)]


def test_capped_sample_equals_the_greedy_walk_in_any_order(spark):
    rows = articles()
    want = set()
    for stratum in {(r[1], r[2]) for r in rows}:
        used, taken = defaultdict(int), 0
        for r in sorted((r for r in rows if (r[1], r[2]) == stratum), key=lambda r: (sha(r[4]), r[4])):
            if taken < 12 and used[r[3]] < 1:
                used[r[3]] += 1
                taken += 1
                want.add((*stratum, taken, r[0]))
    for seed in (2, 3):
        shuffled = list(rows)
        random.Random(seed).shuffle(shuffled)
        frame = spark.createDataFrame(shuffled, "idx int, year int, month int, author string, url string").repartition(seed)
        got = {(r["year"], r["month"], r["rank"], r["idx"]) for r in sel.capped_sample(frame, ["year", "month"], "author", "url", 12).collect()}
        assert got == want


def test_matched_quartile(spark):
    rows = [(1, "a", 10 * i, f"u{i}") for i in range(8)] + [(1, "b", 5, f"v{i}") for i in range(4)] + [(2, "a", 1, "w0")]
    got = sel.matched_quartile(spark.createDataFrame(rows, "month int, side string, score int, url string"), "month", "side", ("a", "b"), "score", "url").collect()
    best = min((f"v{i}" for i in range(4)), key=lambda u: (sha(u), u))
    assert {(r["month"], r["side"], r["url"], r["rank"]) for r in got} == {(1, "a", "u7", 1), (1, "b", best, 1)}


def test_carry_forward_head_tail_keep_last(spark):
    rows = spark.createDataFrame([("f", 1, None), ("f", 2, "x"), ("f", 3, None), ("g", 1, None)], "f string, i int, v string")
    got = {(r["f"], r["i"]): r["last"] for r in sel.carry_forward(rows, ["f"], "i", rows["v"], "last").collect()}
    assert got == {("f", 1): None, ("f", 2): "x", ("f", 3): "x", ("g", 1): None}
    for n, want in ((4, 4), (5, 5), (7, 10), (12, 10)):
        assert sel.head_tail(spark.range(n), "id", 5).count() == want
    last = sel.keep_last(spark.createDataFrame([("k", "a"), ("k", "b"), ("l", "c")], "key string, url string"), "key", [__import__("pyspark").sql.functions.desc("url")])
    assert {r["url"] for r in last.collect()} == {"b", "c"}


def sample(spark, texts):
    rows = [(i, 2022 + i % 2, 1 + i % 7, f"a{i % 3}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "idx int, year int, month int, author string, win string")


def test_pairs_are_unordered_and_keep_equal_texts(spark):
    frame = sample(spark, ["same", "same", "other", "x" * 50])
    got = pr.labelled_pairs(frame, ["win"]).collect()
    assert len(got) == 6 and all(r["idx_a"] < r["idx_b"] for r in got)
    assert {(r["idx_a"], r["idx_b"]) for r in got if r["same_author"]} == {(0, 3)}
    assert pr.unordered_pairs(spark.range(221).withColumnRenamed("id", "idx"), ["idx"]).count() == 24_310


def test_compression_distance_matches_its_definition(spark):
    texts = ["the cat sat on the mat " * 20, "the cat sat on the mat " * 19 + "dog", "zxcvbnm" * 40, "é😀" * 90]

    def c(x):
        return len(zlib.compress(x.encode(), 9))

    for r in pr.compression_distance(pr.labelled_pairs(sample(spark, texts), ["win"]), "win_a", "win_b").collect():
        a, b = r["win_a"], r["win_b"]
        assert r["ncd"] == (c(a + b) - min(c(a), c(b))) / max(c(a), c(b))


def test_nearest_other_breaks_ties_by_position(spark):
    rows = [(0, "p", 1, "q", 0.5), (0, "p", 2, "r", 0.5), (1, "q", 2, "r", 0.1)]
    got = pr.nearest_other(spark.createDataFrame(rows, "idx_a int, l_a string, idx_b int, l_b string, d double"), "idx", "l", "d")
    assert {(r["idx"], r["predicted"]) for r in got.collect()} == {(0, "q"), (1, "r"), (2, "q")}


def test_counterpart_excludes_both_of_a_match(spark):
    rows = spark.createDataFrame([(1, 2022, 1, 1, None), (2, 2026, 1, 1, 1.0), (3, 2022, 1, 2, 1.0), (4, 2026, 1, 2, 2.0)], "idx int, year int, month int, rank int, value double")
    got = pr.counterpart(rows, ["month", "rank"], "year", "value", 2022, 2026).collect()
    assert [(r["idx_left"], r["idx_right"]) for r in got] == [(1, 2)]


def test_first_last_by_explicit_order(spark):
    rows = spark.createDataFrame([("s", 2, "b"), ("s", 1, "z"), ("s", 3, "a")], "s string, pos int, loc string").repartition(3)
    assert tuple(pr.first_last(rows, ["s"], "loc", "pos").first()) == ("s", "z", "a")


def test_nearest_in_blocks_matches_brute_force(spark):
    rows = [(i, "abc"[i % 3], [float((i * 7 + k * k) % 11) for k in range(4)]) for i in range(60)] + [(None, "a", [0.0] * 4), (99, "a", None)]
    table = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    got = {r["idx"]: (r["dist"], r["other"], r["predicted"]) for r in pr.nearest_in_blocks(table, "vec_id", "label", "embedding", block=7).collect()}
    whole = [r for r in rows if r[0] is not None and r[2] is not None]
    assert got == {i: min((round(sum((x - y) ** 2 for x, y in zip(v, w, strict=True)) ** 0.5, 6), j, m) for j, m, w in whole if j != i) for i, _, v in whole}


def test_nearest_neighbours_of_every_vector(spark):
    sf = "/root/testdata/sf0.1"
    found = plans.WHOLE["loo_1nn_all"](spark, sf)
    assert found.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_whole_queries_equal_sql(spark, sf):
    session = duckdb.connect()
    session.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    for name, sql in plans.WHOLE_ORACLES.items():
        assert sorted(tuple(r) for r in plans.WHOLE[name](spark, sf).collect()) == sorted(session.sql(sql).fetchall())
