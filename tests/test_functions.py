from __future__ import annotations

import math
import random
import statistics
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftwright.functions import scalars as sc
from driftwright.functions import stats as st
from driftwright.functions import text as tx


def entropy(text, n):
    counts = Counter(text[i : i + n] for i in range(len(text) - n + 1))
    total = sum(counts.values())
    return -sum(c / total * math.log2(c / total) for c in counts.values())


def test_ngram_stats_match_plain_python(spark):
    draw = random.Random(1)
    texts = ["ABABA", "aaaaaa", "x", "", None, "数学😀数学", "".join(draw.choice("abcd é") for _ in range(700))]
    rows = tx.with_ngram_stats(tx.with_ngram_stats(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", 2, "bi"), "t", 3, "tri").collect()
    for r in rows:
        text = r["t"]
        for n, got in ((2, r["bi"]), (3, r["tri"])):
            if text is None or len(text) < n:
                assert got is None
            else:
                grams = [text[i : i + n] for i in range(len(text) - n + 1)]
                assert (got["total"], got["distinct"]) == (len(grams), len(set(grams)))
                assert math.isclose(got["entropy"], entropy(text, n), abs_tol=1e-9)
    assert math.isclose(rows[0]["bi"]["entropy"], 1.0) and rows[1]["bi"]["entropy"] == 0.0


def test_grams_of_any_size_and_no_others(spark):
    draw = random.Random(2)
    for text in ["ABABA", "數学😀數学", "".join(draw.choice("ab\U0010ffff ") for _ in range(200))]:
        for n in (1, 2, 3, 4, 5, 7):
            grams = [text[i : i + n] for i in range(len(text) - n + 1)]
            got = tx.gram_stats(text, n)
            assert got is None if not grams else got[:2] == (len(grams), len(set(grams))) and math.isclose(got[2], entropy(text, n), abs_tol=1e-9)
    frame = spark.createDataFrame([("ab",)], "t string")
    for n in (0, -1):
        with pytest.raises(ValueError):
            tx.with_ngram_stats(frame, "t", n, "x")
        with pytest.raises(ValueError):
            tx.window_stats(F.col("t"), (2, n))


def test_window_stats_normalise_cut_and_count_in_one_crossing(spark):
    texts = ["ＡＢ  ＡＢ Ａ", "ab", "", None, "数学 数学 数学"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.window_stats(F.col("t"), (2,), 4).alias("m"), tx.normalized_window(F.col("t"), 4).alias("w"))
    for r in frame.collect():
        whole = None if r["t"] is None else tx.normalized(r["t"])
        assert r["m"]["chars"] == r["w"]["chars"] == (None if whole is None else len(whole))
        assert r["w"]["window"] == (None if whole is None else whole[:4])
        if whole is None or len(whole) < 4:
            assert r["m"]["total_2"] is None and r["m"]["entropy_2"] is None
        else:
            assert r["m"]["total_2"] == 3 and math.isclose(r["m"]["entropy_2"], entropy(whole[:4], 2), abs_tol=1e-9)
    measured = frame.filter("m.chars >= 4").select("m.entropy_2")
    assert measured._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_normalize_text_folds_width_and_every_space(spark):
    texts = ["  Ｆｕｌｌ　width\x1c\x85end ", "ﬁ①", None, "", "a\xa0 b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.normalize_text("t")).collect()]
    assert got == [None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) for t in texts]


PAGE = '<p>out</p><div class="body x"><p>Ｉn<br>side</p><script>no()</script><noscript>no</noscript> more</div><p>after</p>'


@pytest.mark.parametrize("source, strict, want", [
    (PAGE.replace("<br>", " "), True, "In side more"),
    (PAGE, False, "In side more"),
    (PAGE, True, "In side more after"),
    ('<div class="body">a</p>b</div>c', True, "a"),
    ('<div class="body">a</div>x<div class="body">b</div>', True, "a b"),
    ('<div class="other">a</div>', True, ""),
    (None, True, None),
])
def test_body_text_counts_tags(source, strict, want):
    assert tx.body_text(source, tx.by_class("body"), strict) == want


def test_body_by_data_name_and_errors(spark):
    extract = tx.html_body(tx.by_data_name_or_class("body", "text-body"))
    rows = spark.createDataFrame([('<div data-name="body">one</div>',), ('<p class="x text-body">two</p>',), ("<p>none</p>",), (None,)], "h string").select(extract("h").alias("r")).collect()
    assert [r["r"]["value"] for r in rows] == ["one", "two", None, None]
    assert [r["r"]["error"] is None for r in rows] == [True, True, False, False]


def test_reaction_count_precedence(spark):
    pages = [
        (5, "<button>9</button>"), (None, '<button aria-label="like">1,884</button><button>2</button>'), (None, "<button>7</button><button> 7 </button>"),
        (None, "<button>7</button><button>8</button>"), (None, "<p>7</p>"), (None, '<button aria-label="like">3</button><button aria-label="like">4</button>'),
    ]
    rows = spark.createDataFrame(pages, "structured long, html string").withColumn("n", tx.button_numbers("like")("html"))
    assert [r[0] for r in rows.select(tx.unambiguous(F.col("structured"), F.col("n.labelled"), F.col("n.numeric"))).collect()] == [5, 1884, 7, None, None, None]


def test_dates_stay_in_their_own_offset(spark):
    at = ["2022-01-01T00:00:00+09:00", "2022-08-01T00:00:00Z", "2022-01-01T00:00:00", "2022-13-41T00:00:00Z", "soon", None, "2024-02-29T10:00:00.5-02:30"]
    rows = spark.createDataFrame([(x,) for x in at], "p string").select(sc.published_year(F.col("p")).alias("y"), sc.published_month(F.col("p")).alias("m"), sc.is_published_valid(F.col("p")).alias("ok")).collect()
    assert [(r["y"], r["m"]) for r in rows[:2]] == [(2022, 1), (2022, 8)]
    assert [r["ok"] for r in rows] == [True, True, False, False, False, False, True]


def test_urls_categories_reasons_and_gaps(spark):
    one = spark.range(1)
    url = F.lit("https://Corpus.Example/a/articles/x/?q=1#t")
    got = one.select(sc.canonical_url(url).alias("c"), sc.path_segments(sc.url_path(url)).alias("s"), sc.month_gap(F.lit(2023), F.lit(12), F.lit(2024), F.lit(2)).alias("g"), sc.classify(F.lit("Sitemap-Book1.xml"), ["article", "book"]).alias("k"), sc.first_match(F.lit("b=2"), ["a=(.)", "b=(.)"]).alias("f")).first()
    assert (got["c"], got["s"], got["g"], got["k"], got["f"]) == ("https://corpus.example/a/articles/x", ["a", "articles", "x"], 2, "book", "2")
    reason = sc.first_reason([("a", F.lit(None).cast("boolean")), ("b", F.lit(False))])
    assert one.select(reason).first()[0] == "a"
    assert one.select(sc.first_reason([("a", F.lit(True))])).first()[0] is None


def test_describe_and_effects_match_plain_python(spark):
    draw = random.Random(3)
    left, right = [draw.gauss(0, 1) for _ in range(9)], [draw.gauss(1, 2) for _ in range(6)]
    rows = spark.createDataFrame([("l", v) for v in left] + [("r", v) for v in right], "s string, v double")
    got = rows.filter("s = 'l'").agg(*st.describe(F.col("v"), "v"), *st.quartiles(F.col("v"), "v")).first()
    for name, want in (("n", 9), ("mean", statistics.fmean(left)), ("median", statistics.median(left)), ("std", statistics.pstdev(left)), ("q1", statistics.quantiles(left, n=4, method="inclusive")[0])):
        assert math.isclose(got[f"v_{name}"], want, abs_tol=1e-5)
    pooled = math.sqrt((8 * statistics.variance(left) + 5 * statistics.variance(right)) / 13)
    g = (statistics.fmean(right) - statistics.fmean(left)) / pooled * (1 - 3 / (4 * 13 - 1))
    assert math.isclose(rows.agg(st.hedges_g(F.col("v"), F.col("s") == "l", F.col("s") == "r")).first()[0], g, abs_tol=1e-9)
    assert rows.filter("s = 'x'").agg(*st.describe(F.col("v"), "v")).first().asDict() == {"v_n": 0, "v_mean": None, "v_median": None, "v_std": None, "v_min": None, "v_max": None}


@pytest.mark.parametrize("rows, want", [([("l", 1.0), ("r", 2.0), ("r", 3.0)], None), ([("l", 1.0)] * 2 + [("r", 1.0)] * 2, 0.0), ([("l", 1.0)] * 2 + [("r", 2.0)] * 2, None)])
def test_hedges_g_edges(spark, rows, want):
    assert spark.createDataFrame(rows, "s string, v double").agg(st.hedges_g(F.col("v"), F.col("s") == "l", F.col("s") == "r")).first()[0] == want


def test_pearson_edges(spark):
    def r(pairs):
        return spark.createDataFrame(pairs, "x double, y double").agg(st.pearson(F.col("x"), F.col("y"))).first()[0]

    assert math.isclose(r([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]), 1.0)
    assert r([(1.0, 2.0)]) is None and r([(1.0, 2.0), (1.0, 3.0)]) is None


def test_cohens_d_from_summary_rows(spark):
    row = spark.range(1).select(st.cohens_d(F.lit(3), F.lit(2.0), F.lit(1.0), F.lit(3), F.lit(4.0), F.lit(1.0)).alias("d"), st.cohens_d(F.lit(3), F.lit(2.0), F.lit(0.0), F.lit(3), F.lit(4.0), F.lit(0.0)).alias("z")).first()
    assert row["d"] == 2.0 and row["z"] is None


def test_bootstrap_is_seeded_and_grouped(spark):
    left, right = [1.0, 2.0, 4.0], [3.0, 3.5, 8.0, 9.0]
    found = st.bootstrap_interval(left, right, 400, 7)
    rng, means = random.Random(7), []
    for _ in range(400):
        a = statistics.fmean([left[rng.randrange(3)] for _ in left])
        means.append(statistics.fmean([right[rng.randrange(4)] for _ in right]) - a)
    means.sort()
    assert found == (means[math.floor(0.025 * 399)], means[math.ceil(0.975 * 399)]) and st.bootstrap_interval([], right) is None
    rows = [("g", "l", v, i) for i, v in enumerate(left)] + [("g", "r", v, 9 + i) for i, v in enumerate(right)] + [("h", "l", 1.0, 0)]
    frame = spark.createDataFrame(rows, "g string, s string, v double, o int")
    for parts in (1, 5):
        got = {r["grp"]: (r["lo"], r["hi"]) for r in st.bootstrap(frame.repartition(parts), "g", "s", "v", "o", "l", "r", 400, 7).collect()}
        assert got == {"g": found, "h": (None, None)}


def test_reactions_by_keys_then_buttons(spark):
    pages = [
        ('<script>{"likesCount": 7, "like_count": 9}</script><button aria-label="like">3</button>', "7"), ('{"like_count" : 12}', "12"),
        ('<button aria-label="like">1,884</button><button>5</button>', "1884"), ("<button>5</button><button>5</button>", "5"),
        ("<button>5</button><button>6</button>", None), ("", None), (None, None),
    ]
    rows = spark.createDataFrame(pages, "html string, want string").select("want", tx.reaction_count(F.col("html"), "like").alias("got"))
    assert all(r["got"] == r["want"] for r in rows.collect())


def test_injected_scorer_is_checked(spark):
    def predict(text):
        if text == "raise":
            raise KeyError("no model")
        return {"none": {"label": None, "probability": 0.5}, "type": {"label": "x", "probability": "high"}, "list": []}.get(text, {"label": 1, "probability": len(text) / 10})

    texts = ["abc", "none", "type", "list", "raise", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.scored(F.col("t"), lambda t: {"size": len(t)}, predict).alias("s")).collect()
    got = {r["t"]: r["s"] for r in rows}
    assert (got["abc"]["features"], got["abc"]["label"], got["abc"]["probability"], got["abc"]["error"]) == ({"size": 3.0}, "1", 0.3, None)
    assert [got[t]["error"].split(":")[0] for t in ("none", "type", "list", "raise")] == ["ValueError", "TypeError", "TypeError", "KeyError"]
    assert got[None]["error"] is None and got[None]["label"] is None


def test_errors_name_their_type(spark):
    rows = spark.createDataFrame([("1",), ("x",), (None,)], "t string").select("t", tx.with_errors("long", lambda t: int(t))("t").alias("r")).collect()
    assert [(r["r"]["value"], (r["r"]["error"] or "").split(":")[0]) for r in rows] == [(1, ""), (None, "ValueError"), (None, "TypeError")]
