"""Grouped descriptions, composition, coverage and inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwright.functions import scalars as sc
from driftwright.functions import stats as st
from driftwright.functions.scalars import tidy
from driftwright.operators import pairs as pr

from .base import ARTICLES, CANDIDATES, MEASURED, article_index, articles, candidates, manifest, manifest_sql, measured, query, table


def described(value: str, name: str, spread: bool = True) -> str:
    """SQL of ``stats.describe``."""
    stats = {"mean": f"avg({value})", "median": f"median({value})", "std": f"stddev_pop({value})", "min": f"min({value})", "max": f"max({value})"}
    return ", ".join([f"count({value}) AS {name}_n", *(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {name}_{k}" for k, c in stats.items() if spread or k != "std")])


@query(f"SELECT o_orderpriority, {described('o_totalprice', 'price')} FROM orders GROUP BY 1")
def describe_by_group(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(*st.describe(F.col("o_totalprice"), "price"))


@query(f"SELECT l_linestatus, {described('l_quantity', 'quantity', False)} FROM lineitem GROUP BY 1")
def describe_no_std(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(*st.describe(F.col("l_quantity"), "quantity", spread=False))


@query(
    f"""WITH {ARTICLES} SELECT medium, {described('CAST(n_chars AS DOUBLE)', 'chars')}, round(quantile_cont(CAST(n_chars AS DOUBLE), CAST(0.25 AS DOUBLE)), 6) + 0.0 AS chars_q1,
  round(quantile_cont(CAST(n_chars AS DOUBLE), CAST(0.75 AS DOUBLE)), 6) + 0.0 AS chars_q3,
  round(quantile_cont(CAST(n_chars AS DOUBLE), CAST(0.75 AS DOUBLE)) - quantile_cont(CAST(n_chars AS DOUBLE), CAST(0.25 AS DOUBLE)), 6) + 0.0 AS chars_iqr FROM articles GROUP BY 1"""
)
def length_summary(spark, d):
    chars = F.col("n_chars").cast("double")
    return article_index(spark, d).groupBy("medium").agg(*st.describe(chars, "chars"), *st.quartiles(chars, "chars"))


@query(f"WITH {MEASURED} SELECT year, {described('bigram', 'bigram')}, {described('trigram', 'trigram')} FROM measured GROUP BY 1")
def entropy_by_year(spark, d):
    return measured(spark, d).groupBy("year").agg(*st.describe(F.col("bigram"), "bigram"), *st.describe(F.col("trigram"), "trigram"))


@query(f"WITH {MEASURED} SELECT year, month, {described('bigram', 'bigram')}, {described('trigram', 'trigram')} FROM measured GROUP BY 1, 2")
def entropy_by_year_month(spark, d):
    return measured(spark, d).groupBy("year", "month").agg(*st.describe(F.col("bigram"), "bigram"), *st.describe(F.col("trigram"), "trigram"))


@query(f"WITH {MEASURED} SELECT year, month, {described('bigram', 'bigram')} FROM measured GROUP BY GROUPING SETS ((year), (year, month), ())")
def entropy_grouping_sets(spark, d):
    sets = [[F.col("year")], [F.col("year"), F.col("month")], []]
    return measured(spark, d).select("year", "month", "bigram").groupingSets(sets, "year", "month").agg(*st.describe(F.col("bigram"), "bigram"))


@query(
    f"""WITH {ARTICLES}, c AS (SELECT year, coalesce(CAST(toxic AS VARCHAR), 'none') AS label, count(*) AS n FROM articles LEFT JOIN labels ON idx = doc_id GROUP BY 1, 2)
SELECT year, string_agg(label || ':' || n, ',' ORDER BY label) AS labels FROM c GROUP BY 1"""
)
def label_counts(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    rows = article_index(spark, d).join(labels, F.col("idx") == F.col("doc_id"), "left")
    counts = rows.groupBy("year", F.coalesce(F.col("toxic").cast("string"), F.lit("none")).alias("label")).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("label", "n")))
    return counts.groupBy("year").agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["label"], x["n"].cast("string"))), ",").alias("labels"))


FEATURES = r"""features AS (SELECT idx, medium, CAST(length(body) AS DOUBLE) AS char_count, CAST(len(string_split(body, ' ')) AS DOUBLE) AS word_count,
  CAST(greatest(len(regexp_extract_all(body, '[.!?]+')), 1) AS DOUBLE) AS sentence_count, CAST(len(regexp_extract_all(body, '[.,;:!?]')) AS DOUBLE) AS punct_count,
  CAST(len(list_filter(string_split(body, ' '), lambda x: regexp_matches(x, '^\p{Lu}\p{Ll}+'))) AS DOUBLE) AS title_case_count,
  CAST(len(list_filter(string_split(body, ' '), lambda x: regexp_matches(x, '^\p{Lu}{2,}'))) AS DOUBLE) AS upper_case_count FROM articles)"""


def feature_columns(spark, d):
    """Surface features of every article, one double column each."""
    rows = articles(spark, d)  # words stand between single spaces, so what begins one follows no other character
    return rows.select(
        "idx", "year", "month", "author", "medium",
        F.length("body").cast("double").alias("char_count"), (F.length("body") - F.length(F.replace("body", F.lit(" "))) + 1).cast("double").alias("word_count"),
        F.greatest(F.regexp_count("body", F.lit("[.!?]+")), F.lit(1)).cast("double").alias("sentence_count"),
        F.regexp_count("body", F.lit("[.,;:!?]")).cast("double").alias("punct_count"),
        F.regexp_count("body", F.lit(r"(?<![^ ])\p{Lu}\p{Ll}")).cast("double").alias("title_case_count"),
        F.regexp_count("body", F.lit(r"(?<![^ ])\p{Lu}{2}")).cast("double").alias("upper_case_count"),
    )


NAMES = ["char_count", "word_count", "sentence_count", "punct_count", "title_case_count", "upper_case_count"]


@query(
    f"""WITH {ARTICLES}, {FEATURES} SELECT idx, char_count, word_count, sentence_count, punct_count, title_case_count, upper_case_count,
  round((char_count - (word_count - 1)) / word_count, 6) + 0.0 AS avg_word_len, round(word_count / sentence_count, 6) + 0.0 AS avg_sentence_len FROM features"""
)
def surface_features(spark, d):
    rows = feature_columns(spark, d)
    letters = F.col("char_count") - (F.col("word_count") - 1)
    return rows.select("idx", *NAMES, tidy(letters / F.col("word_count")).alias("avg_word_len"), tidy(F.col("word_count") / F.col("sentence_count")).alias("avg_sentence_len"))


@query(
    f"""WITH {ARTICLES}, {FEATURES}, long AS (SELECT medium, feature, value FROM (SELECT medium, char_count, word_count, nullif(upper_case_count, 0) AS upper_case_count, title_case_count FROM features)
  UNPIVOT (value FOR feature IN (char_count, word_count, upper_case_count, title_case_count))), sizes AS (SELECT medium, count(*) AS rows_in_group FROM features GROUP BY 1)
SELECT medium, feature, {described('value', 'value')} FROM long JOIN sizes USING (medium) GROUP BY medium, feature, rows_in_group HAVING count(*) = rows_in_group"""
)
def feature_map_describe(spark, d):
    """A feature that any row of a group lacks is left out for the group."""
    rows = feature_columns(spark, d).withColumn("upper_case_count", F.nullif("upper_case_count", F.lit(0.0)))
    names = ["char_count", "word_count", "upper_case_count", "title_case_count"]
    maps = rows.select("medium", F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), lambda k, v: v.isNotNull()).alias("features"))
    sizes = maps.groupBy("medium").agg(F.count("*").alias("rows_in_group"))
    stats = maps.select("medium", F.explode("features").alias("feature", "value")).groupBy("medium", "feature").agg(*st.describe(F.col("value"), "value"))
    return stats.join(sizes, "medium").filter("value_n = rows_in_group").drop("rows_in_group")


@query(
    f"""WITH {ARTICLES}, {manifest_sql('articles')}, a AS (SELECT author, count(*) AS n, count(DISTINCT year) AS years, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS listed FROM manifest GROUP BY 1)
SELECT count(*) AS authors, max(n) AS most_articles, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE years > 1) AS in_several_years,
  string_agg(author || '=' || listed, ';' ORDER BY author) FILTER (WHERE years > 1) AS listed FROM a"""
)
def author_concentration(spark, d):
    per = manifest(article_index(spark, d)).groupBy("author").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.col("year").cast("string"))).alias("years"))
    several = F.size("years") > 1
    shown = F.array_sort(F.collect_list(F.when(several, F.struct("author", "years"))))
    return per.agg(
        F.count("*").alias("authors"), F.max("n").alias("most_articles"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(several).alias("in_several_years"),
        F.nullif(F.array_join(F.transform(shown, lambda x: F.concat(x["author"], F.lit("="), F.array_join(x["years"], ","))), ";"), F.lit("")).alias("listed"),
    )


@query(
    """SELECT event_type, count(*) AS urls, count(*) FILTER (WHERE value > 10) AS article_like, min(CAST(ts AS VARCHAR)[1:19]) AS first_mod, max(CAST(ts AS VARCHAR)[1:19]) AS last_mod
FROM events GROUP BY GROUPING SETS ((event_type), ())"""
)
def inventory_rollup(spark, d):
    mod = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = table(spark, d, "events").select("event_type", "value", mod.alias("mod"))
    return rows.rollup("event_type").agg(F.count("*").alias("urls"), F.count_if(F.col("value") > 10).alias("article_like"), F.min("mod").alias("first_mod"), F.max("mod").alias("last_mod"))


@query("SELECT conv_id, arg_min(role, turn) AS first, arg_max(role, turn) AS last FROM conversations GROUP BY 1")
def first_last_by_order(spark, d):
    return pr.first_last(table(spark, d, "conversations"), ["conv_id"], "role", "turn")


COVERAGE = r"""coverage AS (SELECT count(*) AS pages, count(*) FILTER (WHERE regexp_matches(html, '<title>[^<]+</title>')) AS titled, count(*) FILTER (WHERE regexp_matches(html, '<html lang="[a-z]+"')) AS with_lang,
  count(*) FILTER (WHERE contains(html, '<article')) AS with_article, count(*) FILTER (WHERE contains(html, 'datetime=')) AS dated FROM pages)"""


def coverage(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").agg(
        F.count("*").alias("pages"), F.count_if(html.rlike("<title>[^<]+</title>")).alias("titled"), F.count_if(html.rlike('<html lang="[a-z]+"')).alias("with_lang"),
        F.count_if(F.contains(html, F.lit("<article"))).alias("with_article"), F.count_if(F.contains(html, F.lit("datetime="))).alias("dated"),
    )


@query(f"WITH {COVERAGE} SELECT *, round(titled / CAST(pages AS DOUBLE), 6) AS title_rate, round(with_article / CAST(pages AS DOUBLE), 6) AS article_rate, round(dated / CAST(pages AS DOUBLE), 6) AS date_rate FROM coverage")
def extraction_coverage(spark, d):
    rate = {f"{n}_rate": F.round(F.col(c) / F.col("pages").cast("double"), 6) for n, c in (("title", "titled"), ("article", "with_article"), ("date", "dated"))}
    return coverage(spark, d).withColumns(rate)


@query(
    f"""WITH {CANDIDATES}, e AS (SELECT CAST(substr(published_at, 1, 4) AS INTEGER) + o AS year, o, CAST(substr(published_at, 6, 2) AS INTEGER) AS month, nullif(reactions % 7, 0) AS shown FROM candidates, (VALUES (0), (1)) t(o))
SELECT year, count(*) AS candidates, count(*) FILTER (WHERE o = 0 AND month BETWEEN 1 AND 7) AS in_window, count(shown) AS reaction_observed, count(*) FILTER (WHERE shown IS NULL) AS reaction_missing FROM e GROUP BY 1"""
)
def window_audit_counts(spark, d):
    at = F.col("published_at")
    rows = candidates(spark, d).select(sc.published_year(at).alias("y"), sc.published_month(at).alias("month"), F.nullif(F.col("reactions") % 7, F.lit(0)).alias("shown"))
    rows = rows.select("y", "month", "shown", F.explode(F.array(F.col("y"), F.col("y") + 1)).alias("year"))
    inside = (F.col("year") == F.col("y")) & F.col("month").between(1, 7)
    return rows.groupBy("year").agg(F.count("*").alias("candidates"), F.count_if(inside).alias("in_window"), F.count("shown").alias("reaction_observed"), F.count_if(F.col("shown").isNull()).alias("reaction_missing"))


MANIFESTS = f"""WITH {ARTICLES}, {manifest_sql('articles')}, r AS (SELECT 'lengths' AS report, count(*) AS n, sha256(string_agg(url, chr(10) ORDER BY url)) AS h FROM manifest
  UNION ALL SELECT 'authors', count(author), sha256(string_agg(url, chr(10) ORDER BY url)) FROM manifest UNION ALL SELECT 'media', count(medium), sha256(string_agg(url, chr(10) ORDER BY url)) FROM manifest WHERE year >= 2022)"""


@query(f"{MANIFESTS} SELECT count(*) AS reports, count(DISTINCT h) AS hashes, count(DISTINCT n) AS counts, count(DISTINCT h) = 1 AND count(DISTINCT n) = 1 AS consistent FROM r")
def manifest_consistency(spark, d):
    rows = manifest(article_index(spark, d))

    def report(name, frame, counted):
        text = F.array_join(F.array_sort(F.collect_list("url")), "\n")
        return frame.agg(F.lit(name).alias("report"), F.count(counted).alias("n"), F.sha2(text, 256).alias("h"))

    reports = report("lengths", rows, "url").unionByName(report("authors", rows, "author")).unionByName(report("media", rows.filter("year >= 2022"), "medium"))
    hashes, counts = F.countDistinct("h"), F.countDistinct("n")
    return reports.agg(F.count("*").alias("reports"), hashes.alias("hashes"), counts.alias("counts"), ((hashes == 1) & (counts == 1)).alias("consistent"))


@query(
    """WITH u AS (SELECT l_partkey, min(CAST(l_shipdate AS VARCHAR)[1:10]) AS first_release, max(CAST(l_shipdate AS VARCHAR)[1:10]) AS latest FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT p_partkey, p_brand, first_release, latest, coalesce(latest, '') <> '' AND latest <> '2001-06-01' AS update_available, CASE WHEN latest IS NULL THEN 'not found' END AS error FROM part LEFT JOIN u ON p_partkey = l_partkey"""
)
def catalog_lookup(spark, d):
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    releases = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.min(day).alias("first_release"), F.max(day).alias("latest"))
    rows = table(spark, d, "part").join(releases, F.col("p_partkey") == F.col("l_partkey"), "left")
    fresh = (F.coalesce("latest", F.lit("")) != "") & (F.col("latest") != "2001-06-01")
    return rows.select("p_partkey", "p_brand", "first_release", "latest", fresh.alias("update_available"), F.when(F.col("latest").isNull(), "not found").alias("error"))


@query(
    """SELECT count(*) > 0 AS not_empty, count(*) FILTER (WHERE s_name IS NULL OR s_nationkey IS NULL) AS lacking, count(*) - count(DISTINCT s_suppkey) AS repeated_ids,
  count(*) FILTER (WHERE NOT starts_with(s_name, 'Supplier#')) AS bad_prefix, count(*) FILTER (WHERE n_nationkey IS NULL) AS unknown_nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"""
)
def catalog_integrity(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.agg(
        (F.count("*") > 0).alias("not_empty"), F.count_if(F.col("s_name").isNull() | F.col("s_nationkey").isNull()).alias("lacking"), (F.count("*") - F.countDistinct("s_suppkey")).alias("repeated_ids"),
        F.count_if(~F.startswith("s_name", F.lit("Supplier#"))).alias("bad_prefix"), F.count_if(F.col("n_nationkey").isNull()).alias("unknown_nation"),
    )


#: endpoint rows of the manifest in rank order, the measurement null where the window is not filled
ENDPOINTS = f"""{ARTICLES}, {manifest_sql('articles')}, ranked AS (SELECT m.idx, year, month, CAST(rank AS INTEGER) AS rank, CASE WHEN n_chars >= 1000 THEN ln(CAST(n_chars AS DOUBLE)) END AS value FROM manifest m WHERE year IN (2022, 2026)),
matches AS (SELECT a.month, a.rank, a.idx AS idx_left, b.idx AS idx_right FROM ranked a JOIN ranked b USING (month, rank) WHERE a.year = 2022 AND a.value IS NULL AND b.year = 2026 AND b.value IS NOT NULL)"""


def endpoints(spark, d):
    value = F.when(F.col("n_chars") >= 1000, F.log(F.col("n_chars").cast("double")))
    return manifest(article_index(spark, d)).filter(F.col("year").isin(2022, 2026)).select("idx", "year", "month", "rank", value.alias("value"))


@query(f"WITH {ENDPOINTS} SELECT * FROM matches")
def matched_counterpart(spark, d):
    return pr.counterpart(endpoints(spark, d), ["month", "rank"], "year", "value", 2022, 2026)


PAIR_COMPLETE = f"""{ENDPOINTS}, complete AS (SELECT * FROM ranked WHERE value IS NOT NULL AND idx NOT IN (SELECT idx_right FROM matches))"""


def pair_complete(spark, d):
    rows = endpoints(spark, d)
    gone = pr.counterpart(rows, ["month", "rank"], "year", "value", 2022, 2026)
    gone = gone.select(F.explode(F.array("idx_left", "idx_right")).alias("gone"))
    return rows.join(gone, F.col("idx") == F.col("gone"), "left_anti").filter("value IS NOT NULL")


@query(f"WITH {PAIR_COMPLETE} SELECT idx, year, month, rank, round(value, 6) AS value FROM complete")
def pair_complete_anti(spark, d):
    return pair_complete(spark, d).withColumn("value", F.round("value", 6))


@query(
    """SELECT l_linestatus AS medium, l_returnflag AS label, count(*) AS n, round(avg(l_quantity), 6) AS mean, 'never pooled' AS pooling FROM lineitem GROUP BY 1, 2"""
)
def cross_cohort_summary(spark, d):
    rows = table(spark, d, "lineitem")

    def cohort(medium: str):
        return rows.filter(F.col("l_linestatus") == medium).groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean")).withColumn("medium", F.lit(medium))

    return cohort("O").unionByName(cohort("F")).withColumn("pooling", F.lit("never pooled"))


@query(
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(median(date_diff('second', o_orderdate, TIMESTAMP '2026-08-20 00:00:00') / 86400.0), 4) AS median_age_days,
  round(min(date_diff('second', o_orderdate, TIMESTAMP '2026-08-20 00:00:00') / 86400.0), 4) AS least_age_days FROM orders GROUP BY 1"""
)
def exposure_age(spark, d):
    seconds = F.unix_timestamp(F.lit("2026-08-20 00:00:00")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), (seconds / F.lit(86400.0)).alias("age"))
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.round(F.median("age"), 4).alias("median_age_days"), F.round(F.min("age"), 4).alias("least_age_days"))


