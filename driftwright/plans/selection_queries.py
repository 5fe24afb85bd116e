"""Samples, ranks, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwright.functions import scalars as sc
from driftwright.functions.scalars import tidy
from driftwright.operators import selection as sel

from .base import ARTICLES, CANDIDATES, MONTHS, TARGET, YEARS, article_index, candidates, manifest, manifest_sql, query, table
from .scalar_queries import REASONS, with_reasons

STRATA = f"""strata AS (SELECT *, CAST(substr(published_at, 1, 4) AS INTEGER) AS year, CAST(substr(published_at, 6, 2) AS INTEGER) AS month FROM reasons WHERE reason IS NULL),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year, month, author ORDER BY sha256(url), url) AS ar FROM strata) WHERE ar = 1),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY sha256(url), url) AS rank FROM capped) WHERE rank <= {TARGET})"""


def eligible(spark, d):
    at = F.col("published_at")
    return with_reasons(spark, d).filter(F.col("reason").isNull()).withColumns({"year": sc.published_year(at), "month": sc.published_month(at)})


@query(f"WITH {REASONS}, {STRATA} SELECT year, month, CAST(rank AS INTEGER) AS rank, idx, url, author FROM chosen")
def stratified_capped_topk(spark, d):
    rows = sel.capped_sample(eligible(spark, d), ["year", "month"], "author", "url", TARGET)
    return rows.select("year", "month", "rank", "idx", "url", "author")


MATCHED = f"""{CANDIDATES}, m AS (SELECT *, CAST(substr(published_at, 1, 4) AS INTEGER) AS year, CAST(substr(published_at, 6, 2) AS INTEGER) AS month FROM candidates
  WHERE author <> '' AND CAST(substr(published_at, 1, 4) AS INTEGER) IN (1995, 2001) AND CAST(substr(published_at, 6, 2) AS INTEGER) BETWEEN 1 AND 7),
k AS (SELECT month, CAST(least(ceil(count(*) FILTER (WHERE year = 1995) / 4), ceil(count(*) FILTER (WHERE year = 2001) / 4)) AS INTEGER) AS matched FROM m GROUP BY 1),
picked AS (SELECT * FROM (SELECT m.*, matched, row_number() OVER (PARTITION BY m.month, year ORDER BY reactions DESC, sha256(url), url) AS rank FROM m JOIN k USING (month)) WHERE rank <= matched)"""


def matched(spark, d):
    at = F.col("published_at")
    rows = candidates(spark, d).withColumns({"year": sc.published_year(at), "month": sc.published_month(at)})
    rows = rows.filter((F.col("author") != "") & F.col("year").isin(1995, 2001) & F.col("month").between(1, 7))
    return sel.matched_quartile(rows, "month", "year", (1995, 2001), "reactions", "url")


@query(f"WITH {MATCHED} SELECT month, year, CAST(rank AS INTEGER) AS rank, matched, idx, reactions FROM picked")
def matched_upper_quartile(spark, d):
    return matched(spark, d).select("month", "year", "rank", "matched", "idx", "reactions")


@query(f"WITH {MATCHED} SELECT month, year, count(*) AS n, min(reactions) AS least, max(reactions) AS most FROM picked GROUP BY 1, 2")
def selected_range(spark, d):
    return matched(spark, d).groupBy("month", "year").agg(F.count("*").alias("n"), F.min("reactions").alias("least"), F.max("reactions").alias("most"))


@query(f"WITH {MATCHED} SELECT year, max(n) AS most FROM (SELECT year, author, count(*) AS n FROM picked GROUP BY 1, 2) GROUP BY 1")
def max_per_author_year(spark, d):
    return matched(spark, d).groupBy("year", "author").agg(F.count("*").alias("n")).groupBy("year").agg(F.max("n").alias("most"))


@query("SELECT flag_status, p, CAST(r AS INTEGER) AS rank FROM (SELECT l_returnflag || l_linestatus AS flag_status, l_partkey AS p, row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY sha256(CAST(l_partkey AS VARCHAR)), CAST(l_partkey AS VARCHAR)) AS r FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_partkey FROM lineitem)) WHERE r <= 144")
def per_group_hash_sample(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("flag_status"), F.col("l_partkey").alias("p")).distinct().withColumn("k", F.col("p").cast("string"))
    return sel.top_per_group(rows, ["flag_status"], sel.hash_order("k"), 144).select("flag_status", "p", "rank")


@query("SELECT event_type, user_id, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedup_keep_last(spark, d):
    rows = table(spark, d, "events").withColumn("key", F.concat_ws("/", "event_type", "user_id"))
    return sel.keep_last(rows, "key", [F.desc("event_id")]).select("event_type", "user_id", "event_id")


@query(
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS user_turn FROM conversations"""
)
def scoped_last_value(spark, d):
    rows = sel.carry_forward(table(spark, d, "conversations"), ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "user_turn")
    return rows.select("conv_id", "turn", "user_turn")


@query("SELECT url FROM (SELECT DISTINCT url FROM pages) ORDER BY sha256(url), url LIMIT 60")
def hash_topk_sample(spark, d):
    return table(spark, d, "pages").select("url").distinct().orderBy(*sel.hash_order("url")).limit(60)


@query("SELECT sha256(string_agg(url, chr(10) ORDER BY sha256(url), url)) AS set_sha256, count(*) AS n FROM (SELECT DISTINCT url FROM pages ORDER BY sha256(url), url LIMIT 60)")
def sample_set_hash(spark, d):
    rows = hash_topk_sample(spark, d).withColumn("h", F.sha2("url", 256))
    ordered = F.array_sort(F.collect_list(F.struct("h", "url")))
    return rows.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["url"]), "\n"), 256).alias("set_sha256"), F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT l_returnflag AS feature, avg(CASE WHEN year(l_shipdate) < 1998 THEN l_extendedprice END) AS a, avg(CASE WHEN year(l_shipdate) >= 1998 THEN l_extendedprice END) AS b, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1)
SELECT feature, round(abs((b - a) / s), 6) + 0.0 AS abs_d, CAST(row_number() OVER (ORDER BY abs((b - a) / s) DESC, feature) AS INTEGER) AS rank FROM s WHERE feature <> 'N' AND s > 0"""
)
def effect_ranking(spark, d):
    from pyspark.sql import Window

    early = F.year("l_shipdate") < 1998
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("feature")).agg(F.avg(F.when(early, F.col("l_extendedprice"))).alias("a"), F.avg(F.when(~early, F.col("l_extendedprice"))).alias("b"), F.stddev_samp("l_extendedprice").alias("s"))
    rows = rows.filter((F.col("feature") != "N") & (F.col("s") > 0)).withColumn("d", F.abs((F.col("b") - F.col("a")) / F.col("s")))
    return rows.select("feature", tidy(F.col("d")).alias("abs_d"), F.row_number().over(Window.orderBy(F.desc("d"), "feature")).alias("rank"))


@query("(SELECT c_custkey, 'head' AS part FROM customer ORDER BY c_custkey LIMIT 5) UNION ALL (SELECT c_custkey, 'tail' AS part FROM customer ORDER BY c_custkey DESC LIMIT 5)")
def head_tail(spark, d):
    return sel.head_tail(table(spark, d, "customer").select("c_custkey"), "c_custkey", 5)


@query("SELECT l_partkey AS key FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size > 40")
def set_union(spark, d):
    a = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("key"))
    return a.union(table(spark, d, "part").filter("p_size > 40").select("p_partkey")).distinct()


@query("SELECT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def set_difference(spark, d):
    gone = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select("l_partkey")
    return table(spark, d, "part").select(F.col("p_partkey").alias("key")).distinct().join(gone, F.col("key") == F.col("l_partkey"), "left_anti")


@query("SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT DISTINCT unnest(json_keys(props)) AS feature FROM events")
def feature_name_union(spark, d):
    return table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("feature")).distinct()


@query("SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2001")
def author_overlap(spark, d):
    rows = table(spark, d, "orders")

    def year(y: int):
        return rows.filter((F.col("o_orderdate") >= F.lit(f"{y}-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz"))).select("o_custkey")

    return year(1995).intersect(year(2001))


GRID = f"grid AS (SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month FROM unnest(range({YEARS[0]}, {YEARS[-1] + 1})) a(y), unnest(range(1, 8)) b(m))"


def grid(spark):
    return spark.createDataFrame([(y, m) for y in YEARS for m in MONTHS], "year int, month int")


@query(f"WITH {ARTICLES}, {GRID}, c AS (SELECT year, month, count(*) AS n, count(DISTINCT author) AS authors FROM articles WHERE medium <> 'en' GROUP BY 1, 2) SELECT grid.year, grid.month, coalesce(n, 0) AS n, coalesce(authors, 0) AS authors FROM grid LEFT JOIN c USING (year, month)")
def stratum_grid(spark, d):
    counts = article_index(spark, d).filter("medium <> 'en'").groupBy("year", "month").agg(F.count("*").alias("n"), F.countDistinct("author").alias("authors"))
    return grid(spark).join(counts, ["year", "month"], "left").na.fill(0)


@query(
    f"""WITH {ARTICLES}, {manifest_sql('articles')}, {GRID}, e AS (SELECT year, month, count(*) AS eligible FROM articles GROUP BY 1, 2), s AS (SELECT year, month, count(*) AS selected FROM manifest GROUP BY 1, 2)
SELECT grid.year, grid.month, coalesce(eligible, 0) AS eligible, coalesce(selected, 0) AS selected, {TARGET} - coalesce(selected, 0) AS shortfall FROM grid LEFT JOIN e USING (year, month) LEFT JOIN s USING (year, month)"""
)
def stratum_shortfall(spark, d):
    rows = article_index(spark, d)
    counted = rows.groupBy("year", "month").agg(F.count("*").alias("eligible"))
    chosen = manifest(rows).groupBy("year", "month").agg(F.count("*").alias("selected"))
    out = grid(spark).join(counted, ["year", "month"], "left").join(chosen, ["year", "month"], "left").na.fill(0)
    return out.withColumn("shortfall", F.lit(TARGET) - F.col("selected"))


@query("SELECT l_partkey AS key, array_to_string(list_sort(list(DISTINCT year(l_shipdate))), ',') AS years FROM lineitem GROUP BY 1")
def candidate_years(spark, d):
    years = F.array_sort(F.collect_set(F.year("l_shipdate")))
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.array_join(F.transform(years, lambda y: y.cast("string")), ",").alias("years"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS groups FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def cross_group_members(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("groups")).filter("groups > 1")


@query(
    """SELECT year, o_orderkey, CAST(r AS INTEGER) AS rank FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey,
  row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY abs(date_diff('second', make_timestamp(year(o_orderdate), 8, 1, 12, 0, 0), o_orderdate)), o_orderkey) AS r FROM orders
  WHERE abs(date_diff('second', make_timestamp(year(o_orderdate), 8, 1, 12, 0, 0), o_orderdate)) <= 604800) WHERE r <= 12"""
)
def nearest_to_anchor(spark, d):
    seconds = F.abs(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) - F.unix_timestamp(F.make_timestamp(F.year("o_orderdate"), F.lit(8), F.lit(1), F.lit(12), F.lit(0), F.lit(0))))
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", seconds.alias("away")).filter("away <= 604800")
    return sel.top_per_group(rows, ["year"], ["away", "o_orderkey"], 12).select("year", "o_orderkey", "rank")
