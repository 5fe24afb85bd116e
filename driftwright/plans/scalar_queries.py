"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwright.functions import scalars as sc
from driftwright.functions import text as tx
from driftwright.functions.scalars import tidy
from driftwright.sources.sinks import public_columns

from .base import ARTICLES, CANDIDATES, MEASURED, article_index, articles, candidates, measured, query, table

URL_PARTS = r"""parts AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)"""


@query(f"WITH {ARTICLES} SELECT idx, sha256(body) AS body_sha256, CAST(length(body) AS BIGINT) AS chars FROM articles")
def normalize_text(spark, d):
    return articles(spark, d).select("idx", F.sha2("body", 256).alias("body_sha256"), F.length("body").cast("long").alias("chars"))


@query(f"WITH {MEASURED} SELECT idx, round(bigram, 6) + 0.0 AS bigram, round(trigram, 6) + 0.0 AS trigram FROM measured")
def char_ngram_entropy(spark, d):
    return measured(spark, d).select("idx", tidy(F.col("bigram")).alias("bigram"), tidy(F.col("trigram")).alias("trigram"))


@query(
    f"""WITH {MEASURED} SELECT idx, chars AS normalized_chars, CAST(1000 AS BIGINT) AS analyzed_chars, round(bigram, 6) + 0.0 AS bigram_entropy, round(power(2, bigram), 4) AS bigram_perplexity,
  bi_total AS bigram_total, bi_kinds AS bigram_distinct, round(trigram, 6) + 0.0 AS trigram_entropy, round(power(2, trigram), 4) AS trigram_perplexity, tri_total AS trigram_total, tri_kinds AS trigram_distinct FROM measured"""
)
def ngram_profile(spark, d):
    rows = measured(spark, d)
    parts = [F.col("idx"), F.col("chars").alias("normalized_chars"), F.least("chars", F.lit(tx.WINDOW)).cast("long").alias("analyzed_chars")]
    for name, stats, value in (("bigram", "bi", "bigram"), ("trigram", "tri", "trigram")):
        entropy = tx.finite(F.col(value))
        parts += [tidy(entropy).alias(f"{name}_entropy"), F.round(F.pow(F.lit(2.0), entropy), 4).alias(f"{name}_perplexity"), F.col(f"{stats}_total").alias(f"{name}_total"), F.col(f"{stats}_kinds").alias(f"{name}_distinct")]
    return rows.select(*parts)


@query(
    f"""WITH {ARTICLES} SELECT idx, year, month, sha256(author) AS author_sha256, sha256(url) AS url_sha256, sha256(body) AS body_sha256, sha256(substring(body, 1, 1000)) AS prefix_sha256,
  CAST(length(body) AS BIGINT) AS normalized_chars, CAST(least(length(body), 1000) AS BIGINT) AS measured_chars, false AS raw_html_persisted, false AS body_persisted FROM articles WHERE length(body) >= 1000"""
)
def measure_projection(spark, d):
    rows = articles(spark, d).filter(F.length("body") >= tx.WINDOW)
    return rows.select(
        "idx", "year", "month", F.sha2("author", 256).alias("author_sha256"), F.sha2("url", 256).alias("url_sha256"), F.sha2("body", 256).alias("body_sha256"),
        F.sha2(tx.window(F.col("body")), 256).alias("prefix_sha256"), F.length("body").cast("long").alias("normalized_chars"),
        F.length(tx.window(F.col("body"))).cast("long").alias("measured_chars"), F.lit(False).alias("raw_html_persisted"), F.lit(False).alias("body_persisted"),
    )


@query("SELECT doc_id, sha256(source) AS source_sha256, sha256(text) AS text_sha256 FROM documents")
def sha256_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("source", 256).alias("source_sha256"), F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS metadata_sha256 FROM events""")
def metadata_hash(spark, d):
    columns = sorted(["user_id", "event_id", "event_type"])
    return table(spark, d, "events").select("event_id", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("metadata_sha256"))


@query(
    f"""WITH {CANDIDATES}, p AS (SELECT idx, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM candidates)
SELECT idx, s[1] AS author, s[3] AS slug, sha256(s[1]) AS author_sha256 FROM p WHERE len(s) >= 3 AND s[2] = 'articles'"""
)
def url_author(spark, d):
    rows = candidates(spark, d).select("idx", sc.path_segments(sc.url_path(F.col("url"))).alias("s")).filter((F.size("s") >= 3) & (F.get("s", F.lit(1)) == "articles"))
    return rows.select("idx", F.get("s", F.lit(0)).alias("author"), F.get("s", F.lit(2)).alias("slug"), F.sha2(F.get("s", F.lit(0)), 256).alias("author_sha256"))


@query(
    rf"""WITH {CANDIDATES} SELECT idx, CAST(substr(published_at, 1, 4) AS INTEGER) AS year, CAST(substr(published_at, 6, 2) AS INTEGER) AS month,
  regexp_matches(published_at, '^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?(Z|[+-]\d{{2}}:\d{{2}})$') AND try_cast(substr(published_at, 1, 19) AS TIMESTAMP) IS NOT NULL AS is_valid,
  CAST(nullif(regexp_extract(published_at, '^(20\d{{2}})-\d{{2}}', 1), '') AS INTEGER) AS century_year FROM candidates"""
)
def published_fields(spark, d):
    at = F.col("published_at")
    return candidates(spark, d).select(
        "idx", sc.published_year(at).alias("year"), sc.published_month(at).alias("month"), sc.is_published_valid(at).alias("is_valid"),
        F.nullif(F.regexp_extract(at, r"^(20\d{2})-\d{2}", 1), F.lit("")).cast("int").alias("century_year"),
    )


@query(
    rf"""WITH {CANDIDATES} SELECT idx, CAST(nullif(regexp_extract(url || ' ' || published_at, '(20\d{{2}})', 1), '') AS INTEGER) AS any_year,
  CASE WHEN regexp_matches(substr(published_at, 1, 4), '^\d{{4}}$') THEN CAST(substr(published_at, 1, 4) AS INTEGER) END AS lead_year FROM candidates"""
)
def year_from_text(spark, d):
    text = F.concat("url", F.lit(" "), "published_at")
    return candidates(spark, d).select("idx", sc.first_year(text).alias("any_year"), sc.leading_year(F.col("published_at")).alias("lead_year"))


CATEGORIES = ["article", "book", "user", "publication", "scrap", "ring", "bolt", "widget"]


@query("SELECT category, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN contains(lower(p_name), '{c}') THEN '{c}'" for c in CATEGORIES) + " ELSE 'other' END AS category FROM part) GROUP BY category")
def url_category_hist(spark, d):
    return table(spark, d, "part").groupBy(sc.classify(F.col("p_name"), CATEGORIES).alias("category")).agg(F.count("*").alias("n"))


@query(
    """WITH o AS (SELECT l_orderkey, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS nl, min(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS vl,
  count(DISTINCT l_quantity) AS nn, min(l_quantity) AS vn FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN nl = 1 THEN CAST(vl AS BIGINT) WHEN nn = 1 THEN CAST(vn AS BIGINT) END AS shown FROM o"""
)
def unambiguous_value(spark, d):
    quantity = F.col("l_quantity").cast("long")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", quantity)).alias("labelled"), F.collect_set(quantity).alias("numeric"))
    return rows.select("l_orderkey", tx.unambiguous(F.lit(None).cast("long"), F.col("labelled"), F.col("numeric")).alias("shown"))


@query("SELECT l_returnflag, count(*) AS n, count(CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END) AS n_finite, round(avg(CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END), 4) AS mean FROM lineitem GROUP BY 1")
def finite_or_null(spark, d):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice") / F.when(F.col("l_discount") != 0, F.col("l_discount")))
    rows = table(spark, d, "lineitem").select("l_returnflag", tx.finite(ratio).alias("v"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("v").alias("n_finite"), F.round(F.avg("v"), 4).alias("mean"))


@query(
    """SELECT o_custkey, array_to_string(list_sort(list(o_orderkey) FILTER (WHERE r <= 10)), ',') AS first_ten, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1"""
)
def array_slice(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    return rows.select("o_custkey", F.array_join(F.transform(F.slice("keys", 1, 10), lambda k: k.cast("string")), ",").alias("first_ten"), F.size("keys").cast("long").alias("n"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(json_extract_string(props, '$.missing')) AS n_missing FROM events GROUP BY 1")
def json_props(spark, d):
    props = F.try_parse_json("props")
    rows = table(spark, d, "events").select("event_type", F.try_variant_get(props, "$.k", "bigint").alias("k"), F.try_variant_get(props, "$.missing", "string").alias("m"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.count("m").alias("n_missing"))


@query(None)
def html_unescape(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_unescape(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))


@query(None)
def html_body_text(spark, d):
    rows = table(spark, d, "pages").select("page_id", tx.html_body(tx.by_tag("article"))("html").alias("strict"), tx.html_body(tx.by_tag("article"), strict=False)("html").alias("aware"))
    return rows.select("page_id", F.length("strict.value").alias("strict_chars"), F.sha2("strict.value", 256).alias("strict_sha256"), F.length("aware.value").alias("aware_chars"), F.sha2("aware.value", 256).alias("aware_sha256"), F.col("strict.error").alias("error"))


@query(
    r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '<meta name="title" content="([^"]*)"', 1), ''), nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '')) AS title,
  nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang, nullif(regexp_extract(html, 'datetime="([^"]+)"', 1), '') AS published FROM pages"""
)
def first_match_metadata(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", sc.first_match(html, ['<meta name="title" content="([^"]*)"', "<title>([^<]*)</title>"]).alias("title"),
        sc.first_match(html, ['<html lang="([a-z]+)"']).alias("lang"), sc.first_match(html, ['datetime="([^"]+)"']).alias("published"),
    )


@query(rf"WITH {URL_PARTS} SELECT page_id, 'https://' || host || regexp_replace(path, '/+$', '') AS canonical FROM parts")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", sc.canonical_url(F.col("url")).alias("canonical"))


@query(rf"WITH {URL_PARTS} SELECT page_id, path FROM parts WHERE contains(path, '/en/') OR starts_with(path, '/fr/')")
def url_path_filter(spark, d):
    rows = table(spark, d, "pages").select("page_id", sc.url_path(F.col("url")).alias("path"))
    return rows.filter(F.contains("path", F.lit("/en/")) | F.startswith("path", F.lit("/fr/")))


@query(
    rf"""WITH {URL_PARTS} SELECT page_id, CASE WHEN NOT starts_with(url, 'https://') THEN 'scheme' WHEN NOT ends_with(host, '.example.com') THEN 'host'
  WHEN starts_with(path, '/api/') OR path = '/search' OR starts_with(path, '/search/') THEN 'disallowed_path' WHEN NOT contains(path, '/en/') THEN 'not_an_article' END AS refusal FROM parts"""
)
def url_policy_guard(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", sc.url_host(F.col("url")).alias("host"), sc.url_path(F.col("url")).alias("path"))
    refusal = sc.first_reason(
        [
            ("scheme", F.startswith("url", F.lit("https://"))),
            ("host", F.endswith("host", F.lit(".example.com"))),
            ("disallowed_path", ~(F.startswith("path", F.lit("/api/")) | (F.col("path") == "/search") | F.startswith("path", F.lit("/search/")))),
            ("not_an_article", F.contains("path", F.lit("/en/"))),
        ]
    )
    return rows.select("page_id", refusal.alias("refusal"))


REASONS = rf"""{CANDIDATES}, reasons AS (SELECT *, CASE WHEN article_type IS NULL OR letters IS NULL OR published_at IS NULL OR url IS NULL OR author IS NULL THEN 'missing'
  WHEN article_type <> 'tech' THEN 'not_tech' WHEN letters < 1500 THEN 'body_too_short'
  WHEN NOT regexp_matches(published_at, '^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?(Z|[+-]\d{{2}}:\d{{2}})$') THEN 'invalid_published_at'
  WHEN NOT (CAST(substr(published_at, 1, 4) AS INTEGER) BETWEEN 1996 AND 2000 AND CAST(substr(published_at, 6, 2) AS INTEGER) BETWEEN 1 AND 7) THEN 'outside_window'
  WHEN NOT starts_with(url, 'https://corpus.example/') THEN 'foreign_url' WHEN author = '' THEN 'missing_author' END AS reason FROM candidates)"""


def with_reasons(spark, d):
    at = F.col("published_at")
    present = F.col("article_type").isNotNull() & F.col("letters").isNotNull() & at.isNotNull() & F.col("url").isNotNull() & F.col("author").isNotNull()
    rules = [
        ("missing", present),
        ("not_tech", F.col("article_type") == "tech"),
        ("body_too_short", F.col("letters") >= 1500),
        ("invalid_published_at", sc.is_published_valid(at)),
        ("outside_window", sc.published_year(at).between(1996, 2000) & sc.published_month(at).between(1, 7)),
        ("foreign_url", F.startswith("url", F.lit("https://corpus.example/"))),
        ("missing_author", F.col("author") != ""),
    ]
    return candidates(spark, d).withColumn("reason", sc.first_reason(rules))


@query(f"WITH {REASONS} SELECT idx, reason, reason IS NULL AS eligible FROM reasons")
def eligibility_reasons(spark, d):
    return with_reasons(spark, d).select("idx", "reason", F.col("reason").isNull().alias("eligible"))


@query(f"WITH {REASONS} SELECT coalesce(reason, 'eligible') AS reason, count(*) AS n FROM reasons GROUP BY 1")
def rejection_histogram(spark, d):
    return with_reasons(spark, d).groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {CANDIDATES} SELECT idx FROM candidates WHERE article_type = 'tech' AND CAST(substr(published_at, 1, 4) AS INTEGER) IN (1995, 2001) AND CAST(substr(published_at, 6, 2) AS INTEGER) BETWEEN 1 AND 7 AND reactions >= 0 AND author <> '' AND url IS NOT NULL")
def eligible_conjunction(spark, d):
    at = F.col("published_at")
    keeps = (F.col("article_type") == "tech") & sc.published_year(at).isin(1995, 2001) & sc.published_month(at).between(1, 7) & (F.col("reactions") >= 0) & (F.col("author") != "") & F.col("url").isNotNull()
    return candidates(spark, d).filter(keeps).select("idx")


@query(
    """WITH y AS (SELECT o_custkey, list(DISTINCT year(o_orderdate)) AS years FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1)
SELECT o_orderkey, list_contains(years, year(o_orderdate)) AND month(o_orderdate) BETWEEN 1 AND 7 AS in_window FROM orders JOIN y USING (o_custkey)"""
)
def same_window(spark, d):
    orders = table(spark, d, "orders")
    years = orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_custkey").agg(F.collect_set(F.year("o_orderdate")).alias("years"))
    rows = orders.join(years, "o_custkey")
    return rows.select("o_orderkey", (F.array_contains("years", F.year("o_orderdate")) & F.month("o_orderdate").between(1, 7)).alias("in_window"))


@query("SELECT event_id, CAST(200 + (user_id % 5) * 51 + (event_id % 3) * 3 AS INTEGER) AS status, 200 + (user_id % 5) * 51 + (event_id % 3) * 3 IN (404, 410) AS gone FROM events")
def status_class(spark, d):
    status = (F.lit(200) + (F.col("user_id") % 5) * 51 + (F.col("event_id") % 3) * 3).cast("int")
    return table(spark, d, "events").select("event_id", status.alias("status"), F.coalesce(status.isin(404, 410), F.lit(False)).alias("gone"))


@query(f"WITH {CANDIDATES} SELECT outcome, count(*) AS n, min(idx) AS first_idx FROM (SELECT idx, CASE WHEN regexp_matches(published_at, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN 'ok' ELSE 'no offset' END AS outcome FROM candidates) GROUP BY 1")
def error_split(spark, d):
    checked = candidates(spark, d).select("idx", F.when(sc.is_published_valid(F.col("published_at")), F.struct(F.col("published_at").alias("value"), F.lit(None).cast("string").alias("error"))).otherwise(F.struct(F.lit(None).cast("string").alias("value"), F.lit("no offset").alias("error"))).alias("r"))
    return checked.groupBy(F.coalesce("r.error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


@query(f"WITH {ARTICLES} SELECT idx, CASE WHEN length(body) >= 1000 THEN 'measured' ELSE 'insufficient_length' END AS status, CASE WHEN length(body) >= 1000 THEN sha256(substring(body, 1, 1000)) END AS prefix_sha256 FROM articles")
def length_gate_retain(spark, d):
    enough = F.col("m.chars") >= tx.WINDOW
    rows = article_index(spark, d, tx.normalized_window(F.col("text")).alias("m"))
    return rows.select("idx", F.when(enough, "measured").otherwise("insufficient_length").alias("status"), F.when(enough, F.sha2("m.window", 256)).alias("prefix_sha256"))


@query(f"WITH {ARTICLES} SELECT idx, CAST(length(body) AS BIGINT) AS chars FROM articles WHERE length(body) >= 1000")
def length_gate_strict(spark, d):
    return article_index(spark, d, tx.normalized_length("text").alias("chars")).filter(F.col("chars") >= tx.WINDOW).select("idx", "chars")


@query("SELECT doc_id AS idx, source FROM documents ORDER BY doc_id LIMIT 50")
def manifest_limit(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("idx"), "source").orderBy("idx").limit(50)


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def public_projection(spark, d):
    return public_columns(table(spark, d, "documents"))


@query(f"WITH {CANDIDATES} SELECT substr(published_at, 1, 7) AS year_month, count(*) AS n FROM candidates GROUP BY 1")
def year_month_hist(spark, d):
    return candidates(spark, d).groupBy(F.substring("published_at", 1, 7).alias("year_month")).agg(F.count("*").alias("n"))


@query(None)
def compact_variant(spark, d):
    value = F.try_parse_json("props")
    kind = F.schema_of_variant(value)
    is_object = F.startswith(kind, F.lit("OBJECT"))
    names = F.array_sort(F.json_object_keys("props"))
    return table(spark, d, "events").select(
        "event_id", F.when(is_object, "object").otherwise(F.lower(kind)).alias("kind"), F.when(is_object, F.size(names)).alias("n_features"),
        F.when(is_object, F.array_join(F.slice(names, 1, 20), ",")).alias("names"), F.when(~is_object, F.try_variant_get(value, "$", "string")).alias("scalar"),
    )
