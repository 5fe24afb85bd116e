"""Mixing sources to target weights by hierarchical budgeting, on built-in functions only.

Documents are leaves' supply in a tree of levels (domain, language, source). The token budget runs down
from the root. At every node it is shared among the children in proportion to their weights, and no child gets
more than its capacity (its supply times ``max_epochs``): what a short child cannot use goes to its
siblings first, and a node passes up only what all its children together cannot use, since its own capacity is
the sum of theirs. A leaf then gives whole epochs and the longest prefix of one more, in the order of a
seeded hash of epoch and id, whose tokens stay within the rest.

The prefix of a leaf is found from token sums of 4,096 hash ranges, then of as many within the range that holds the cut; only
the documents of the last one, one in 16 million of the leaf's, are put in order. What comes back is one hash threshold a leaf, so documents are neither sorted nor moved to be
selected.

Tokens are words (runs of anything but ASCII blanks); null and empty texts have none and cost nothing. A null
level value is a branch named ``(none)``. Rows of one id in a leaf are taken or left together, as are rows
without id. Weights that are not listed are 1; a weight of 0 or less gives a branch nothing. An empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

LEVELS = ("domain", "lang", "source")
WEIGHTS = {"domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0}, "lang": {"en": 3.0}, "source": {}}
SEED, MAX_EPOCHS = "2024", 4
DIGITS = (3, 6)


def tree_levels() -> dict[str, Column]:
    """Domains group sources by their number; languages and sources are columns of documents."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"(\d{1,9})", 1)
    return {
        "domain": F.when(number == "", F.lit("(none)")).otherwise(F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string"))),
        "lang": F.coalesce(F.col("lang"), F.lit("(none)")),
        "source": F.coalesce(F.col("source"), F.lit("(none)")),
    }


def word_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order_hash(seed: str, epoch: Column, doc_id: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("(none)"))), 256)


def _weight(level: str, weights: dict) -> Column:
    found = F.lit(1.0)
    for value, weight in weights.get(level, {}).items():
        found = F.when(F.col(level) == value, F.lit(float(weight))).otherwise(found)
    return found


def _share_out(nodes: DataFrame, parent: list[str], level: str, weights: dict) -> DataFrame:
    """Water-filling of ``budget`` among the children of every parent: those whose capacity lies below their share of
    what is left, in ascending order of capacity per weight, are filled; the others split the rest by weight."""
    nodes = nodes.withColumn("w", _weight(level, weights)).filter("w > 0")
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity") / F.col("w"), level)
    nodes = nodes.withColumns(
        {
            "taken": F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "left": F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    nodes = nodes.withColumn("height", (F.col("budget") - F.col("taken")) / F.col("left"))
    nodes = nodes.withColumn("full", F.col("capacity") <= F.col("w") * F.col("height"))
    nodes = nodes.withColumn("even", F.max(F.when(~F.col("full"), F.col("height"))).over(by))
    nodes = nodes.withColumn("budget", F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(F.col("w") * F.col("even")))
    return nodes.drop("w", "taken", "left", "height", "full", "even")


def budget_tree(supply: DataFrame, budget_share: float, weights: dict, max_epochs: int, levels=LEVELS) -> DataFrame:
    """Per leaf of (levels, supply): ``alloc`` tokens of a budget that is a share of all supply."""
    levels = list(levels)
    budget = (supply.agg(F.sum("supply")).first()[0] or 0) * budget_share  # one number
    above = None
    for depth, level in enumerate(levels):
        keys, parent = levels[: depth + 1], levels[:depth]
        nodes = supply.groupBy(*keys).agg((F.sum("supply") * max_epochs).alias("capacity"))
        nodes = nodes.withColumn("budget", F.lit(float(budget))) if above is None else nodes.join(above, parent)
        above = _share_out(nodes, parent, level, weights).select(*keys, "budget")
    return above.withColumn("alloc", F.floor("budget").cast("long")).drop("budget")


def mixing_plan(docs: DataFrame, budget_share: float = 1.0, weights: dict | None = None, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Per leaf: supply, alloc, whole epochs and the greatest hash of the last epoch's prefix (null: none)."""
    weights = WEIGHTS if weights is None else weights
    levels = list(LEVELS)
    narrow = materialise(docs.select("doc_id", *[c.alias(n) for n, c in tree_levels().items()], word_tokens(F.col("text")).alias("tokens")), "tokens")
    supply = materialise(narrow.groupBy(*levels).agg(F.sum("tokens").alias("supply")), "supply")
    leaves = supply.join(budget_tree(supply, budget_share, weights, max_epochs), levels)
    leaves = leaves.withColumn("epochs", F.when(F.col("supply") > 0, F.expr("alloc div supply")).otherwise(F.when(F.col("alloc").isNotNull(), F.lit(1))).cast("long"))
    leaves = materialise(leaves.withColumn("rest", F.col("alloc") - F.col("epochs") * F.col("supply")), "leaves")

    rows = narrow.join(leaves.filter("rest > 0").select(*levels, "epochs", "rest", F.lit(0).cast("long").alias("before")), levels)
    rows = rows.withColumn("hash", order_hash(seed, F.col("epochs") + 1, F.col("doc_id"))).select(*levels, "rest", "before", "hash", "tokens")
    through, marks = Window.partitionBy(*levels).orderBy("range"), []
    for digits in DIGITS:  # sums of hash ranges, then of the ranges within the one that holds the cut
        ranges = rows.groupBy(*levels, "rest", "before", F.substr("hash", F.lit(1), F.lit(digits)).alias("range")).agg(F.sum("tokens").alias("sum"))
        ranges = materialise(ranges.withColumn("through", F.col("before") + F.sum("sum").over(through)), "ranges")
        marks.append(ranges.filter("through <= rest").groupBy(*levels).agg(F.concat(F.max("range"), F.lit("g")).alias("mark")))
        cut = ranges.filter("through > rest").groupBy(*levels).agg(F.min(F.struct("range", (F.col("through") - F.col("sum")).alias("upto"))).alias("cut"))
        cut = cut.select(*levels, "cut.*")
        rows = rows.join(cut, levels).filter(F.col("hash").startswith(F.col("range")))
        rows = materialise(rows.select(*levels, "rest", F.col("upto").alias("before"), "hash", "tokens"), "cut")
    at_cut = Window.partitionBy(*levels).orderBy("hash").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("through", F.col("before") + F.sum("tokens").over(at_cut)).filter("through <= rest")
    marks.append(rows.groupBy(*levels).agg(F.max("hash").alias("mark")))
    marks = reduce(DataFrame.unionByName, marks).groupBy(*levels).agg(F.max("mark").alias("last_hash"))  # of a longer prefix the later
    return materialise(leaves.join(marks, levels, "left").select(*levels, "supply", "alloc", "epochs", "last_hash"), "plan")


def copies_column(seed: str = SEED) -> Column:
    hashed = order_hash(seed, F.col("epochs") + 1, F.col("doc_id"))
    return F.col("epochs") + F.coalesce((hashed <= F.col("last_hash")).cast("long"), F.lit(0))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per selected row: doc_id, its leaf, tokens, and how often the mixture repeats it."""
    plan = mixing_plan(docs, **options)
    rows = docs.select("doc_id", *[c.alias(n) for n, c in tree_levels().items()], word_tokens(F.col("text")).alias("tokens"))
    rows = rows.join(plan.select(*LEVELS, "epochs", "last_hash"), list(LEVELS))
    return rows.select("doc_id", *LEVELS, "tokens", copies_column(options.get("seed", SEED)).alias("copies")).filter("copies > 0")


def select_mixture(docs: DataFrame, **options) -> DataFrame:
    """The selected rows with all their columns, each once for every copy."""
    plan = mixing_plan(docs, **options)
    plan = plan.select(*[F.col(n).alias(f"leaf_{n}") for n in LEVELS], "epochs", "last_hash")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", *[c.alias(f"its_{n}") for n, c in tree_levels().items()])
    on = [F.col(f"its_{n}") == F.col(f"leaf_{n}") for n in LEVELS]
    rows = rows.join(plan, on[0] & on[1] & on[2]).withColumn("copies", copies_column(options.get("seed", SEED))).filter("copies > 0")
    if options.get("max_epochs", MAX_EPOCHS) == 1:
        return rows.select("row.*")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def _sql_level(level: str, parent: list[str], above: str) -> str:
    keys = ", ".join([*parent, level])
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    weight = "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in WEIGHTS[level].items()) + " ELSE 1.0 END" if WEIGHTS[level] else "1.0"
    join = f"JOIN {above} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above}"
    return f"""
a_{level} AS (SELECT {keys}, CAST(sum(supply) * {MAX_EPOCHS} AS BIGINT) AS capacity, CAST({weight} AS DOUBLE) AS w FROM supply GROUP BY {keys}),
b_{level} AS (SELECT a.*, budget, coalesce(sum(capacity) OVER ({part} ORDER BY capacity / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
  sum(w) OVER ({part} ORDER BY capacity / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM a_{level} a {join}),
c_{level} AS (SELECT *, (budget - taken) / rest_w AS height FROM b_{level}),
d_{level} AS (SELECT *, max(CASE WHEN capacity > w * height THEN height END) OVER ({part}) AS even FROM c_{level}),
n_{level} AS (SELECT {keys}, CASE WHEN capacity <= w * height THEN CAST(capacity AS DOUBLE) ELSE w * even END AS budget FROM d_{level}),"""


ORACLE = (
    r"""WITH docs AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})', 1) = '' THEN '(none)'
    ELSE 'domain' || CAST(CAST(regexp_extract(source, '([0-9]{1,9})', 1) AS INTEGER) % 4 AS VARCHAR) END AS domain,
  coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
supply AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply FROM docs GROUP BY ALL),
root AS (SELECT CAST(sum(supply) AS DOUBLE) AS budget FROM supply),"""
    + _sql_level("domain", [], "root")
    + _sql_level("lang", ["domain"], "n_domain")
    + _sql_level("source", ["domain", "lang"], "n_lang")
    + f"""
leaves AS (SELECT *, CASE WHEN supply > 0 THEN CAST(floor(budget) AS BIGINT) // supply ELSE 1 END AS epochs, CAST(floor(budget) AS BIGINT) AS alloc FROM supply JOIN n_source USING (domain, lang, source)),
hashed AS (SELECT *, sha256('{SEED}:' || CAST(epochs + 1 AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '(none)')) AS h FROM docs JOIN leaves USING (domain, lang, source)),
cut AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS through FROM hashed)
SELECT doc_id, domain, lang, source, tokens, CAST(epochs + CASE WHEN alloc > epochs * supply AND through <= alloc - epochs * supply THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM cut WHERE epochs + CASE WHEN alloc > epochs * supply AND through <= alloc - epochs * supply THEN 1 ELSE 0 END > 0"""
)
