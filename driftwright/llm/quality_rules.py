"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return. The
measures of a text are array and string functions over it, each linear or n log n in its length, so a
long text needs no other path. ``THRESHOLDS`` names measures with the least and the greatest value
allowed; ``compile_rules`` turns it into columns, one per rule, and the verdict. A null text counts as
empty, without words; repeated rows are judged each; an empty table gives no rows. Ratios of a text
without words (or letters, or lines) are 0. The share of stop words counts one more than there are, so that a
text too short to be sure of one is not judged by it; stutter is the share of words that equal the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Common function words of the corpus languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were "
    "le la les un une des du de et en que qui dans pour pas sur par est au avec il elle se ce plus "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus "
    "el los las y una por con para su al lo como más pero sus"
).split()

#: rule, measure, least, greatest
THRESHOLDS = [
    ("word_length", "mean_word_chars", 2.0, 20.0),
    ("symbols", "symbols_per_word", None, 0.1),
    ("stop_words", "stop_word_share", 0.02, None),
    ("repeated_lines", "duplicate_line_share", None, 0.35),
    ("repeated_words", "repeated_word_share", None, 0.2),
    ("stutter", "stutter_share", None, 0.2),
    ("capitals", "capital_share", None, 0.5),
]


def _measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base counts of every text. Each step's columns feed the next one's, so nothing is evaluated twice."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(F.col("text"), F.lit(BLANKS))
    stop = [form for word in STOP_WORDS for form in (word, word.capitalize(), word.upper())]
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumns(
        {
            "words": F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")),
            "lines": F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""),
            "word_chars": F.length(F.translate("text", BLANKS, "")).cast("long"),
            "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
            "capitals": F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}", "")),
            "letters": F.length("text") - F.length(F.regexp_replace("text", r"\p{L}", "")),
        }
    )
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_stop": F.size(F.filter("words", lambda word: word.isin(stop))),
            "hashes": F.transform("words", lambda word: F.xxhash64(word)),
        }
    )
    window = F.transform(
        F.sequence(F.lit(0), F.size("hashes") - WINDOW),
        lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]),
    )
    rows = rows.withColumn("n_stutter", F.size(F.filter("hashes", lambda h, i: h == F.get("hashes", i - 1))))
    rows = rows.drop("text", "words", "lines").withColumn("windows", F.when(F.size("hashes") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    return rows.withColumn("n_repeat_words", repeated_cover(rows_windows="windows"))


def repeated_cover(rows_windows: str, width: int = WINDOW) -> Column:
    """Words covered by windows whose hash occurs twice or more: sort (hash, position), keep equal neighbours,
    sort their positions back and add what each window covers beyond the one before it."""
    ranked = f"array_sort(transform({rows_windows}, (h, p) -> struct(h, p)))"
    repeats = (
        "transform(filter(transform(sequence(0, size(r) - 1), i -> struct(r[i].p AS p, r[i].h = get(r, i - 1).h OR r[i].h = get(r, i + 1).h AS twice)), "
        "x -> x.twice), x -> x.p)"
    )
    cover = f"aggregate(array_sort({repeats}), struct(0L AS n, {-width} AS last), (a, p) -> struct(a.n + least({width}, p - a.last) AS n, p AS last), a -> a.n)"
    # a one-element transform binds the sorted array to a variable, so that it is sorted once
    bound = f"element_at(transform(array({ranked}), r -> {cover}), 1)"
    return F.expr(f"CASE WHEN size(array_distinct({rows_windows})) = size({rows_windows}) THEN 0L ELSE {bound} END")


def compile_rules(thresholds=THRESHOLDS) -> dict[str, Column]:
    """One boolean column per rule, true when the measure lies within its bounds."""
    rules = {}
    for name, measure, least, greatest in thresholds:
        checks = [F.col(measure) >= least] * (least is not None) + [F.col(measure) <= greatest] * (greatest is not None)
        rules[f"rule_{name}"] = checks[0] if len(checks) == 1 else checks[0] & checks[1]
    return rules


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Per row: id, base counts, ratios, the verdict of every rule, ``base_failed`` and ``kept``."""

    def ratio(part: str, whole: str) -> Column:
        return F.when(F.col(whole) == 0, 0.0).otherwise(F.col(part) / F.col(whole))

    rows = _measures(docs, id_col, text_col)
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbols_per_word"),
        F.when(F.col("n_words") == 0, 0.0).otherwise((F.col("n_stop") + 1) / F.col("n_words")).alias("stop_word_share"),
        ratio("n_dup_lines", "n_lines").alias("duplicate_line_share"),
        ratio("n_repeat_words", "n_words").alias("repeated_word_share"),
        ratio("n_stutter", "n_words").alias("stutter_share"),
        ratio("capitals", "letters").alias("capital_share"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )
    rules = compile_rules(thresholds)
    verdict = ~F.col("base_failed")
    for name in rules:
        verdict = verdict & F.col(name)
    return rows.withColumns(rules).withColumn("kept", verdict)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(read_table(spark, sf_dir, "documents"))
