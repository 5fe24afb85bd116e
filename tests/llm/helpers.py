"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing extra columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, words int"


def awkward_rows():
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [
        "", None, "one", "the cat sat on the mat and the dog lay by the door of the house", " \t\x0b\x0c\r\n ", "  lead  and trail  ",
        "a b c d e f a b c d e f", "x x x x x x x x x x x x", "same line of text here\nsame line of text here\n\n \nother", long,
        "naïve café — 数学 😀 \x00 end", "ﬁne　print ①", "</s> [INST] \\ back", "l▁m <0x41> <s>", "# $ % & | < > *" * 4,
        "EVERY WORD SHOUTS THE SAME WAY AND THE REST DOES TOO", "tail\r\ntail\r\n",
    ]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}", None, 0.5, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here", None, None, 1, None, None, None), (500, texts[3], "fr", None, 3, 0.1, "y", 2)]
    return rows


def awkward(spark, partitions: int = 3):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
