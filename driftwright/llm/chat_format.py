"""Chat formatting: schema fingerprints choose declarative mappings into canonical turns.

A record is a JSON object. Its fingerprint is the SHA-256 of its nested field paths (names, nesting and
which fields are lists; scalar types are left out). ``MAPPINGS`` lists the known layouts: an example
record, from which the fingerprint is derived, and the places of its turns, read from a parsed record or
from a struct into canonical turns ``array<struct<role, text>>``. A record of an unknown layout gets null turns and its
fingerprint, so that it can be counted and mapped.

The template writes ``<s>role\\ntext</s>`` per turn. Inside roles and texts a backslash is doubled and one is
set after the first character of every control string; a newline in a role gets one before it. Dropping the
backslashes that escape restores the text, so reading back is exact. Loss spans are the code point ranges
of the assistants' (escaped) texts in the output.

Records are JSON or structs; in a struct the fields that are null in a record do not belong to it, so one type can hold
many layouts. Rows of (conv_id, turn, role, text) become structs of messages and never pass a JSON parser: each record's own
fields give its fingerprint, and the mapping found by that reads the turns. JSON records do pass one, which takes strings
of up to 20 million characters and variants of up to 128 MiB; a longer record that it refuses fails the query instead of
giving null turns.

Nulls: a null text or role is empty; turns without a position come first. Turns of equal position run by
role, then text; repeated rows stay repeated turns. An empty table gives no records. Everything is built-in
functions. A conversation is one value of the result, so its rows meet in one group by definition.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .common import read_table

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
OPEN, CLOSE = "<s>", "</s>"
PARSER_CHARS = 20_000_000
TURN = "struct<role: string, text: string>"

# Role names of common layouts.
ROLES = {"human": "user", "gpt": "assistant", "chatgpt": "assistant", "bard": "assistant", "bing": "assistant", "prompter": "user"}


def _turn(role: str, *fields: str) -> tuple:
    """One turn of a fixed role; the texts of several fields are joined by an empty line, empty ones left out."""
    return "turn", role, fields


def _list(field: str, role: str, text: str) -> tuple:
    """A turn for every element of a list."""
    return "list", field, role, text


#: layout, example record, where its turns are
MAPPINGS = [
    ("messages", {"messages": [{"role": "", "content": ""}]}, [_list("messages", "role", "content")]),
    ("conversations", {"conversations": [{"from": "", "value": ""}]}, [_list("conversations", "from", "value")]),
    ("system_conversations", {"system": "", "conversations": [{"from": "", "value": ""}]}, [_turn("system", "system"), _list("conversations", "from", "value")]),
    ("prompt_completion", {"prompt": "", "completion": ""}, [_turn("user", "prompt"), _turn("assistant", "completion")]),
    ("prompt_response", {"prompt": "", "response": ""}, [_turn("user", "prompt"), _turn("assistant", "response")]),
    ("question_answer", {"question": "", "answer": ""}, [_turn("user", "question"), _turn("assistant", "answer")]),
    ("instruction_output", {"instruction": "", "output": ""}, [_turn("user", "instruction"), _turn("assistant", "output")]),
    ("instruction_input_output", {"instruction": "", "input": "", "output": ""}, [_turn("user", "instruction", "input"), _turn("assistant", "output")]),
]


def _turns_at(parts: list[tuple], record: Column, typed: bool) -> Column:
    """The turns that a mapping finds in a record, a parsed one or a struct."""

    def get(value: Column, field: str, kind: str = "string") -> Column:
        return value[field].cast(kind) if typed else F.variant_get(value, f"$.{field}", kind)

    def listed(field: str, role: str, text: str) -> Column:
        if typed:  # zipped, not transformed: that would copy every text
            return F.arrays_zip(record[field][role].cast("array<string>").alias("role"), record[field][text].cast("array<string>").alias("text"))
        return F.transform(get(record, field, "array<variant>"), lambda t: F.struct(get(t, role).alias("role"), get(t, text).alias("text")))

    def single(role: str, fields: tuple) -> Column:
        texts = [get(record, f) for f in fields]
        text = texts[0] if len(texts) == 1 else F.concat_ws("\n\n", *[F.nullif(t, F.lit("")) for t in texts])
        return F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))

    found = [(listed if kind == "list" else single)(*where).cast(f"array<{TURN}>") for kind, *where in parts]
    return found[0] if len(found) == 1 else F.concat(*found)


def field_paths(value) -> str:
    """The nested field paths of an example record, written as the fingerprint reads them."""
    if isinstance(value, dict):
        return "OBJECT<" + ", ".join(f"{k}: {field_paths(value[k])}" for k in sorted(value)) + ">"
    if isinstance(value, list):
        return f"ARRAY<{field_paths(value[0]) if value else '_'}>"
    return "_"


def fingerprint_of(example: dict) -> str:
    return hashlib.sha256(field_paths(example).encode()).hexdigest()


def fingerprint(record: Column) -> Column:
    """The same over a parsed record: scalar types in the variant's schema give way to one mark."""
    schema = F.schema_of_variant(record)
    return F.sha2(F.regexp_replace(schema, r"(?<=[:<] ?)(?!OBJECT<|ARRAY<)[A-Z]+(\([^)]*\))?(?=[,>]|$)", "_"), 256)


def typed_paths(values: Column, kind: DataType) -> Column:
    """The nested field paths of an array of values of a Spark type, as ``field_paths`` writes them.

    A field belongs to a record if a value of it there is not null; what the elements of a list hold is put together.
    Nothing here copies a text.
    """
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        held = [F.when(F.exists(values[f.name], lambda x: x.isNotNull()), F.concat(F.lit(f"{f.name}: "), typed_paths(values[f.name], f.dataType))) for f in fields]
        found = F.concat(F.lit("OBJECT<"), F.concat_ws(", ", *held), F.lit(">"))
    elif isinstance(kind, ArrayType):
        found = F.concat(F.lit("ARRAY<"), typed_paths(F.flatten(F.filter(values, lambda x: x.isNotNull())), kind.elementType), F.lit(">"))
    elif isinstance(kind, MapType):
        raise TypeError("a map has no field names; give records as structs or JSON")
    else:
        return F.lit("_")
    return F.when(F.exists(values, lambda x: x.isNotNull()), found).otherwise("_")


def _may_hold(kind: DataType, example) -> bool:
    """Whether records of a Spark type can have an example's layout."""
    if isinstance(example, dict):
        return isinstance(kind, StructType) and all(k in kind.names and _may_hold(kind[k].dataType, v) for k, v in example.items())
    if isinstance(example, list):
        return isinstance(kind, ArrayType) and _may_hold(kind.elementType, example[0])
    return not isinstance(kind, StructType | ArrayType | MapType)


def canonical_roles(turns: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.transform(
        turns,
        lambda t: F.struct(F.coalesce(F.try_element_at(names, t["role"]), t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")),
    )


def canonical_turns(records: DataFrame, record_col: str) -> DataFrame:
    """Add ``layout_fingerprint`` and ``turns`` to rows with a record, JSON or a struct (null record or layout: null turns).

    A JSON record of over ``PARSER_CHARS`` characters that cannot be parsed is an error: it may only be too large.
    """
    kind = records.schema[record_col].dataType
    if isinstance(kind, StructType):
        rows, v, known = records, F.col(record_col), [m for m in MAPPINGS if _may_hold(kind, m[1])]
        found, kept = F.when(v.isNotNull(), F.sha2(typed_paths(F.array(v), kind), 256)), F.col
    else:
        refused = f"raise_error(concat('a record of ', length({record_col}), ' characters is no JSON or exceeds the parser (strings of {PARSER_CHARS} characters, 128 MiB in all)'))"
        rows = records.select(F.struct("*").alias("row"), F.expr(f"coalesce(try_parse_json({record_col}), CASE WHEN length({record_col}) > {PARSER_CHARS} THEN cast({refused} AS variant) END)").alias("v"))
        rows, v, known = rows.withColumn("layout_fingerprint", fingerprint(F.col("v"))), F.col("v"), MAPPINGS
        found, kept = F.col("layout_fingerprint"), F.col("row").getField
    turns = F.lit(None).cast(f"array<{TURN}>")
    for _, example, parts in known:
        turns = F.when(found == fingerprint_of(example), _turns_at(parts, v, rows is records)).otherwise(turns)
    made = {"layout_fingerprint": found, "turns": canonical_roles(turns)}
    return rows.select(*[kept(c).alias(c) for c in records.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(rows: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` (start and end code point of every assistant text); other columns stay."""
    parts = F.transform(
        F.col(turns_col),
        lambda t: F.struct(
            (t["role"] == "assistant").alias("learn"),
            F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    name = "parts"
    while name in rows.columns:
        name += "_"
    walk = (
        f"aggregate({name}, named_struct('at', 0, 'spans', cast(array() AS array<struct<start: int, end: int>>)), (a, p) -> named_struct("
        f"'at', a.at + length(p.head) + length(p.body) + {len(CLOSE)}, "
        "'spans', IF(p.learn, array_append(a.spans, named_struct('start', a.at + length(p.head), 'end', a.at + length(p.head) + length(p.body))), a.spans)), a -> a.spans)"
    )
    return rows.withColumn(name, parts).withColumns(
        {
            "formatted": F.array_join(F.transform(name, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""),
            "loss_spans": F.expr(walk),
        }
    ).drop(name)


def read_back(rows: DataFrame) -> DataFrame:
    """Add ``read_turns`` and ``loss_texts`` recovered from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.split("formatted", CLOSE)
    whole = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    role = r"(?s)^<s>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"

    def turn(piece: Column) -> Column:
        head = F.regexp_extract(piece, role, 1)
        return F.struct(unescape(head).alias("role"), unescape(F.substr(piece, F.length(head) + len(OPEN) + 2)).alias("text"))

    return rows.withColumns(
        {
            "read_turns": F.transform(whole, turn),
            "loss_texts": F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))),
        }
    )


def conversation_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, layout_fingerprint, turns) of rows of (conv_id, turn, role, text), each conversation a record of messages.

    The record is a struct, so that ``canonical_turns`` fingerprints and maps it without a parser, however long its texts are.
    """
    text = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(text)).alias("m"))
    messages = F.arrays_zip(F.col("m.role").alias("role"), F.col("m.content").alias("content"))
    return canonical_turns(grouped.select("conv_id", F.struct(messages.alias("messages")).alias("record")), "record").drop("record")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = read_back(format_turns(conversation_turns(rows.unionByName(odd))))
    learnt = F.array_join("loss_texts", "")
    return rows.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout_fingerprint",
    )
