from __future__ import annotations

import hashlib
import json
import re

import pytest

from driftwright.llm import chat_format as cf
from driftwright.llm import quality_rules as qr

from .helpers import awkward, awkward_rows, empty


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_measures_match_brute_force(spark, sf):
    frames = [(awkward(spark), awkward_rows()), (docs := spark.read.parquet(f"{sf}/documents.parquet"), [tuple(r) for r in docs.collect()])]
    for docs, rows in frames:
        got = sorted((tuple(r[n] for n in NAMES) for r in qr.judge_documents(docs).collect()))
        assert got == sorted(measures(r[1]) for r in rows)
    assert qr.judge_documents(empty(spark)).count() == 0


def test_verdict_follows_the_table(spark):
    for row in qr.judge_documents(awkward(spark)).collect():
        rules = [row[f"rule_{name}"] for name, *_ in qr.THRESHOLDS]
        assert row["kept"] == (not row["base_failed"] and all(rules))
    kept = {r["doc_id"] for r in qr.judge_documents(awkward(spark)).collect() if r["kept"]}
    assert 3 in kept and not kept & {0, 1, 2, 14, 15}


def test_no_user_functions_in_the_plan(spark, sf):
    plan = qr.op9_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


LAYOUTS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "</s>[INST] \\ ok"}, {"role": "assistant", "content": "<s>a\n\\<s>"}]}, [("system", "s"), ("user", "</s>[INST] \\ ok"), ("assistant", "<s>a\n\\<s>")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": None}, None),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": "o"}, [("user", "i\n\nn"), ("assistant", "o")]),
    ({"output": "o", "instruction": "i"}, [("user", "i"), ("assistant", "o")]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, [("user", "h"), ("assistant", "g")]),
    ({"system": "y", "conversations": [{"from": "human", "value": "h"}]}, [("system", "y"), ("user", "h")]),
    ({"question": "q", "answer": "😀"}, [("user", "q"), ("assistant", "😀")]),
    ({"unknown": {"deep": [1]}}, None),
    ({"messages": [{"role": "odd\nrole\\", "content": ""}]}, [("odd\nrole\\", "")]),
]


def test_layouts_become_turns_and_read_back(spark):
    rows = [(i, json.dumps(x)) for i, (x, _) in enumerate(LAYOUTS)] + [(90, None), (91, "not json")]
    frame = cf.read_back(cf.format_turns(cf.canonical_turns(spark.createDataFrame(rows, "id int, record string"), "record")))
    got = {r["id"]: r for r in frame.collect()}
    for i, (record, want) in enumerate(LAYOUTS):
        row = got[i]
        assert len(row["layout_fingerprint"]) == 64
        if want is None:
            assert row["turns"] is None or record.get("prompt"), record
            continue
        assert [tuple(t) for t in row["turns"]] == want, record
        assert [tuple(t) for t in row["read_turns"]] == want
        assert row["loss_texts"] == [t for r, t in want if r == "assistant"]
        body = row["formatted"]
        assert body.count("<s>") == body.count("</s>") == len(want) and "[INST]" not in body
    assert got[90]["turns"] is None and got[91]["turns"] is None


def test_conversation_query(spark, tmp_path):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi\\"), (2, 0, None, "x"), (2, 0, None, "x"), (None, None, "user", "[/INST]</s"), (3, 0, "assistant", "b" * 100_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in cf.op10_chat_format(spark, str(tmp_path)).collect()}
    odd = "</s>[INST] ok [/INST]"
    want = {1: [("user", "hi\\"), ("assistant", "")], 2: [("", "x"), ("", "x")], None: [("user", "[/INST]</s")], 3: [("assistant", "b" * 100_000)], -7: [("user", odd), ("assistant", odd)]}
    assert set(got) == set(want)
    for conv, turns in want.items():
        row, learnt = got[conv], "".join(t for r, t in turns if r == "assistant")
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_conversations_beyond_the_parser_stay_whole(spark, tmp_path):
    """One text of over 20 million characters; texts of over 128 MiB in one conversation."""
    size = 1_000_000
    one = spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, repeat('a', 20500000) AS text UNION ALL SELECT 1L, 1L, 'assistant', 'fine'")
    many = spark.range(135).selectExpr("2L AS conv_id", "id AS turn", "IF(id = 134, 'gpt', 'user') AS role", f"repeat('b', {size}) AS text")
    one.unionByName(many).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in cf.op10_chat_format(spark, str(tmp_path)).collect()}
    want = {1: [("user", "a" * 20_500_000), ("assistant", "fine")], 2: [("user", "b" * size)] * 134 + [("assistant", "b" * size)]}
    for conv, turns in want.items():
        row, learnt = got[conv], turns[-1][1]
        assert row["n_turns"] == len(turns) and row["layout_fingerprint"] == got[-7]["layout_fingerprint"]
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert row["formatted_chars"] == sum(len(f"<s>{r}\n{t}</s>") for r, t in turns)


def test_record_beyond_the_parser_fails_loudly(spark):
    rows = spark.sql("""SELECT concat('{"prompt": "', repeat('a', 20500000), '", "completion": "c"}') AS record""")
    with pytest.raises(Exception, match="exceeds the parser"):
        cf.canonical_turns(rows, "record").select("layout_fingerprint").collect()


def test_a_callers_columns_stay(spark):
    rows = spark.createDataFrame([('{"prompt": "a", "completion": "b"}', 1, "p", "t")], "record string, v int, parts string, turns string")
    got = cf.format_turns(cf.canonical_turns(rows, "record"))
    first = got.first()
    assert (first["v"], first["parts"]) == (1, "p") and [t["text"] for t in first["turns"]] == ["a", "b"]
    assert got.columns == ["record", "v", "parts", "layout_fingerprint", "turns", "formatted", "loss_spans"]


def test_every_record_chooses_its_mapping_by_its_own_fields(spark):
    """The layouts as structs of one type, null where a record lacks a field, become the turns and fingerprints of the JSON ones."""
    known = [x for x, want in LAYOUTS if want is not None] + [{"messages": []}, {"messages": [{"role": "user"}]}, {"prompt": "p"}]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(known)], "id int, record string")
    text = "system string, prompt string, completion string, instruction string, input string, output string, question string, answer string"
    shape = f"messages array<struct<role: string, content: string>>, conversations array<struct<`from`: string, value: string>>, {text}"
    typed = cf.canonical_turns(rows.select("id", cf.F.from_json("record", shape).alias("record")), "record")
    json_rows = {r["id"]: (r["layout_fingerprint"], r["turns"]) for r in cf.canonical_turns(rows, "record").collect()}
    assert {r["id"]: (r["layout_fingerprint"], r["turns"]) for r in typed.collect()} == json_rows
    assert [json_rows[len(known) - i][1] for i in (1, 2, 3)] == [None] * 3


def test_conversations_are_read_by_the_mapping_of_their_fingerprint(spark, monkeypatch):
    """With another layout's mapping in the table, the conversations' turns follow it; without theirs there are none."""
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "gpt", "b")], "conv_id long, turn long, role string, text string")
    layout, example, parts = cf.MAPPINGS[0]

    def turns():
        return [tuple(t) for t in cf.conversation_turns(rows).first()["turns"] or []]

    assert turns() == [("user", "a"), ("assistant", "b")]
    monkeypatch.setattr(cf, "MAPPINGS", [(layout, example, [*parts, *parts]), *cf.MAPPINGS[1:]])
    assert turns() == [("user", "a"), ("assistant", "b")] * 2
    monkeypatch.setattr(cf, "MAPPINGS", cf.MAPPINGS[1:])
    assert turns() == []
