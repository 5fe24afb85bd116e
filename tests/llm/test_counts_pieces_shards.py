from __future__ import annotations

import hashlib
import random
import time
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from driftwright.llm import piece_encoding as pe
from driftwright.llm import sharding, token_counts

from .helpers import awkward, awkward_rows, empty


def test_context_table_matches_brute_force(spark):
    encode = token_counts._encoding(public_tokenizers.path(token_counts.RANKS), public_tokenizers.PATTERN).encode_ordinary
    lengths = sorted(len(encode(r[1] or "")) for r in awkward_rows())
    table = token_counts.context_table(token_counts.length_histogram(awkward(spark)))
    got = {r["length"]: r for r in table.collect()}
    assert set(got) == set(lengths)
    for limit, row in got.items():
        assert row["docs"] == lengths.count(limit)
        assert row["docs_at_least"] == sum(x >= limit for x in lengths)
        assert row["tokens_at_least"] == sum(x for x in lengths if x >= limit)
        assert row["tokens_truncated"] == sum(min(x, limit) for x in lengths)
        assert row["padding"] == sum(max(limit - x, 0) for x in lengths)
        assert row["tokens_total"] == sum(lengths)
    assert token_counts.quantile(table, 0.5) == lengths[(len(lengths) + 1) // 2 - 1]
    assert token_counts.context_table(token_counts.length_histogram(empty(spark))).count() == 0


def test_encoding_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pe.MODEL))
    want = {}
    for row in awkward_rows():
        ids = library.encode(row[1] or "", add_eos=True)
        want[row[0]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = pe.encode_documents(awkward(spark)).collect()
    assert len(got) == len(awkward_rows())
    for row in got:
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == want[row["doc_id"]]
    assert pe.encode_documents(empty(spark)).count() == 0


def test_spans_cover_the_source_and_decode_round_trips(spark):
    rows = awkward(spark).select("doc_id", "text", pe.encode_spans(F.col("text")).alias("e")).withColumn("back", pe.decode_ids(F.col("e.ids"))).collect()
    model = pe.piece_model(public_tokenizers.path(pe.MODEL))
    for row in rows:
        source = (row["text"] or "").encode()
        spans = list(zip(row["e"]["starts"], row["e"]["ends"], strict=True))
        assert spans[-1] == (len(source), len(source))
        at = 0
        for start, end in spans:
            assert start == at or start < at == end or start <= at
            at = max(at, end)
        assert at == len(source)
        for i, (start, end) in zip(row["e"]["ids"][:-1], spans, strict=False):
            piece = model.library.id_to_piece(i).encode()
            if not model.library.is_byte(i):
                assert source[start:end] in (piece.replace(pe.SPACE_BYTES, b" "), piece.replace(pe.SPACE_BYTES, b" ")[1:], piece)
        if row["text"] and pe.SPACE not in row["text"]:
            assert row["back"] == row["text"]


def test_mapped_normaliser_equals_the_library():
    import sentencepiece

    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = dict(pe.wire_fields(dict(pe.wire_fields(rule.serialized_model_proto()))[3]))
    model = pe.PieceModel.__new__(pe.PieceModel)
    model.map, model.dummy_prefix, model.squeeze, model.escape, model.suffix = pe.CharacterMap(spec[2]), False, False, False, False
    for text in ["ﬁ ｱﾊﾟ  x", "Ａ①㌔ ｶﾞ", "é ȫ", "plain", "  　\t\x07z", "数学😀 ½"]:
        out, origin = model._normalise_mapped(text.encode())
        want, offsets = rule.Normalize(text, with_offsets=True)
        squeezed = " ".join(out.decode().split(" ")).strip()
        assert " ".join(squeezed.split()) == " ".join(want.replace(pe.SPACE, " ").split())
        assert len(origin) == len(out) + 1 and origin[-1] == len(text.encode()) and list(origin) == sorted(origin)
    model.squeeze = model.escape = model.dummy_prefix = True
    for text in ["  a  ｂ  ", "ﬁ ｱﾊﾟ  x", "   ", "　é", "x"]:
        out, origin = model._normalise_mapped(text.encode())
        rule_text = rule.Normalize(text)
        assert out.decode() == (pe.SPACE + rule_text.lstrip(pe.SPACE) if rule_text.strip(pe.SPACE) else "")
        assert len(origin) == len(out) + 1


@pytest.mark.parametrize("shards", [16, 3])
def test_shards_are_contiguous_balanced_and_gapless(spark, shards):
    rows = sharding.shard_by_bytes(awkward(spark), n_shards=shards).collect()
    assert len(rows) == len(awkward_rows())
    want = sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in awkward_rows())
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    ordered = sorted(rows, key=lambda r: r["offset"])
    assert [r["doc_id"] for r in ordered] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x or 0))
    total, at = sum(r["size"] for r in rows), 0
    for row in ordered:
        assert row["offset"] == at and row["shard"] == min(shards - 1, (2 * at + row["size"]) * shards // (2 * total))
        at += row["size"]
    for shard in {r["shard"] for r in rows}:
        assert [r["slot"] for r in ordered if r["shard"] == shard] == list(range(sum(r["shard"] == shard for r in rows)))
    assert sharding.shard_by_bytes(empty(spark)).count() == 0


def test_shard_query_is_balanced(spark, sf):
    rows = sharding.op5_sharding(spark, sf).groupBy("shard").agg(F.sum("size").alias("b"), F.max("size").alias("m")).collect()
    mean = sum(r["b"] for r in rows) / 16
    assert len(rows) == 16 and all(abs(r["b"] - mean) <= 2 * max(x["m"] for x in rows) for r in rows)


def test_blocks_by_binary_search(spark):
    from driftwright.llm.common import LEAST, block_of, cut_points

    draw = random.Random(4)
    keys = [draw.randrange(-50, 50) for _ in range(300)] + [None]
    cuts = sorted({(draw.randrange(-60, 60), LEAST if i % 2 else draw.randrange(100)) for i in range(37)})
    rows = spark.createDataFrame([(k, draw.randrange(100)) for k in keys], "k long, w long")
    for r in rows.select("*", block_of("k", cuts, "w").alias("b"), block_of("k", [(c, LEAST) for c in range(-40, 40, 3)]).alias("c"), block_of("k", []).alias("none")).collect():
        assert r["none"] == 0 and r["b"] == (0 if r["k"] is None else sum(c <= (r["k"], r["w"]) for c in cuts))
        assert r["c"] == (0 if r["k"] is None else sum(c <= r["k"] for c in range(-40, 40, 3)))
    # a value of two thirds of the rows is cut by the second column, and 20,000 cuts are planned and searched at once
    hot = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), (F.col("id") * 37 % 3000).alias("w"))
    found = hot.groupBy(block_of("k", cut_points(hot, "k", 12, "w"), "w").alias("b")).count().collect()
    assert len(found) >= 10 and max(r["count"] for r in found) < 600
    began = time.monotonic()
    many = spark.range(0, 200_000, 7).select("id", block_of("id", [(10 * i, LEAST) for i in range(1, 20_000)]).alias("b"))
    assert many.filter("b <> id div 10").count() == 0
    assert time.monotonic() - began < 20


@pytest.mark.parametrize("partitions", [1, 5])
def test_many_rows_of_one_id_are_sharded_in_order(spark, partitions):
    draw = random.Random(partitions)
    rows = [(draw.choice([None, None, 5, 5, 5, i]), "x" * draw.randrange(40)) for i in range(400)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).orderBy("offset").collect()
    want = sorted(((i is not None, i or 0, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows))
    assert [(r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got] == want
    sizes = [w[2] for w in want]
    assert [r["offset"] for r in got] == [sum(sizes[:i]) for i in range(len(sizes))]
