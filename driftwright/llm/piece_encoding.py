"""SentencePiece encoding that keeps offsets, and decoding.

The normaliser walks the model's compiled character map (a double-array trie followed by replacement
strings) and takes the longest prefix that the map knows at every step, noting for each byte it emits the
source byte it came from. Pieces tile the normalised bytes, so their running lengths looked up in that
alignment give each piece's byte span in the original text. The library segments; this module normalises,
aligns, checks that the pieces tile the normalised text, and decodes.

A null text counts as empty: no piece, only the end id. Repeated rows are encoded each; an empty table
gives an empty result. Very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
SPACE_BYTES = SPACE.encode()


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialized protocol message, in order."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        width = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + width]
        at += width


class CharacterMap:
    """Longest-prefix lookup in a compiled map; an empty one knows no prefix."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :] if blob else b""

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """(source bytes taken, replacement) of the longest known prefix at ``start``."""
        units = self.units
        if not units:
            return None
        node, best = self._jump(units[0]), None
        for at in range(start, len(data)):
            node ^= data[at]
            if node >= len(units) or units[node] & 0x800000FF != data[at]:
                break
            unit = units[node]
            node ^= self._jump(unit)
            if unit & 0x100:
                best = at + 1 - start, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.strings[best[1] : self.strings.index(0, best[1])]


class PieceModel:
    """A model file: its normaliser with alignment, and the library's segmenter and decoder."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as file:
            data = file.read()
        spec = dict(v for f, s in wire_fields(data) if f == 3 for v in wire_fields(s))
        trainer = dict(v for f, s in wire_fields(data) if f == 2 for v in wire_fields(s))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.suffix = bool(trainer.get(24, 0))
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.eos = self.library.eos_id()
        size = self.library.get_piece_size()
        self.lengths = np.array([1 if self.library.is_byte(i) else 0 if self.library.is_control(i) else len(self.library.id_to_piece(i).encode()) for i in range(size)], dtype=np.int64)
        self.unknown = self.library.unk_id()

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and one past the end) the source byte it starts from."""
        source = text.encode()
        if not source:
            return b"", np.zeros(1, dtype=np.int64)
        if not self.map.units and not self.squeeze and self.escape and not self.suffix:
            return self._normalise_spaces(source)
        return self._normalise_mapped(source)

    def _normalise_spaces(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """With an empty map only spaces change: three bytes for each, all from one source byte."""
        raw = np.frombuffer(source, dtype=np.uint8)
        width = np.where(raw == 32, 3, 1)
        origin = np.repeat(np.arange(len(raw), dtype=np.int64), width)
        lead = SPACE_BYTES if self.dummy_prefix else b""
        return lead + source.replace(b" ", SPACE_BYTES), np.concatenate([np.zeros(len(lead), dtype=np.int64), origin, [len(raw)]])

    def _normalise_mapped(self, source: bytes) -> tuple[bytes, np.ndarray]:
        out, origin, at, spaced = bytearray(), [], 0, self.squeeze
        space = SPACE_BYTES if self.escape else b" "

        def step(at: int) -> tuple[int, bytes]:
            found = self.map.longest(source, at)
            if found:
                return found
            first = source[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            return width, source[at : at + width]

        while self.squeeze and at < len(source):
            taken, piece = step(at)
            if piece != b" ":
                break
            at += taken
        if at == len(source):
            return b"", np.zeros(1, dtype=np.int64)

        def emit(piece: bytes, start: int) -> None:
            out.extend(piece)
            origin.extend([start] * len(piece))

        if self.dummy_prefix and not self.suffix:
            emit(space, at)
        while at < len(source):
            taken, piece = step(at)
            while spaced and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                emit(piece.replace(b" ", space), at)
                spaced = piece.endswith(b" ")
            at += taken
            spaced = spaced and self.squeeze
        while self.squeeze and out.endswith(space):
            at = origin[-len(space)]
            del out[-len(space) :], origin[-len(space) :]
        if self.dummy_prefix and self.suffix:
            emit(space, at)
        origin.append(at)
        return bytes(out), np.array(origin, dtype=np.int64)

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids with the end id, and the source byte span of every piece (the end id's span is empty)."""
        ids = self.library.encode(text, add_eos=True)
        normal, origin = self.normalise(text)
        array = np.array(ids[:-1], dtype=np.int64)
        lengths = self.lengths[array]
        if (array == self.unknown).any():
            lengths = np.array([len(p.encode()) for p in self.library.encode(text, out_type=str)], dtype=np.int64)
        ends = np.cumsum(lengths)
        if (ends[-1] if len(ends) else 0) != len(normal):
            raise ValueError("the pieces do not tile the normalised text")
        starts = origin[ends - lengths]
        stops = origin[ends]
        last = len(text.encode())
        return ids, np.append(starts, last), np.append(stops, last)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


SPANS = "struct<ids: array<int>, starts: array<long>, ends: array<long>>"
DIGEST = "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string, spans_sha256: string, source_bytes: long>"


def _encoded(path: str, batch: pd.Series) -> Iterator[tuple[PieceModel, list[int], np.ndarray, np.ndarray]]:
    model = piece_model(path)
    for text in batch:
        yield model, *model.encode(text or "")


def encode_spans(text: Column, path: str | None = None) -> Column:
    """Struct column: ids and the byte span in the original text of every piece."""
    path = path or public_tokenizers.path(MODEL)

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(ids, starts, ends) for _, ids, starts, ends in _encoded(path, batch)]
            yield pd.DataFrame(rows, columns=["ids", "starts", "ends"])

    return spans(text)


def decode_ids(ids: Column, path: str | None = None) -> Column:
    """String column of the decoded ids; null for null."""
    path = path or public_tokenizers.path(MODEL)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else piece_model(path).decode([int(i) for i in x]))

    return decoded(ids)


def encode_digests(text: Column, path: str | None = None) -> Column:
    """The same encoding reduced in the worker to counts and digests of ids, decoded text and spans."""
    path = path or public_tokenizers.path(MODEL)

    @F.pandas_udf(DIGEST)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def sha(data: bytes) -> str:
            return hashlib.sha256(data).hexdigest()

        for batch in batches:
            rows = []
            for model, ids, starts, ends in _encoded(path, batch):
                spans = np.column_stack([starts, ends]).astype("<i8").tobytes()
                rows.append((len(ids), sha(" ".join(map(str, ids)).encode()), sha(model.decode(ids).encode()), sha(spans), int(ends[-1])))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "source_bytes"])

    return digests(text)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per document: id and the digests of its encoding and decoding."""
    return docs.select(F.col(id_col).alias("doc_id"), encode_digests(F.col(text_col), path).alias("d")).select("doc_id", "d.*")


def op2_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))
