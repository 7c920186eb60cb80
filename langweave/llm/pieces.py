"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

White space is marked: a text gets a leading marker and its spaces become markers. The best segmentation maximises the
sum of piece scores; of equal sums the one whose last piece is longest wins, as forward search finds it first. A
character that no piece covers is encoded as its UTF-8 bytes, by the byte pieces. Decoding reverses all that.

No piece of the vocabularies used has a marker after another character, so a text's best segmentation is that of its
chunks (markers and what follows them) one by one; chunks recur, and a worker keeps the encodings of those it met. A
vocabulary with such a piece is encoded in whole texts instead.

The pieces of a model file and their scores are read, never trained; the trie (bounded by the vocabulary) is broadcast.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from langweave.llm.batches import text_rows
from langweave.llm.columns import whole

MARKER = "▁"
# How far below the lowest score an uncovered character lies.
UNKNOWN_PENALTY = 10.0
# A Python worker keeps encoded chunks up to so many bytes, then starts anew, and none longer than so many characters.
KEPT_BYTES = 180 << 20
KEPT_LENGTH = 64
# What an entry takes besides the bytes of chunk and ids.
ENTRY_BYTES = 200


class DoubleArray:
    """A trie over bytes in two arrays: the child of state ``s`` by byte ``b`` is ``t = base[s] + b + 1`` if
    ``check[t] == s``; ``value[s]`` is the id of the piece that ends there, or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: dict[bytes, list[int]] = {}
        for key in keys:
            for at in range(len(key)):
                below = children.setdefault(key[:at], [])
                if key[at] not in below:
                    below.append(key[at])
        size = 1 << 10
        self.base, self.check, self.value = array("i", [0] * size), array("i", [-1] * size), array("i", [-1] * size)
        self.check[0] = 0
        states = {b"": 0}
        # An only child takes the first free slot; for several, the search goes on near the last place found, which
        # leaves some holes to only children and never rescans the full part. The first slots are the root's.
        free, roomy = 257, 0
        # Shorter prefixes first, so that a state exists before its children.
        for prefix in sorted(children, key=lambda p: (len(p), p)):
            own, state = sorted(children[prefix]), states[prefix]
            while free < len(self.check) and self.check[free] != -1:
                free += 1
            base, tries = free - own[0] - 1, 0
            if len(own) > 1:
                base = max(base, roomy) if prefix else 0
            while True:
                while base + own[-1] + 1 >= len(self.check):
                    self.base.extend([0] * len(self.base))
                    self.check.extend([-1] * len(self.check))
                    self.value.extend([-1] * len(self.value))
                if all(self.check[base + b + 1] == -1 for b in own):
                    break
                base, tries = base + 1, tries + 1
            if len(own) > 1 and tries > 64:
                roomy = base
            self.base[state] = base
            for b in own:
                child = base + b + 1
                self.check[child] = state
                states[prefix + bytes([b])] = child
        for key, number in keys.items():
            self.value[states[key]] = number
        # So that no byte leads out of the arrays.
        room = max(self.base) + 257 - len(self.check)
        for cells, empty in ((self.base, 0), (self.check, -1), (self.value, -1)):
            cells.extend([empty] * max(room, 0))


@dataclass
class PieceModel:
    """A vocabulary: pieces as written, their scores, and which of them are ordinary or stand for a byte."""

    pieces: list[str]
    scores: list[float]
    ordinary: list[int]
    byte_ids: list[int]  # by byte value; empty without byte fallback
    unknown_id: int

    @classmethod
    def from_file(cls, path: str) -> PieceModel:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        special = [i for i in every if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        by_byte = {model.id_to_piece(i): i for i in every if model.is_byte(i)}
        return cls(
            [model.id_to_piece(i) for i in every],
            [model.get_score(i) for i in every],
            sorted(set(every).difference(special, by_byte.values())),
            [by_byte[f"<0x{b:02X}>"] for b in range(256)] if len(by_byte) == 256 else [],
            model.unk_id(),
        )


class PieceCodec:
    """Encodes and decodes texts with a ``PieceModel``."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.trie = DoubleArray({model.pieces[i].encode(): i for i in model.ordinary})
        # Lists are read faster than arrays here.
        self.base, self.check, self.value = (list(a) for a in (self.trie.base, self.trie.check, self.trie.value))
        self.unknown_score = min((model.scores[i] for i in model.ordinary), default=0.0) - UNKNOWN_PENALTY
        written = [model.pieces[i] for i in model.ordinary]
        self.chunked = not any(re.search(f"[^{MARKER}]{MARKER}", p) for p in written)
        # A line feed that no piece holds stands alone as well.
        alone = "" if any("\n" in p for p in written) else "\n"
        self.chunk = re.compile(f"{alone}|{MARKER}*[^{MARKER}{alone}]+|{MARKER}+" if alone else f"{MARKER}*[^{MARKER}]+|{MARKER}+")
        self.dtype = np.dtype("<u2" if len(model.pieces) <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.size = 0
        self.byte_of = {i: bytes([b]) for b, i in enumerate(model.byte_ids)}
        self.written = [self.byte_of.get(i, p.encode()) for i, p in enumerate(model.pieces)]
        for i in set(range(len(model.pieces))).difference(model.ordinary, self.byte_of):
            self.written[i] = " ⁇ ".encode() if i == model.unknown_id else b""
        self.written_array = np.array(self.written, object)

    def segment(self, chunk: bytes) -> list[int]:
        """Viterbi search over the chunk's UTF-8 bytes."""
        base, check, value, scores = self.base, self.check, self.value, self.model.scores
        size = len(chunk)
        best: list[float | None] = [None] * (size + 1)
        came: list[tuple[int, int]] = [(0, -1)] * (size + 1)
        best[0] = 0.0
        at = 0
        while at < size:
            first = chunk[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            so_far, state, i, covered = best[at], 0, at, False
            while so_far is not None and i < size:
                child = base[state] + chunk[i] + 1
                if check[child] != state:
                    break
                state, i = child, i + 1
                piece = value[state]
                if piece >= 0:
                    total = so_far + scores[piece]
                    if best[i] is None or total > best[i]:
                        best[i], came[i] = total, (at, piece)
                    covered = covered or i == at + width
            if so_far is not None and not covered:
                total = so_far + self.unknown_score
                if best[at + width] is None or total > best[at + width]:
                    best[at + width], came[at + width] = total, (at, -1)
            at += width
        ids: list[int] = []
        while size > 0:
            start, piece = came[size]
            if piece >= 0:
                ids.append(piece)
            elif self.model.byte_ids:
                ids.extend(self.model.byte_ids[b] for b in reversed(chunk[start:size]))
            else:
                ids.append(self.model.unknown_id)
            size = start
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian bytes of ``dtype``; an empty text has none."""
        if not text:
            return b""
        marked = MARKER + text.replace(" ", MARKER)
        chunks = self.chunk.findall(marked) if self.chunked else [marked]
        known, out = self.known, []
        for chunk in chunks:
            ids = known.get(chunk)
            if ids is None:
                ids = np.array(self.segment(chunk.encode()), self.dtype).tobytes()
                if len(chunk) <= KEPT_LENGTH:
                    taken = ENTRY_BYTES + 4 * len(chunk) + len(ids)
                    if self.size + taken > KEPT_BYTES:
                        known.clear()
                        self.size = 0
                    self.size += taken
                    known[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes joined, markers as spaces, without the leading one."""
        return self.joined([self.written[i] for i in ids])

    @staticmethod
    def joined(written: list[bytes]) -> str:
        text = b"".join(written).decode(errors="replace").replace(MARKER, " ")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[int, PieceCodec] = {}


def _codec(shared: Broadcast) -> PieceCodec:
    """The worker's codec of a broadcast model, with what it has met."""
    if shared.value is not None and id(shared.value) not in _codecs:
        _codecs.clear()
        _codecs[id(shared.value)] = PieceCodec(shared.value)
    return _codecs[id(shared.value)]


def encode_pieces(docs: DataFrame, model: PieceModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text, ids, n_ids, ids_crc32`` of every row; the checksum is that of the ids as little-endian 32-bit
    integers.

    A null text counts as empty and has no ids. Null ids of documents pass through, repeated rows are encoded each,
    other columns are not read. Empty tables give an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            found = [codec.encode(t) for t in batch.column("text").to_pylist()]
            wide = [np.frombuffer(ids, codec.dtype).astype("<i4") for ids in found]
            counts = [len(ids) for ids in wide]
            offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
            values = pa.array(np.concatenate(wide) if wide else np.zeros(0, "<i4"), pa.int32())
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.ListArray.from_arrays(offsets, values),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(ids.tobytes()) for ids in wide], pa.int64()),
                ],
                names=["doc_id", "text", "ids", "n_ids", "ids_crc32"],
            )

    fields = [
        columns.schema["doc_id"],
        StructField("text", StringType()),
        StructField("ids", ArrayType(IntegerType())),
        StructField("n_ids", LongType()),
        StructField("ids_crc32", LongType()),
    ]
    return text_rows(columns).mapInArrow(encode, StructType(fields))


def decode_pieces(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            ids = batch.column("ids")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())
            written = codec.written_array[pc.list_flatten(ids).to_numpy()]
            texts = [codec.joined(written[a:b].tolist()) for a, b in zip([0, *ends[:-1]], ends)]
            yield pa.record_batch(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"]
            )

    rest = encoded.drop("decoded")
    return text_rows(rest).mapInArrow(decode, StructType([*rest.schema, StructField("decoded", StringType())]))
