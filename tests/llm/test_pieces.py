import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from langweave.llm import pieces
from langweave.llm.pieces import MARKER, DoubleArray, PieceCodec, PieceModel, decode_pieces, encode_pieces


@pytest.fixture(scope="module")
def model():
    return PieceModel.from_file(public_tokenizers.path("piece_bpe_32k.model"))


def small(pieces, fallback=True):
    names = ["<unk>"] + ([f"<0x{b:02X}>" for b in range(256)] if fallback else [])
    ordinary = list(range(len(names), len(names) + len(pieces)))
    return PieceModel(
        names + list(pieces), [0.0] * len(names) + list(pieces.values()), ordinary, list(range(1, 257)) if fallback else [], 0
    )


def best_score(text, pieces, unknown):
    """The highest score over all segmentations."""
    if not text:
        return 0.0
    options = [s + best_score(text[len(p) :], pieces, unknown) for p, s in pieces.items() if text.startswith(p)]
    if text[0] not in pieces:
        options.append(unknown + best_score(text[1:], pieces, unknown))
    return max(options)


def test_viterbi_finds_the_best_segmentation():
    r = random.Random(3)
    pieces = {"".join(c): -float(r.randint(1, 40)) for n in (1, 2, 3) for c in itertools.product("ab" + MARKER, repeat=n) if r.random() < 0.6}
    pieces = {p: s for p, s in pieces.items() if MARKER not in p.lstrip(MARKER)}
    codec = PieceCodec(small(pieces))
    for _ in range(200):
        text = "".join(r.choice("ab c") for _ in range(r.randint(1, 9)))
        ids = np.frombuffer(codec.encode(text), codec.dtype).tolist()
        assert codec.decode(ids) == text
        marked = MARKER + text.replace(" ", MARKER)
        # An uncovered character shows as its bytes, of which the first tells how many there are.
        uncovered = sum(1 for i in ids if 1 <= i <= 256 and (i - 1 < 0x80 or i - 1 >= 0xC0))
        score = sum(codec.model.scores[i] for i in ids) + uncovered * codec.unknown_score
        assert score == pytest.approx(best_score(marked, pieces, codec.unknown_score))


def test_trie_holds_all_pieces(model):
    trie = DoubleArray({model.pieces[i].encode(): i for i in model.ordinary})
    for i in model.ordinary:
        state = 0
        for b in model.pieces[i].encode():
            child = trie.base[state] + b + 1
            assert trie.check[child] == state
            state = child
        assert trie.value[state] == i
    assert sum(v >= 0 for v in trie.value) == len(model.ordinary)


def test_equals_the_library_as_a_unigram_model(documents):
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    for k, piece in enumerate(proto.pieces):
        # Scores that single precision adds exactly, all different enough that no two segmentations tie by rounding.
        piece.score = -float(1 + min(-piece.score, 40_000) // 64) if piece.type == 1 else 0.0
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    model = PieceModel.from_file(public_tokenizers.path("piece_bpe_32k.model"))
    model.scores = [p.score for p in proto.pieces]
    codec = PieceCodec(model)
    lines = [line[:200] for _, text in documents[1][:60] for line in text.split("\n") if line]
    assert len(lines) > 100
    for line in lines:
        assert np.frombuffer(codec.encode(line), codec.dtype).tolist() == library.encode(line)


def test_ties_go_to_the_longer_last_piece():
    codec = PieceCodec(small({MARKER: -1.0, "a": -1.0, "aa": -2.0}))
    ids = np.frombuffer(codec.encode("aaa"), codec.dtype).tolist()
    assert [codec.model.pieces[i] for i in ids] == [MARKER, "a", "aa"]


def test_without_byte_fallback_unknown_characters_are_one_id_each():
    codec = PieceCodec(small({MARKER: -1.0, "a": -1.0}, fallback=False))
    ids = np.frombuffer(codec.encode("aé"), codec.dtype).tolist()
    assert [codec.model.pieces[i] for i in ids] == [MARKER, "a", "<unk>"]


def test_whole_documents_round_trip(documents, model):
    frame, rows = documents
    got = decode_pieces(encode_pieces(frame, model), model).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert r.decoded == texts[r.doc_id] and r.n_ids == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_awkward_rows(awkward, model):
    got = decode_pieces(encode_pieces(awkward.selectExpr("*", "1 as ids", "2 as decoded"), model), model).collect()
    assert len(got) == 10
    assert all(r.decoded == r.text for r in got)
    assert [r.n_ids for r in got if r.text == ""] == [0, 0]
    assert encode_pieces(awkward.limit(0), model).collect() == []


def test_remembered_chunks_are_bounded_in_bytes(model, monkeypatch):
    free = PieceCodec(model)
    monkeypatch.setattr(pieces, "KEPT_BYTES", 15_000)
    codec = PieceCodec(model)
    for i in range(200):
        text = f"word{i} and " + chr(0x4E00 + i) * 200
        assert codec.encode(text) == free.encode(text)
        assert codec.size <= 15_000 and all(len(c) <= pieces.KEPT_LENGTH for c in codec.known)
        assert sum(len(c.encode()) + len(v) for c, v in codec.known.items()) <= codec.size
