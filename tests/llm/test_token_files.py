import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from langweave.llm import token_files
from langweave.llm.token_files import BATCH_SEQUENCES, TokenFile, WordEncoder, read_checksums, write_token_files


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def encoded(vocabulary, text):
    return Tokenizer.from_str(vocabulary).encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, got, vocabulary):
    tokenizer, start = Tokenizer.from_str(vocabulary), 0
    assert len(got) == len(rows)
    for (doc_id, text), r in zip(rows, got):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_equals_whole_text_encoding(documents, vocabulary):
    frame, rows = documents
    index = write_token_files(frame, vocabulary, sequence_length=256, shard_documents=60)
    assert index.select("shard").distinct().count() > 1
    check(sorted(rows), read_checksums(index).orderBy("doc_id").collect(), vocabulary)


def test_words_are_encoded_as_within_the_text(make, vocabulary):
    texts = [
        "it's John'S  they'll",
        "á é́ ́x  x ́",
        "ΑΣ ΑΣΑ Σ",
        "<|endoftext|> a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>. x<|endoftext|>, ..., a.. É. b.c. 1. it's.",
        "tab\tand\x0bvt \x1c fs nbsp em　ideographic",
        "1234 12a34 !!?? a-b_c",
        "\n\n x \n",
        "İstanbul ǅ ẞ 한국 한 👨‍👩‍👧",
    ]
    got = read_checksums(write_token_files(make(texts), vocabulary)).orderBy("doc_id").collect()
    check(list(enumerate(texts)), got, vocabulary)


def test_awkward_rows(awkward, vocabulary):
    got = read_checksums(write_token_files(awkward, vocabulary)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, 4, 5, 6, 7]
    assert [r.n_tokens for r in got[1:4]] == [1, 1, 1]
    assert write_token_files(awkward.limit(0), vocabulary).collect() == []


def test_sequences_are_views_of_equal_length(make, vocabulary):
    texts = ["some words of a text " * 40] * 30
    index = write_token_files(make(texts), vocabulary, sequence_length=16, shard_documents=1000)
    paths = [r.path for r in index.select("path").distinct().collect()]
    assert len(paths) == 1
    shard = TokenFile(paths[0])
    total = sum(r.n_tokens for r in index.collect())
    count = -(-total // 16)
    ids = []
    for i in range(count):
        sequence, bits = shard.sequence(i)
        mask = bits.to_numpy(zero_copy_only=False)
        assert len(sequence) == len(mask) == 16 and not sequence.flags.owndata
        assert mask.sum() == (16 if i + 1 < count else total - 16 * i)
        ids += sequence[mask].tolist()
    assert count > BATCH_SEQUENCES
    assert ids == encoded(vocabulary, texts[0]) * 30


@pytest.mark.parametrize("end", [".", ","])
def test_every_character_before_a_stop(vocabulary, end):
    """The word encoder's ids of all code points before a full stop or comma are those of the whole text."""
    encoder, tokenizer = WordEncoder(vocabulary), Tokenizer.from_str(vocabulary)
    points = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c not in "\x00 \n"]
    for at in range(0, len(points), 2000):
        text = " ".join(f"a{c}{end}" for c in points[at : at + 2000])
        ids = np.frombuffer(encoder.encode(text), encoder.dtype).tolist()
        if ids != tokenizer.encode(text, add_special_tokens=False).ids:
            for c in points[at : at + 2000]:
                word = f"a{c}{end}"
                found = np.frombuffer(encoder.encode(word), encoder.dtype).tolist()
                assert found == tokenizer.encode(word, add_special_tokens=False).ids, (hex(ord(c)), found)
            pytest.fail(f"words from {hex(ord(points[at]))} on")


def test_normalised_letters_before_a_stop(vocabulary):
    encoder, tokenizer = WordEncoder(vocabulary), Tokenizer.from_str(vocabulary)
    for text in ("CUMHURİYETİ. Ankara", "Bir gün İ, sonra", "क़. क़, ড়.", "É. é, É."):
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_remembered_words_are_bounded_in_bytes(vocabulary, monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_BYTES", 20_000)
    encoder, tokenizer = WordEncoder(vocabulary), Tokenizer.from_str(vocabulary)
    for i in range(300):
        text = f"word{i} " + chr(0x4E00 + i) * 300
        ids = np.frombuffer(encoder.encode(text), encoder.dtype).tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids
        known = encoder.known
        assert known.size <= 20_000 and all(len(w) <= token_files.KEPT_LENGTH for w in known)
        assert sum(len(w.encode()) + len(v) for w, v in known.items()) <= known.size
