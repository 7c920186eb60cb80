import hashlib
import re

from pyspark.sql import functions as F

from langweave.llm.exact_dedup import exact_dedup, exact_groups, filter_bits, maybe_repeated, normalized, repeated_bits
from langweave.scratch import computed_once


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def test_equals_brute_force(documents):
    frame, rows = documents
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(digest(text), []).append(doc_id)
    got = exact_dedup(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), r.doc_id == min(ids))


def test_awkward_rows(awkward):
    got = exact_dedup(awkward.selectExpr("*", "true as kept", "0 as Keep_Id")).collect()
    assert len(got) == 10
    of = {}
    for r in got:
        of.setdefault(r.text_sha256, []).append(r)
    empty = of[digest("")]
    assert sorted(r.doc_id for r in empty) == [0, 1] and {r.keep_id for r in empty} == {0}
    ones = of[digest("one")]
    # The repeated row of the smallest id stays with it.
    assert sorted((r.doc_id, r.kept, r.group_size) for r in ones) == [(3, True, 3), (3, True, 3), (4, False, 3)]
    lost = of[digest("lost id")][0]
    assert lost.doc_id is None and lost.keep_id is None and lost.kept
    assert exact_dedup(awkward.limit(0)).collect() == []


def test_digests_alone_give_the_same_groups(awkward, documents):
    for frame in (awkward, documents[0], awkward.limit(0)):
        whole = exact_dedup(frame).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert sorted(map(str, exact_groups(frame).select(whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_blank_runs_are_one_space_and_ends_count(make):
    got = exact_dedup(make(["a b", "a \t\r\n b", " a b", "a b"])).orderBy("doc_id").collect()
    assert [r.keep_id for r in got] == [0, 0, 2, 3]


def test_filter_has_no_false_negative_even_when_full(make, spark):
    texts = [f"text {k // 2 if k < 200 else k}" for k in range(2000)]
    docs = computed_once(make(texts), "text_sha256", F.sha2(normalized("text").cast("binary"), 256))
    for bits in (1 << 10, 1 << 15, 1 << 20):
        bitmaps = repeated_bits(docs.select("text_sha256"), bits)
        found = {r.doc_id for r in maybe_repeated(docs, bitmaps, bits).filter("_maybe").collect()}
        assert set(range(200)) <= found
        assert bits < 1 << 20 or len(found) < 300


def test_filter_size_is_bounded():
    assert filter_bits(0) == 1 << 20
    assert filter_bits(10**6) == 1 << 24
    assert filter_bits(10**12) == 1 << 28
