import re
from collections import Counter

import pytest

from langweave import scratch
from langweave.llm.quality_rules import COUNT_COLUMNS, quality_rules, trusted_ids

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    covered = {p for k, w in enumerate(windows) if often[w] > 1 for p in range(k, k + 8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


@pytest.fixture
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def test_counts_equal_brute_force(documents, labels):
    frame, rows = documents
    got = {r.doc_id: r for r in quality_rules(frame, labels).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        want = expected(text)
        assert tuple(got[doc_id][c] for c in COUNT_COLUMNS) == want
        assert got[doc_id].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[doc_id].base_failed and got[doc_id].kept)


def test_separates_labelled_documents(documents, labels):
    frame, _ = documents
    judged = quality_rules(frame, labels).join(labels, "doc_id").filter("not base_failed")
    counts = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.01 * counts[1, True]
    assert counts.get((0, True), 0) <= 0.2 * (counts[0, False] + counts.get((0, True), 0))


def test_repeats_ties_and_overlaps(make, labels):
    line = "a b c d e f g h"
    texts = [f"{line} {line}", f"{line} i {line} i", "x " * 20, f"{line}\n{line}\n \n{line}", "a b c d " * 2]
    got = quality_rules(make(texts), labels).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COUNT_COLUMNS) for r in got] == [expected(t) for t in texts]


def test_awkward_rows(awkward, labels, spark):
    got = quality_rules(awkward.selectExpr("*", "1 as kept", "'x' as RATIO"), labels)
    assert [c for c in got.columns if c.lower() in ("kept", "ratio")] == ["ratio", "kept"]
    rows = got.collect()
    assert len(rows) == 10
    assert {r.n_words for r in rows if not (r.text or "").strip(" \n\t")} == {0}
    assert all(r.ratio == 0 and r.base_failed for r in rows if r.n_words == 0)
    assert [tuple(r[c] for c in COUNT_COLUMNS) for r in rows] == [expected(r.text) for r in rows]
    assert quality_rules(awkward.limit(0), labels).collect() == []


def test_without_trusted_documents_only_rules_judge(make, spark):
    nobody = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = make([" ".join(f"w{k}" for k in range(40))])
    for labels in (nobody, odd):
        row = quality_rules(docs, labels).first()
        assert row.ratio == 0 and row.kept


def test_keeps_good_documents_outside_the_trusted_ones(spark):
    """A quarter of the Spanish labels and half of the others: good documents nobody labelled stay, bad ones go."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every = spark.read.parquet(f"{folder}/labels.parquet").join(docs.select("doc_id", "lang"), "doc_id")
    given = every.filter("pmod(xxhash64(doc_id), 4) < if(lang = 'es', 1, 2)").select("doc_id", "quality", "toxic")
    unseen = quality_rules(docs, given).join(every.drop("lang").join(given, "doc_id", "anti"), "doc_id").filter("not base_failed")
    counts = {(r.lang, r.quality, r.kept): r["count"] for r in unseen.groupBy("lang", "quality", "kept").count().collect()}
    for lang in ("de", "en", "es", "fr"):
        assert counts.get((lang, 1, False), 0) <= 0.02 * counts[lang, 1, True]
    total = lambda quality, kept: sum(n for (_, q, k), n in counts.items() if (q, k) == (quality, kept))
    assert total(1, False) <= 0.01 * total(1, True)
    assert total(0, True) <= 0.1 * total(0, False)


def test_every_good_label_is_trusted_once(spark):
    rows = [(i, 1, 0) for i in range(1000)] * 3 + [(None, 1, 0), (5000, 0, 0), (6000, None, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in trusted_ids(labels).collect()} == set(range(1000)) and trusted_ids(labels).count() == 1000
    assert [r.doc_id for r in trusted_ids(labels, 0).collect()] == [5000]


def test_each_of_many_languages_is_compared_apart(spark):
    """Half of forty languages have trusted documents; texts of the others read like their own corpus."""
    text = lambda lang, i: " ".join(f"l{lang}w{(i * 7 + k * k) % 60}" for k in range(40))
    rows = [(lang * 100 + i, text(lang, i), f"l{lang}") for lang in range(40) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.filter("doc_id < 2000").selectExpr("doc_id", "1 as quality", "0 as toxic")
    ratios = quality_rules(docs, labels).groupBy("lang").agg({"ratio": "avg"}).collect()
    assert len(ratios) == 40 and all(abs(r["avg(ratio)"]) < 0.02 for r in ratios)


def test_joins_without_broadcast_judge_alike(documents, labels, monkeypatch):
    frame, _ = documents
    before = {r.doc_id: (r.ratio, r.kept) for r in quality_rules(frame, labels).collect()}
    monkeypatch.setattr(scratch.small_side, "__defaults__", (0,))
    assert {r.doc_id: (r.ratio, r.kept) for r in quality_rules(frame, labels).collect()} == before
