import math
import re
from collections import Counter

import random

import pytest
from pyspark.sql import functions as F

from langweave.functions import ngrams
from langweave.operators import features as ft

TEXTS = [
    "the cat sat on the mat",
    "a b cc \U0001f44d\U0001f3fd ok\U0001f600x",
    "واش نتا لاباس 3likom",
    "d'accord, c'est le cat.",
    "x",
    "",
    "the the the cat",
    "MiXed CASE words_1 and\ttabs nbsp",
]


def py_words(text):
    words = re.findall(r"\b\w\w+\b", text.lower())
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def py_chars(text):
    grams = []
    for word in text.lower().split():
        padded = f" {word} "
        grams += [padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)]
    return grams


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").cache()


def test_ngrams_against_python(spark, docs):
    rows = docs.select("id", ngrams.word_ngrams(F.col("text")).alias("w"), ngrams.char_wb_ngrams(F.col("text")).alias("c"))
    for row in rows.collect():
        assert Counter(row["w"]) == Counter(py_words(TEXTS[row["id"]]))
        assert Counter(row["c"]) == Counter(py_chars(TEXTS[row["id"]]))


def brute_tfidf(grams_of, k):
    tf = [Counter(grams_of(t)) for t in TEXTS]
    total, df = Counter(), Counter()
    for counts in tf:
        total.update(counts)
        df.update(counts.keys())
    vocabulary = sorted(sorted(total, key=lambda t: (-total[t], t.encode()))[:k], key=str.encode)
    idf = {t: math.log((1 + len(TEXTS)) / (1 + df[t])) + 1 for t in vocabulary}
    out = []
    for counts in tf:
        raw = {t: (1 + math.log(counts[t])) * idf[t] for t in vocabulary if counts[t]}
        length = math.sqrt(sum(x * x for x in raw.values()))
        out.append({vocabulary.index(t): x / length for t, x in raw.items()})
    return vocabulary, out


@pytest.mark.parametrize("k", [5, 12, 10_000])
@pytest.mark.parametrize("block,grams_of", [("word", py_words), ("char", py_chars)])
def test_tfidf_against_brute_force(spark, docs, block, grams_of, k):
    vocabulary, expected = brute_tfidf(grams_of, k)
    fitted = ft.fit_vocabulary(docs, "text", block, ft.FeatureOptions(max_features=k))
    assert fitted.terms == vocabulary
    got = [{} for _ in TEXTS]
    for row in ft.tfidf(docs, "id", "text", block, fitted).collect():
        got[row["id"]][row["slot"]] = row["weight"]
    for mine, want in zip(got, expected):
        assert mine == pytest.approx(want)


def test_vectors_and_reload(spark, docs, tmp_path):
    model = ft.fit_features(docs, "text")
    vectors = {r["id"]: r["features"] for r in model.transform(docs, "text", ["id"]).collect()}
    assert len(vectors) == len(TEXTS)
    _, words = brute_tfidf(py_words, 10_000)
    _, chars = brute_tfidf(py_chars, 10_000)
    for i, vector in vectors.items():
        assert vector.size == model.size
        expected = dict(words[i])
        expected.update({len(model.word.terms) + s: w for s, w in chars[i].items()})
        ratios = {s: float(vector[s]) for s in range(model.size - 3, model.size)}
        assert dict(zip(vector.indices.tolist(), vector.values.tolist())) == pytest.approx({**expected, **ratios})
    model.save(spark, str(tmp_path / "features"))
    again = ft.FeatureModel.load(spark, str(tmp_path / "features"))
    assert (again.word, again.char, again.scaling, again.options) == (model.word, model.char, model.scaling, model.options)


def test_scaling_without_spread(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "cc")], "id int, text string")
    scaling = ft.fit_ratio_scaling(docs, "text")
    assert scaling == {"arab_ratio": (0.0, 1.0), "latin_ratio": (1.0, 1.0), "cs_ratio": (0.0, 1.0)}
    rows = ft.scale_features(docs, "text", scaling).select(*ft.RATIOS).distinct().collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0, 0.0)]


def test_empty_vocabulary_and_null_text(spark):
    docs = spark.createDataFrame([(1, None), (2, "!")], "id int, text string")
    model = ft.fit_features(docs.filter("id = 2"), "text")
    rows = {r["id"]: r["features"] for r in model.transform(docs, "text", ["id"]).collect()}
    assert model.word.terms == [] and set(rows) == {1, 2}


@pytest.mark.parametrize("block", [ft.WORD, ft.CHAR])
@pytest.mark.parametrize("k", [5, 40, 10_000])
def test_pruned_counting_finds_the_same_terms(spark, block, k):
    r = random.Random(k)
    words = ["ab", "abc", "bc", "cab", "ba", "aab", "cc"] + [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choices(words, weights=[20] * 7 + [1] * 30, k=r.randint(0, 25))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    options = ft.FeatureOptions(max_features=k)
    every = ft.vocab_topk(ft.term_statistics(docs, "t", block, options), k)
    pruned = ft.vocab_topk(ft.frequent_terms(docs, "t", block, options), k)
    assert [tuple(x) for x in pruned.collect()] == [tuple(x) for x in every.collect()]


@pytest.mark.parametrize("buckets", [64, 1 << 20])
def test_two_passes_count_every_frequent_term(spark, monkeypatch, buckets):
    """With very few buckets nearly all are shared: the count is widened until it is proven."""
    monkeypatch.setattr(ft, "SKETCH_BUCKETS", buckets)
    monkeypatch.setattr(ft, "BUCKETS_PER_TERM", 1)
    written = []
    real = ft.materialize
    monkeypatch.setattr(ft, "materialize", lambda df, name, *a: written.append(name) or real(df, name, *a))
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(4000)]
    docs = spark.createDataFrame([(" ".join(words[i : i + 40]),) for i in range(0, 4000, 40)], "t string")
    options = ft.FeatureOptions(max_features=25)
    found = ft.frequent_terms(docs, "t", ft.WORD, options)
    assert written[0] == "sketch-word" and (buckets == 64 or written == ["sketch-word", "terms-word"])
    every = ft._counted(ft._listed(docs, "t", ft.WORD, options))
    assert [tuple(x) for x in ft.vocab_topk(found, 25).collect()] == [tuple(x) for x in ft.vocab_topk(every, 25).collect()]
    if buckets > 64:
        assert found.count() < every.count() / 4


def test_sketches_merge(spark):
    docs = spark.createDataFrame([("a bb cc bb cc",), ("cc dd",), (None,), ("",)], "t string")
    whole = ft.term_sketch(docs, "t", ft.WORD)
    parts = ft.merged_sketches(*[ft.term_sketch(docs.filter(f"t {c} 'b'"), "t", ft.WORD) for c in ("<", ">=")])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
