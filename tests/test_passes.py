"""Work that grows with the corpus is done on numbers, in Arrow batches, and gives what the plain forms give."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from langweave.operators import features, grams


def plain_summary(docs, block, options):
    grams = docs.select("id", features.block_ngrams(F.col("text"), block, options).alias("g"))
    return grams.select(
        "id", F.size("g").alias("n_terms"), F.size(F.array_distinct("g")).alias("n_distinct"),
        F.array_min("g").alias("first_term"), F.array_max("g").alias("last_term"),
        F.length(F.array_join("g", "")).alias("n_letters"),
    )


def test_gram_summary_is_that_of_the_array_of_grams(spark):
    texts = [
        "ab abc ab ab", "a", "", "  ", None, "x\U0001f44dy \U0001f44d\U0001f44d zz", "éa ñandú 12_3 éa ñandú", "w" * 50,
        "ــ العربية word العربية", " ".join(f"t{i % 7} u{i % 5}" for i in range(300)), "ab abc", "�\U0001f600 zz �",
    ]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "id int, text string").repartition(3)
    for block in (features.WORD, features.CHAR):
        for options in (features.FeatureOptions(), features.FeatureOptions(word_ngrams=(2, 2), char_ngrams=(3, 5))):
            got = features.gram_summary(docs, "id", "text", block, options)
            want = plain_summary(docs, block, options)
            assert got.dtypes == want.dtypes
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_gram_summary_makes_no_array_of_grams(spark):
    docs = spark.createDataFrame([(1, "ab abc")], "id int, text string")
    plan = features.gram_summary(docs, "id", "text", features.CHAR)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and plan.count("regexp_extract_all") == 0


def test_padded_words_clean_a_text_once(spark):
    docs = spark.createDataFrame([(" A  b c ",), ("",), (" \t",), (None,)], "text string")
    padded = docs.select(features.padded_words(F.col("text")).alias("p"))
    assert [r["p"] for r in padded.collect()] == [" a b c ", "", "", ""]
    assert padded._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_gram_summary_numbers_grams_anew_where_numbers_would_outgrow_their_type(monkeypatch):
    texts = pa.array([" " + " ".join(f"t{i * k % 17} éu{i % 5}" for i in range(40)) + " " for k in (1, 2, 3)])
    for whole_words, sizes in ((False, (2, 4)), (True, (1, 3))):
        want = grams.summarised(whole_words, sizes)(texts)
        with monkeypatch.context() as patch:
            patch.setattr(grams, "MOST", 1000)
            assert grams.summarised(whole_words, sizes)(texts).to_pylist() == want.to_pylist()


def test_prepared_texts_give_the_same_features(spark):
    texts = ["Ab abc ab", "", None, "é x 12_3", " ــ  العربية word"]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "id int, text string")
    ready = features.prepared(docs, "text", ["id"])
    plain, read = features.fit_features(docs.fillna(""), "text"), features.fit_features(ready, "text")
    assert (read.word, read.char) == (plain.word, plain.char)
    for ratio, values in plain.scaling.items():
        assert read.scaling[ratio] == pytest.approx(values)
    vectors = [
        {r["id"]: r["features"] for r in plain.transform(table, "text", ["id"]).collect()} for table in (docs, ready)
    ]
    assert vectors[0] == vectors[1]
    plan = features._symbols(ready, "text", features.WORD)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
