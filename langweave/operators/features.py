"""Word and character n-gram TF-IDF, script-ratio features and their assembly into vectors.

Fitting a vocabulary shuffles once, by term, after partial aggregation. Applying it needs no shuffle:
n-grams, counts, weights and the unit length of a document are all computed inside its row for scoring, in a
table or a stream, and in Arrow batches for long forms and vector tables.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property, reduce

import numpy as np
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from langweave.fixed_values import CHAR_NGRAMS, MAX_FEATURES, WORD_NGRAMS
from langweave.functions.ngrams import char_wb_ngrams, padded_words, spaced_words, word_ngrams
from langweave.functions.text import ratios_of, script_counts, script_ratios
from langweave.operators import grams
from langweave.scratch import computed_once, in_small_batches, materialize

WORD, CHAR = "word", "char"
# Columns of a table with ``prepared`` texts: its words, padded words and counts by script.
PREPARED = {WORD: "_spaced", CHAR: "_padded"}
SCRIPTS = "_scripts"
CUTS = {WORD: spaced_words, CHAR: padded_words}
RATIOS = ("arab_ratio", "latin_ratio", "cs_ratio")
SKETCH_BUCKETS = 1 << 20
# Of the fullest buckets so many are counted for each wanted term.
BUCKETS_PER_TERM = 2


@dataclass(frozen=True)
class FeatureOptions:
    """Vocabulary size and n-gram ranges; the size applies to each block."""

    max_features: int = MAX_FEATURES
    word_ngrams: tuple[int, int] = WORD_NGRAMS
    char_ngrams: tuple[int, int] = CHAR_NGRAMS


@dataclass
class Vocabulary:
    """Terms in slot order and their idf; at most ``max_features`` of them, so small enough to hold."""

    terms: list[str]
    idf: list[float]

    @cached_property
    def counter(self) -> CountVectorizerModel:
        return CountVectorizerModel.from_vocabulary(self.terms, "_grams", "_vector")


def literal_array(values: Sequence[float]) -> Column:
    """A constant double array; one folded literal however many values."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<double>")


def block_ngrams(text: Column, block: str, options: FeatureOptions = FeatureOptions()) -> Column:
    if block == WORD:
        return word_ngrams(text, options.word_ngrams)
    return char_wb_ngrams(text, options.char_ngrams)


def _listed(docs: DataFrame, text: str, block: str, options: FeatureOptions) -> DataFrame:
    """``term, _occurrence``: the grams of each document and then, not marked as occurrences, its distinct grams.

    Both counts of a term come from one pass over this list.
    """
    cut = docs.select(block_ngrams(F.col(text), block, options).alias("_grams"))
    listed = cut.select(
        F.size("_grams").alias("_n"),
        F.posexplode(F.concat("_grams", F.array_distinct("_grams"))).alias("_position", "term"),
    )
    return listed.select("term", (F.col("_position") < F.col("_n")).alias("_occurrence"))


def _counted(listed: DataFrame) -> DataFrame:
    return listed.groupBy("term").agg(
        F.count_if("_occurrence").alias("total_tf"), F.count_if(~F.col("_occurrence")).alias("df")
    )


def term_statistics(docs: DataFrame, text: str, block: str, options: FeatureOptions = FeatureOptions()) -> DataFrame:
    """``term, total_tf, df`` of all terms over all documents, written out once."""
    return materialize(_counted(_listed(docs, text, block, options)), f"terms-{block}")


def _symbols(docs: DataFrame, text: str, block: str, keep: Sequence[str] = ()) -> DataFrame:
    """The words or padded words of each text, as ``grams`` cuts them."""
    return in_small_batches(docs).select(*keep, _cut(docs, F.col(text), block).alias("_symbols"))


def _cut(docs: DataFrame, text: Column, block: str) -> Column:
    """The words or padded words of a text, or the column of ``prepared`` that has them."""
    if PREPARED[block] in docs.columns:
        return F.col(PREPARED[block])
    return CUTS[block](text)


def _ratios(docs: DataFrame, text: Column) -> Column:
    return ratios_of(F.col(SCRIPTS)) if SCRIPTS in docs.columns else script_ratios(text)


def prepared(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` and what the fits of features and vector tables read of each text, written once.

    They pass over the texts seven times, and the patterns that cut a text cost more than reading what they cut. A null text
    counts as empty, as in vectors.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return materialize(
        docs.select(
            *keep, text, spaced_words(whole).alias(PREPARED[WORD]), padded_words(whole).alias(PREPARED[CHAR]),
            script_counts(whole).alias(SCRIPTS),
        ),
        "prepared",
    )


def _sizes(block: str, options: FeatureOptions) -> tuple[int, int]:
    return tuple(options.word_ngrams if block == WORD else options.char_ngrams)


def gram_summary(
    docs: DataFrame, key: str, text: str, block: str, options: FeatureOptions = FeatureOptions()
) -> DataFrame:
    """``key, n_terms, n_distinct, first_term, last_term, n_letters`` of the grams of every text.

    All grams are cut, in Arrow batches, and counted as numbers; none costs a string or a place in a row's array.
    """
    summarise = F.arrow_udf(grams.summarised(block == WORD, _sizes(block, options)), grams.SUMMARY)
    symbols = _symbols(docs, text, block, [key])
    return computed_once(symbols, "_summary", summarise(F.col("_symbols"))).select(key, "_summary.*")


def term_sketch(docs: DataFrame, text: str, block: str, options: FeatureOptions = FeatureOptions()) -> DataFrame:
    """``bucket, n``: how many grams of all sizes fall into each bucket of a hash, in one pass over the texts.

    Of bounded size for any corpus, and a bucket's count is never below that of a term in it.
    """
    sketch = grams.sketched(block == WORD, _sizes(block, options), SKETCH_BUCKETS)
    return _symbols(docs, text, block).mapInArrow(sketch, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def merged_sketches(*sketches: DataFrame) -> DataFrame:
    """The sketch of all texts behind some sketches."""
    return union_all(*sketches).groupBy("bucket").agg(F.sum("n").alias("n"))


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, others, first)


def _full_buckets(sketch: DataFrame, least: int) -> np.ndarray:
    """Which buckets hold at least ``least`` grams; a bit per bucket comes to the driver."""
    full = sketch.filter(F.col("n") >= least).groupBy(F.shiftright("bucket", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, bucket & 63)")).alias("bits")
    )
    words = np.zeros(-(-SKETCH_BUCKETS // 64), np.int64)
    for row in full.collect():  # at most as many rows as there are words
        words[row["word"]] = row["bits"]
    return np.unpackbits(words.view(np.uint8), count=SKETCH_BUCKETS, bitorder="little").astype(bool)


def _counted_in(docs: DataFrame, text: str, block: str, options: FeatureOptions, full: np.ndarray) -> DataFrame:
    """``term, total_tf, df`` of the terms in full buckets; the others cost no string and no row."""
    count = grams.counted(block == WORD, _sizes(block, options), full)
    parts = _symbols(docs, text, block).mapInArrow(count, "term string, total_tf long, df long")
    return parts.groupBy("term").agg(F.sum("total_tf").alias("total_tf"), F.sum("df").alias("df"))


def frequent_terms(docs: DataFrame, text: str, block: str, options: FeatureOptions = FeatureOptions()) -> DataFrame:
    """``term, total_tf, df`` of terms among which are the ``max_features`` most frequent; the rest may be missing.

    Two passes over the texts, whatever the number of sizes. The first fills a sketch; the second counts exactly the
    terms in its fullest buckets, so the long tail of rare grams, which outgrows the corpus, never shuffles. A bucket holds
    no fewer grams than any of its terms: if ``max_features`` counted terms reach the least full of these buckets, no
    other term can belong to the most frequent ones. Should they not, which takes many shared buckets, more buckets are
    counted.
    """
    sketch = materialize(term_sketch(docs, text, block, options), f"sketch-{block}")
    wanted = BUCKETS_PER_TERM * options.max_features
    while True:
        fullest = sketch.orderBy(F.desc("n")).limit(wanted).agg(F.count("*").alias("buckets"), F.min("n").alias("least")).first()
        if fullest["buckets"] < wanted or fullest["least"] <= 1:
            every = np.ones(SKETCH_BUCKETS, bool)
            return materialize(_counted_in(docs, text, block, options, every), f"terms-{block}")
        full = _full_buckets(sketch, fullest["least"])
        counted = materialize(_counted_in(docs, text, block, options, full), f"terms-{block}")
        if counted.filter(F.col("total_tf") >= fullest["least"]).limit(options.max_features).count() == options.max_features:
            return counted
        wanted *= 4


def vocab_topk(stats: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent terms, ties by term.

    A histogram over powers of two finds a count that at least ``k`` terms reach, so the final sort
    merges about ``k`` terms instead of ``k`` per task.
    """
    histogram = (
        stats.groupBy(F.floor(F.log2("total_tf")).alias("octave"))
        .agg(F.count("*").alias("terms"), F.min("total_tf").alias("lowest"))
        .orderBy(F.desc("octave"))
        .collect()  # at most 64 rows
    )
    reached, lowest = 0, 0
    for octave in histogram:
        reached, lowest = reached + octave["terms"], octave["lowest"]
        if reached >= k:
            break
    frequent = stats.filter(F.col("total_tf") >= lowest)
    return frequent.orderBy(F.desc("total_tf"), "term").limit(k)


def smooth_idf(df: Column, n_docs: int) -> Column:
    return F.ln((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + 1.0


def fit_vocabulary(docs: DataFrame, text: str, block: str, options: FeatureOptions = FeatureOptions()) -> Vocabulary:
    """The kept terms of one block, in term order, with their idf."""
    top = vocab_topk(frequent_terms(docs, text, block, options), options.max_features)
    rows = top.select("term", smooth_idf(F.col("df"), docs.count()).alias("idf")).collect()
    rows.sort(key=lambda row: row["term"].encode())
    return Vocabulary([row["term"] for row in rows], [row["idf"] for row in rows])


def add_tfidf(df: DataFrame, text: str, block: str, vocabulary: Vocabulary, options: FeatureOptions) -> DataFrame:
    """Add ``{block}_slots`` and ``{block}_weights``: (1 + ln tf) * idf of the known terms of a row, scaled
    to unit length. A row without known terms, or with null text, has empty arrays.

    All inside the row by native expressions, for scoring where the row is; ``add_weighed`` does the same for tables.
    """
    slots, weights = f"{block}_slots", f"{block}_weights"
    if not vocabulary.terms:
        return df.withColumn(slots, F.array().cast("array<int>")).withColumn(weights, F.array().cast("array<double>"))
    cut = block_ngrams(F.coalesce(F.col(text), F.lit("")), block, options)
    counted = vocabulary.counter.transform(df.withColumn("_grams", cut))
    counted = computed_once(counted, "_counts", F.unwrap_udt("_vector")).drop("_grams", "_vector")
    idf = literal_array(vocabulary.idf)
    raw = F.zip_with("_counts.indices", "_counts.values", lambda i, tf: (1.0 + F.ln(tf)) * F.get(idf, i))
    weighted = computed_once(counted, "_raw", raw)
    length = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda total, x: total + x * x))
    scaled = computed_once(weighted, "_length", length)
    return scaled.select(
        *df.columns,
        F.col("_counts.indices").alias(slots),
        F.transform("_raw", lambda x: x / F.col("_length")).alias(weights),
    )


def add_weighed(df: DataFrame, text: str, block: str, vocabulary: Vocabulary, options: FeatureOptions) -> DataFrame:
    """As ``add_tfidf``, in Arrow batches that build no string for a gram: several times faster over a table."""
    return add_weighed_blocks(df, text, {block: vocabulary}, options)


def add_weighed_blocks(
    df: DataFrame, text: str, vocabularies: Mapping[str, Vocabulary], options: FeatureOptions
) -> DataFrame:
    """``add_weighed`` for some blocks, all by one worker of a task: each further one would hold its own share of memory."""
    weighed, found = [], []
    for block, vocabulary in vocabularies.items():
        names = f"{block}_slots", f"{block}_weights"
        if not vocabulary.terms:
            found += [F.array().cast(f"array<{kind}>").alias(name) for name, kind in zip(names, ("int", "double"))]
            continue
        weigh = F.arrow_udf(grams.weighed(vocabulary.terms, vocabulary.idf, block == WORD, _sizes(block, options)), grams.WEIGHED)
        weighed.append(weigh(_cut(df, F.coalesce(F.col(text), F.lit("")), block)).alias(block))
        found += [F.col(f"_weighed.{block}.{part}").alias(name) for name, part in zip(names, ("slots", "weights"))]
    rows = computed_once(in_small_batches(df), "_weighed", F.struct(*weighed)) if weighed else df
    return rows.select(*df.columns, *found)


def tfidf(
    docs: DataFrame, key: str, text: str, block: str, vocabulary: Vocabulary, options: FeatureOptions = FeatureOptions()
) -> DataFrame:
    """``key, slot, weight`` in long form."""
    entries = F.arrays_zip(F.col(f"{block}_slots").alias("slot"), F.col(f"{block}_weights").alias("weight"))
    return add_weighed(docs.select(key, text), text, block, vocabulary, options).select(key, F.inline(entries))


def fit_ratio_scaling(docs: DataFrame, text: str) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per ratio (1 where there is no spread), in one pass."""
    ratios = computed_once(docs, "_r", _ratios(docs, F.col(text)))
    stats = ratios.agg(
        *[F.avg(f"_r.{c}").alias(f"{c}_mean") for c in RATIOS],
        *[F.stddev_pop(f"_r.{c}").alias(f"{c}_std") for c in RATIOS],
    ).first()
    return {c: (stats[f"{c}_mean"] or 0.0, stats[f"{c}_std"] or 1.0) for c in RATIOS}


def scale_features(df: DataFrame, text: str, scaling: dict[str, tuple[float, float]]) -> DataFrame:
    """Add the three ratios as (x - mean) / std."""
    ratios = computed_once(df, "_r", _ratios(df, F.coalesce(F.col(text), F.lit(""))))
    scaled = {c: (F.col(f"_r.{c}") - mean) / std for c, (mean, std) in scaling.items()}
    return ratios.withColumns(scaled).drop("_r")


@dataclass
class FeatureModel:
    """Fitted vocabularies and ratio scaling; turns a text into its ``word | char | ratio`` slots."""

    word: Vocabulary
    char: Vocabulary
    scaling: dict[str, tuple[float, float]]
    options: FeatureOptions = field(default_factory=FeatureOptions)

    @property
    def size(self) -> int:
        return len(self.word.terms) + len(self.char.terms) + len(RATIOS)

    def only(self, block: str) -> FeatureModel:
        """These features without the other block of n-grams; the vocabulary kept is the one fitted."""
        none = Vocabulary([], [])
        return replace(self, **{WORD if block == CHAR else CHAR: none})

    def add_entries(self, df: DataFrame, text: str, in_batches: bool = False) -> DataFrame:
        """Add ``slots`` and ``weights``, the non-zero entries of the assembled vector, row by row or in Arrow batches."""
        n_word, n_terms = len(self.word.terms), len(self.word.terms) + len(self.char.terms)
        if in_batches:
            out = add_weighed_blocks(df, text, {WORD: self.word, CHAR: self.char}, self.options)
        else:
            out = add_tfidf(df, text, WORD, self.word, self.options)
            out = add_tfidf(out, text, CHAR, self.char, self.options)
        out = scale_features(out, text, self.scaling)
        ratio_slots = F.array(*[F.lit(n_terms + i) for i in range(len(RATIOS))])
        return out.select(
            *df.columns,
            F.concat("word_slots", F.transform("char_slots", lambda i: i + n_word), ratio_slots).alias("slots"),
            F.concat("word_weights", "char_weights", F.array(*RATIOS)).alias("weights"),
        )

    def text_scores(self, text: Column, matrix: np.ndarray) -> Column:
        """Scores of a text by the rows of ``matrix``, weights by slot with the intercept as last, in Arrow batches."""
        whole, weighers, forms = F.coalesce(text, F.lit("")), [], []
        for block, vocabulary, first in ((WORD, self.word, 0), (CHAR, self.char, len(self.word.terms))):
            if vocabulary.terms:
                sizes = _sizes(block, self.options)
                weighers.append((grams.Weigher(vocabulary.terms, vocabulary.idf, block == WORD, sizes), first))
                forms.append(CUTS[block](whole))
        ratios = script_ratios(whole)
        score = F.arrow_udf(grams.scored(weighers, matrix, [self.scaling[c] for c in RATIOS]), "array<double>")
        return score(*forms, *[ratios[c] for c in RATIOS])

    def transform(self, docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
        """``keep, features`` as sparse vectors in a written table, for the passes of a fit.

        The vector's stored form is built of columns and read back under the vector type, so no row passes through
        Python; only whole columns of texts do.
        """
        read = [c for c in (*PREPARED.values(), SCRIPTS) if c in docs.columns]
        entries = self.add_entries(docs.select(text, *[c for c in (*keep, *read) if c != text]), text, in_batches=True)
        return self._written(entries, keep)

    def only_entries(self, vectors: DataFrame, block: str, keep: Sequence[str]) -> DataFrame:
        """``keep, features`` as ``only(block)`` has them, from vectors of these features: a block has its own unit length."""
        rows = vectors.select(*keep, F.unwrap_udt("features").alias("_v")).select(*keep, "_v.indices", "_v.values")
        n_word, dropped = len(self.word.terms), len((self.char if block == WORD else self.word).terms)
        # Entries are in order: words, characters, and the ratios at the end.
        words, ratios = F.size(F.filter("indices", lambda i: i < n_word)), F.size("indices") - len(RATIOS)
        first, last = (F.lit(0), words) if block == WORD else (words, ratios)
        own = rows.select("*", first.alias("_first"), (last - first).alias("_n"), ratios.alias("_ratios"))

        def cut(column: str) -> list[Column]:
            return [F.slice(column, F.col("_first") + 1, F.col("_n")), F.slice(column, F.col("_ratios") + 1, len(RATIOS))]

        def moved(slots: Column, moves: bool) -> Column:
            return F.transform(slots, lambda i: i - dropped) if moves else slots

        terms, last_slots = cut("indices")
        entries = own.select(
            *keep,
            F.concat(moved(terms, block == CHAR), moved(last_slots, True)).alias("slots"),
            F.concat(*cut("values")).alias("weights"),
        )
        return self.only(block)._written(entries, keep)

    def _written(self, entries: DataFrame, keep: Sequence[str]) -> DataFrame:
        vector = F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(self.size).alias("size"),
            F.col("slots").alias("indices"),
            F.col("weights").alias("values"),
        )
        schema = StructType([entries.schema[c] for c in keep] + [StructField("features", VectorUDT())])
        return materialize(entries.select(*keep, vector.alias("features")), "features", schema)

    def save(self, spark: SparkSession, path: str) -> None:
        for name, block in ((WORD, self.word), (CHAR, self.char)):
            rows = list(zip(range(len(block.terms)), block.terms, block.idf))
            stored = spark.createDataFrame(rows, "slot int, term string, idf double")
            stored.coalesce(1).write.parquet(f"{path}/{name}_vocabulary")
        scaling = [(c, mean, std) for c, (mean, std) in self.scaling.items()]
        spark.createDataFrame(scaling, "ratio string, mean double, std double").coalesce(1).write.parquet(f"{path}/scaling")
        spark.createDataFrame([asdict(self.options)], OPTIONS_SCHEMA).coalesce(1).write.json(f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        def vocabulary(name: str) -> Vocabulary:
            rows = spark.read.parquet(f"{path}/{name}_vocabulary").orderBy("slot").collect()
            return Vocabulary([row["term"] for row in rows], [row["idf"] for row in rows])

        scaling = {r["ratio"]: (r["mean"], r["std"]) for r in spark.read.parquet(f"{path}/scaling").collect()}
        stored = spark.read.schema(OPTIONS_SCHEMA).json(f"{path}/options").first()
        options = FeatureOptions(
            stored["max_features"], tuple(stored["word_ngrams"]), tuple(stored["char_ngrams"])
        )
        return cls(vocabulary(WORD), vocabulary(CHAR), {c: scaling[c] for c in RATIOS}, options)


OPTIONS_SCHEMA = "max_features long, word_ngrams array<int>, char_ngrams array<int>"


def fit_features(docs: DataFrame, text: str, options: FeatureOptions = FeatureOptions()) -> FeatureModel:
    return FeatureModel(
        fit_vocabulary(docs, text, WORD, options),
        fit_vocabulary(docs, text, CHAR, options),
        fit_ratio_scaling(docs, text),
        options,
    )


def assemble_features(model: FeatureModel, docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return model.transform(docs, text, keep)
