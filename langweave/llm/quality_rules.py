"""Quality rules: countable faults, then a hashed n-gram log-likelihood ratio of trusted text against the corpus.

Word 1- and 2-grams of every document are hashed into a fixed number of buckets. Two multinomials over the buckets are
estimated: one from trusted documents, one from the whole corpus. A document's ratio is the mean over its n-grams of
log p_trusted - log p_corpus; it is kept if the ratio reaches the cut-off and no rule fails.

Labels may be few or cover languages unevenly. The trusted multinomial is therefore estimated per language, smoothed
towards that language's corpus, and mixed by the languages' shares of the corpus: a language without labels has a
ratio near zero, and a half-labelled one loses nothing. The cut-off is taken from trusted documents judged by weights
estimated without them, so that it holds for good documents that nobody labelled.

Everything is a native expression inside the row; the only shuffle is that of the bucket counts, which partial
aggregation bounds by ``buckets`` rows a language and task. The weights reach the tasks as one constant.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from langweave.llm.columns import bound, flattened, joined_hashes, unclashed, whole, words
from langweave.scratch import computed_once, materialize, small_side

BUCKETS = 1 << 14
# N-grams of corpus text mixed into the trusted text of each language.
PRIOR_GRAMS = 10_000
# Trusted documents are dealt to so many folds; each is judged by weights that the other folds give.
FOLDS = 4
# The share of unseen good documents that may lie under the cut-off, and how far below that quantile the cut-off is: so
# many times the way from the median to it, divided by the root of the count. With fewer documents only rules judge.
LOST_SHARE = 0.002
MARGIN = 2.0
MIN_CALIBRATION = 20
# With so many bad documents the cut-off may rise up to this share of lost good ones, each share of them counting as
# much as so many of kept bad ones.
MIN_BAD = 5
MOST_LOST_SHARE = 0.02
LOST_WEIGHT = 5
# Labelled ids go to the documents while they are no more than these (some 32 MB); beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

COUNT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(hashes: Column) -> Column:
    return F.size(F.array_distinct(hashes)) < F.size(hashes)


def _repeated_words(windows: Column) -> Column:
    """How many words lie in windows that occur twice or more; ``windows`` holds the hash of the window at each word."""

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0), lambda total, x: total + x)

    def repeated_starts(ordered: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            return F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
                F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)
            )

        return F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["at"]))

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(_repeats(windows), bound(ordered, lambda o: bound(repeated_starts(o), covered))).otherwise(F.lit(0))


def with_ngrams(docs: DataFrame, text: str = "text", split: Column | None = None) -> DataFrame:
    """Add the hashes ``_grams1`` and ``_grams2`` of the words (given, or those of the text) and word pairs."""
    found = words(whole(text)) if split is None else split
    docs = computed_once(docs, "_grams1", F.transform(found, lambda w: F.xxhash64(w)))
    return computed_once(docs, "_grams2", joined_hashes(F.col("_grams1"), 1))


def rule_counts(text: str = "text") -> list[Column]:
    """The counts of the rules, over the columns of ``with_ngrams``."""
    lines = F.filter(F.split(whole(text), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    blank = F.replace(flattened(whole(text)), F.lit(" "), F.lit(""))
    # Windows of eight words from pairs, by way of windows of four: most documents repeat none of these.
    repeated = bound(
        joined_hashes(F.col("_grams2"), 2),
        lambda four: F.when(_repeats(four), bound(joined_hashes(four, 4), _repeated_words)).otherwise(F.lit(0)),
    )
    return [
        F.size("_grams1").cast("long").alias("n_words"),
        F.length(blank).cast("long").alias("word_chars"),
        F.regexp_count(whole(text), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
    ]


def trusted_ids(labels: DataFrame, quality: int = 1) -> DataFrame:
    """Ids of all documents labelled good (or of another quality), each once."""
    good = labels.filter((F.col("quality") == quality) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct()


def _language(docs: DataFrame) -> Column:
    """The document's language; nulls are one, and so are all documents without the column."""
    name = next((c for c in docs.columns if c.lower() == "lang"), None)
    return F.lit("") if name is None else F.coalesce(F.col(name).cast("string"), F.lit(""))


def _fold(text: str) -> Column:
    """Copies of a text share a fold, so that none is judged by the other."""
    return F.pmod(F.xxhash64(whole(text), F.lit(FOLDS)), F.lit(FOLDS)).cast("int")


def bucket_weights(docs: DataFrame, trusted: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row: ``weights``, log p_trusted - log p_corpus of every bucket, and ``fold_weights``, the same without the
    trusted documents of each fold, one fold after the other.

    Without any n-gram of a trusted document all weights are zero. All of ``trusted`` and every language count; both
    meet the documents by plain joins where they are not small.
    """
    marked = docs.select("doc_id", text, _language(docs).alias("_stratum")).join(
        small_side(trusted.withColumn("_trusted", F.lit(1)), BROADCAST_IDS), "doc_id", "left"
    )
    marked = marked.withColumn("_fold", F.when(F.col("_trusted") == 1, _fold(text)))
    grams = with_ngrams(marked, text).select(
        "_stratum", "_fold", F.explode(F.concat("_grams1", "_grams2")).alias("_gram")
    )
    held = [f"held{k}" for k in range(FOLDS)]
    counts = grams.groupBy("_stratum", F.pmod("_gram", F.lit(buckets)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("corpus"),
        F.count("_fold").alias("trusted"),
        *[F.count(F.when(F.col("_fold") == k, 1)).alias(name) for k, name in enumerate(held)],
    )
    counts = materialize(counts, "bucket-counts")
    summed = ["corpus", "trusted", *held]
    totals = counts.groupBy("_stratum").agg(*[F.sum(c).alias(f"{c}_all") for c in summed])
    cells = counts.join(small_side(totals), "_stratum")

    def mixed(seen: Column, seen_all: Column) -> Column:
        """The bucket's expected n-grams if trusted text had as many of the language as the corpus has."""
        prior = PRIOR_GRAMS * F.col("corpus") / F.col("corpus_all")
        return F.sum(F.col("corpus_all") * (seen + prior) / (seen_all + PRIOR_GRAMS))

    variants = {"weights": mixed(F.col("trusted"), F.col("trusted_all"))} | {
        f"without{k}": mixed(F.col("trusted") - F.col(c), F.col("trusted_all") - F.col(f"{c}_all"))
        for k, c in enumerate(held)
    }
    weights = cells.groupBy("bucket").agg(F.sum("corpus").alias("corpus"), *[v.alias(k) for k, v in variants.items()])
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(weights, "bucket", "left")
    # Rounded so that verdicts don't hang on the last digit of a logarithm; a bucket that no text has weighs nothing.
    rounded = [F.coalesce(F.round(F.log(F.col(k) / F.col("corpus")), 6), F.lit(0.0)).alias(k) for k in variants]
    row = every.select("bucket", *rounded).agg(F.array_sort(F.collect_list(F.struct("bucket", *variants))).alias("cells"))
    return row.select(
        F.col("cells.weights").alias("weights"),
        F.concat(*[F.col(f"cells.without{k}") for k in range(FOLDS)]).alias("fold_weights"),
    )


def _constant(weights: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(weights)), "array<double>")


def _mean_weight(weights: Column, buckets: int, first: Column | None = None) -> Column:
    """The mean weight of the n-grams of ``with_ngrams``, 0 without any; ``first`` is the place of bucket 0."""
    total = F.lit(0.0)
    for grams in ("_grams1", "_grams2"):
        place = lambda g: F.pmod(g, F.lit(buckets)).cast("int") + (F.lit(0) if first is None else first)
        total = F.aggregate(grams, total, lambda s, g: s + F.get(weights, place(g)))
    return F.when(F.size("_grams1") == 0, F.lit(0.0)).otherwise(total / (F.size("_grams1") + F.size("_grams2")))


def least_costly(window: list[tuple[int, float, int]], cut: float, n_good: int, n_bad: int) -> float:
    """The cut-off from ``cut`` upwards that loses few good and keeps few bad documents, the lower of equal ones.

    ``window`` has quality, ratio and count of the labelled documents between ``cut`` and the highest cut-off.
    """
    ratios = sorted({ratio for _, ratio, _ in window})
    best, lowest_cost, cost = cut, 0.0, 0.0
    for ratio, above in zip(ratios, ratios[1:]):
        for quality, _, count in (x for x in window if x[1] == ratio):
            cost += LOST_WEIGHT * count / n_good if quality == 1 else -count / n_bad
        if cost < lowest_cost:
            best, lowest_cost = (ratio + above) / 2, cost
    return best


def cut_off(docs: DataFrame, judged: DataFrame, model: Row, text: str, buckets: int) -> float | None:
    """The ratio under which hardly any unseen good document lies; none with too few of them to tell.

    ``judged`` holds ids and ``quality``. Good documents are judged without their fold, bad ones are in none.
    """
    fold = F.when(F.col("quality") == 1, _fold(text)).otherwise(F.lit(FOLDS))
    seen = docs.select("doc_id", text).join(small_side(judged, BROADCAST_IDS), "doc_id").withColumn("_fold", fold)
    grams = with_ngrams(seen, text).filter(F.size("_grams1") >= MIN_WORDS)
    ratio = _mean_weight(_constant(model["fold_weights"] + model["weights"]), buckets, F.col("_fold") * buckets)
    # Rounded ratios have few values, so their counts are a small table and the percentile is exact.
    ratios = grams.select("quality", F.round(ratio, 4).alias("ratio")).groupBy("quality", "ratio").count()
    ratios = materialize(ratios, "labelled-ratios")
    shares = F.array(F.lit(LOST_SHARE), F.lit(MOST_LOST_SHARE), F.lit(0.5))
    counted = {q: F.coalesce(F.sum(F.when(F.col("quality") == q, F.col("count"))), F.lit(0)) for q in (0, 1)}
    good = F.when(F.col("quality") == 1, F.col("ratio"))
    n_good, n_bad, at = ratios.agg(counted[1], counted[0], F.percentile(good, shares, F.col("count"))).first()
    if n_good < MIN_CALIBRATION:
        return None
    lowest, highest, middle = at
    cut = lowest - MARGIN * (middle - lowest) / n_good**0.5
    if n_bad < MIN_BAD:
        return cut
    window = ratios.filter(F.col("ratio").between(cut, highest)).select("quality", "ratio", "count").collect()
    return least_costly([tuple(r) for r in window], cut, n_good, n_bad)


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    buckets: int = BUCKETS,
    min_ratio: float | None = None,
) -> DataFrame:
    """Judge every document: its columns and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``,
    ``base_failed``, ``ratio`` (mean log-likelihood ratio, 0 without words) and ``kept``.

    A null text has no words and fails. A null label or id trusts nothing; a null doc_id is judged like any other.
    Repeated rows are judged alike, and both count towards the corpus. Without trusted documents every ratio is 0.
    Unless ``min_ratio`` is given, the cut-off is that of ``cut_off``; with too few trusted documents for one, only the
    rules judge. ``lang`` is read where there is such a column. Empty tables give an empty result. Columns of ``docs`` named like an added one are replaced.
    """
    added = (*COUNT_COLUMNS, "base_failed", "ratio", "kept")
    docs = unclashed(docs, *added, "_grams1", "_grams2", "_trusted", "_facts", "_fold", "_stratum")
    trusted = materialize(trusted_ids(labels), "trusted-ids")
    model = bucket_weights(docs, trusted, text, buckets).first()
    least = min_ratio
    if least is None:
        bad = trusted_ids(labels, 0).join(trusted, "doc_id", "left_anti")
        judged = trusted.withColumn("quality", F.lit(1)).unionByName(bad.withColumn("quality", F.lit(0)))
        least = cut_off(docs, judged, model, text, buckets)
    alike = F.lit(True) if least is None else F.col("_facts.ratio") >= least
    ratio = _mean_weight(_constant(model["weights"]), buckets)
    facts = F.struct(*rule_counts(text), ratio.alias("ratio"))
    judged = computed_once(with_ngrams(docs, text), "_facts", facts)
    failed = (F.col("_facts.n_words") < MIN_WORDS) | (
        100 * F.col("_facts.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_facts.n_words")
    )
    return judged.select(
        *docs.columns,
        *[F.col(f"_facts.{c}").alias(c) for c in COUNT_COLUMNS],
        failed.alias("base_failed"),
        F.col("_facts.ratio").alias("ratio"),
        (~failed & alike).alias("kept"),
    )
