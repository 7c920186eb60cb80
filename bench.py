"""Time the headline queries over whole tables; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores. Each given table is one file of
one row group, which a single task must read; before the clock starts, the tables are stored in several files, as a
corpus on a cluster is.
"""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from workloads import queries  # noqa: E402
from workloads.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count()))
HEADLINE = (
    "normalize_text",
    "is_valid_text",
    "is_arabizi",
    "script_ratios",
    "row_funnel",
    "source_counts",
    "assign_ids",
    "sample_exact",
    "stratified_split",
    "union_sources",
    "word_ngrams",
    "char_wb_ngrams",
    "vocab_topk",
    "tfidf_word",
    "tfidf_char",
    "scale_features",
    "assemble_features",
    "score_linear",
    "detection_record",
    "classification_report",
    "validate_requests",
    "build_generation_requests",
    "assemble_turns",
    "stream_detect",
    "turn_timings",
    "external_model",
    "train_linear_svm",
    "train_softmax",
    "compare_models",
    "detect",
)


TABLES = ("documents", "conversations", "embeddings", "events", "labels", "benchmark", "pages")


def spread(spark: SparkSession) -> str:
    """The given tables with the same rows in a few files for each core; returns their folder."""
    folder = tempfile.mkdtemp(prefix="langweave-tables-")
    for name in TABLES:
        path = f"{SF_DIR}/{name}.parquet"
        if os.path.exists(path):
            spark.read.parquet(path).repartition(2 * CPUS).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("langweave-bench")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="langweave-shared-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = spread(spark)
    seconds = {}
    # Preparing and fitting are timed apart, so that the queries below time scoring with a model at hand.
    for name, build in (("prepare_training", queries._tables), ("fit_softmax", queries._softmax)):
        start = time.perf_counter()
        build(spark, folder)
        seconds[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        # The noop sink computes every column of every row and stores none.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
