"""Chat messages as a stream: check, normalise, score, tag the script, choose the prompt."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from langweave.functions.text import is_arabizi, normalize_text, prompt_key
from langweave.operators.models import LanguageClassifier, detection
from langweave.operators.turns import check_requests, split_checked
from langweave.scratch import computed_once
from langweave.sources.corpora import path_exists

# Adds an array column ``scores`` of class probabilities to rows with ``text_norm``.
Scorer = Callable[[DataFrame], DataFrame]


def route_messages(accepted: DataFrame, score: Scorer, labels: Sequence[str]) -> DataFrame:
    """Accepted messages with their detection record, prompt key and text; no state, no shuffle of
    its own, so it runs on a batch table and on a stream alike."""
    prepared = computed_once(accepted, "text_norm", normalize_text(F.col("text")))
    scored = score(prepared).withColumn("_d", detection(F.col("scores"), is_arabizi(F.col("text")), labels))
    kept = [c for c in accepted.columns if c != "body"]
    return scored.select(*kept, "text_norm", "_d.*").withColumn("prompt_key", prompt_key(F.col("label"), F.col("script")))


def classifier_scorer(model: LanguageClassifier) -> Scorer:
    """Scores of a fitted classifier, computed inside each row."""
    return lambda rows: model.predict(rows, "text_norm").drop("pred")


COMMIT_SCHEMA = "accepted long, rejected long, run string, batch_id long"


def _write(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").parquet(folder)


def read_committed(spark: SparkSession, path: str, commits: str) -> DataFrame:
    """The rows of a sink that belong to finished batches: both sinks are written and logged in ``commits``.

    The log is a row for each batch; the join with it prunes the folders of other batches. Without a log yet, no rows.
    """
    rows = spark.read.option("basePath", path).parquet(path)
    if not path_exists(spark, commits):
        return rows.limit(0)
    log = spark.read.schema(COMMIT_SCHEMA).option("basePath", commits).parquet(commits)
    return rows.join(log.select("run", "batch_id"), ["run", "batch_id"], "left_semi")


def stream_detect(
    requests: DataFrame,
    score: Scorer,
    labels: Sequence[str],
    accepted_path: str,
    rejected_path: str,
    commits_path: str,
    checkpoint: str,
    body: str = "body",
) -> StreamingQuery:
    """Start a query that routes the accepted requests and writes the rejected ones elsewhere.

    A micro-batch is read and checked once and kept while both parts are written, each to a folder named by checkpoint
    and batch id; then one row in ``commits_path`` says that the batch is whole. ``read_committed`` shows batches that
    have that row, so no reader sees half a batch. A batch repeated after a failure overwrites the folders it had left
    without the row, and one that has it is left alone: every request appears exactly once. A query with another
    checkpoint overwrites nothing. How much a batch takes is set on the source (``maxFilesPerTrigger``).
    """
    run = f"q{hashlib.md5(checkpoint.encode()).hexdigest()}"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark, place = batch.sparkSession, f"run={run}/batch_id={batch_id}"
        # The row's file appears by one rename when its job ends, and so does the mark of that job.
        if path_exists(spark, f"{commits_path}/{place}/_SUCCESS"):
            return
        checked = check_requests(batch, body).persist()
        try:
            accepted, rejected = split_checked(checked, batch.columns)
            _write(route_messages(accepted, score, labels), f"{accepted_path}/{place}")
            _write(rejected, f"{rejected_path}/{place}")
            done = checked.agg(
                F.count("text").alias("accepted"), (F.count("*") - F.count("text")).alias("rejected")
            )
            _write(done.coalesce(1), f"{commits_path}/{place}")
        finally:
            checked.unpersist()

    return (
        requests.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
