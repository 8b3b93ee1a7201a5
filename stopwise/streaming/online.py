"""Incremental runs of the batch operators.

The batched file loop of an ingest becomes a file stream with a checkpoint: new files are picked up,
finished ones are never read again. The policy is a plain aggregate, so it also runs on a stream of
scored prefixes; its state per run is a handful of numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stopwise import fixed
from stopwise.operators import coverage, policy

TRIALS = "trial_id string, trial_name string, task_name string, model string, agent string, reward int, steps string, row_key bigint"


def ingest_trials(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Classify all trial files not seen before and append them, split by reason."""
    rows = spark.readStream.schema(TRIALS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        coverage.classify_usability(rows)
        .writeStream.partitionBy("reason")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .option("compression", "zstd")
        .trigger(availableNow=True)
        .start()
    )


def online_decisions(scored: DataFrame, threshold: float = fixed.PRIMARY_THRESHOLD) -> DataFrame:
    """Current decision of every run on a stream of scored prefixes (update or complete mode)."""
    return policy.apply_stop_policy(scored, threshold=threshold)
