"""Runs of events on a stream, whose state ends: sessions of failures, and rates of keys that fall silent.

A run ends when its key is silent for a gap. Its state is one row per open run and is dropped once the watermark has
passed the end of the gap; the run is written then, and once. Rows later than the watermark are dropped by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.metrics import is_error, is_failure
from faultline.streaming.monitor import SCAN_INTERVAL, _trigger, keep_state_on_disk


def closed_runs(rows: DataFrame, gap: str, late: str, keys: Sequence[str], totals: Sequence[Column]) -> DataFrame:
    """(keys, started_at, ended_at, totals) of each run with no pause as long as ``gap``; rows without a time are left out."""
    timed = rows.filter(F.col("timestamp").isNotNull()).withWatermark("timestamp", late)
    # Runs are merged on the map side first, so a hot key is a few rows per task in the shuffle.
    return (
        timed.groupBy(F.session_window("timestamp", gap).alias("_run"), *keys)
        .agg(F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), *totals)
        .drop("_run")
    )


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", keys: Sequence[str] = ("service",)) -> DataFrame:
    """Error sessions as in the batch, each once it is closed: keys, started_at, ended_at, n_errors."""
    return closed_runs(events.filter(is_failure()), gap, late, keys, [F.count(F.lit(1)).alias("n_errors")])


def ending_rates(events: DataFrame, silence: str = "1 hour", late: str = "1 day", keys: Sequence[str] = ("service",)) -> DataFrame:
    """Error rates over a key's life, which ends when it is silent: keys, started_at, ended_at, n_events, n_errors, error_rate.

    In place of a rate over all history, whose state keeps every key for ever.
    """
    counts = [F.count(F.lit(1)).alias("n_events"), F.count_if(is_error()).alias("n_errors")]
    found = closed_runs(events, silence, late, keys, counts)
    return found.withColumn("error_rate", F.col("n_errors") / F.col("n_events"))


def write_runs(runs: DataFrame, path: str, checkpoint: str, once: bool = False, interval: str = SCAN_INTERVAL) -> StreamingQuery:
    """Append every closed run to a Parquet table, exactly once."""
    keep_state_on_disk(runs.sparkSession)
    return (
        runs.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(once, interval))
        .start()
    )
