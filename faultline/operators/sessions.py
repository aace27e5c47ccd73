"""Runs of errors, and what happened before an event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.metrics import ORDER, is_failure
from faultline.plans.ranking import rows_before


def error_sessions(
    events: DataFrame, gap_minutes: int = 30, keys: Sequence[str] = ("service",)
) -> DataFrame:
    """Runs of failures in which no pause is longer than the gap.

    Failures within one slot of the gap's width always belong together, so they
    are first reduced to one row per key and slot, on the map side. What is left
    to order per key depends on the time span, not on the number of events.
    """
    gap = gap_minutes * 60 * 1_000_000
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    slots = (
        events.filter(is_failure())
        .withColumn("_at", at)
        .groupBy(*keys, (F.col("_at") - F.pmod("_at", F.lit(gap))).alias("_slot"))
        .agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.count(F.lit(1)).alias("_n"))
    )
    in_time = Window.partitionBy(*keys).orderBy("_slot")
    starts = F.coalesce(F.col("_from") - F.lag("_to").over(in_time) > gap, F.lit(True))
    return (
        slots.withColumn("session", F.sum(starts.cast("long")).over(in_time))
        .groupBy(*keys, "session")
        .agg(
            F.timestamp_micros(F.min("_from")).alias("started_at"),
            F.timestamp_micros(F.max("_to")).alias("ended_at"),
            F.sum("_n").alias("n_errors"),
        )
    )


def events_before(
    events: DataFrame,
    anchors_when,
    n: int,
    columns: Sequence[str] = ("timestamp", "level", "service", "message"),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """The ``n`` events that precede each anchor event in its incident."""
    return rows_before(events, ["incident_id"], list(order), anchors_when, n, columns)
