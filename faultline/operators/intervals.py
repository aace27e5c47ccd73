"""Rows that lie within a span of time before other rows, by a hash join on time slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.plans.joins import broadcast_if_small

# Events of a slot that one task meets, about; a slot with more is cut into parts.
SLOT_EVENTS = 100_000


def events_within(
    events: DataFrame,
    anchors: DataFrame,
    seconds: int,
    anchor_columns: Sequence[str],
    columns: Sequence[str],
    key: str = "seq",
    slot_events: int = SLOT_EVENTS,
) -> DataFrame:
    """Every event of the last ``seconds`` before each anchor, whatever its incident or service.

    ``events`` and ``anchors`` have a ``timestamp``; events have a ``key`` that tells them apart. An event
    at the anchor's own time is not before it; one exactly ``seconds`` earlier is. Time is cut into slots of that
    width, so the events of an anchor lie in its own slot or the one before: an equi-join on two slots
    per anchor, then a look at the times. A slot with many events is cut into parts by their key, and its anchors are copied
    to each; parts have a bounded size, so no burst meets in one task. Rows without a time match nothing.
    """
    width = seconds * 1_000_000
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    slot = F.floor(F.col("_at") / width)
    timed = events.withColumn("_at", at).filter(F.col("_at").isNotNull()).withColumn("_slot", slot)
    sizes = broadcast_if_small(
        timed.groupBy("_slot")
        .agg(F.ceil(F.count(F.lit(1)) / slot_events).cast("int").alias("_parts"))
        .filter("_parts > 1")
        .withColumnRenamed("_slot", "_full")
    )

    def parted(rows: DataFrame) -> DataFrame:
        joined = rows.join(sizes, F.col("_slot") == F.col("_full"), "left")
        return joined.withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    others = parted(timed).select(
        "_slot",
        F.pmod(F.xxhash64(key), F.col("_parts")).cast("int").alias("_part"),
        F.col("_at").alias("_event_at"),
        *[F.col(c).alias(f"before_{c}") for c in columns],
    )
    placed = anchors.withColumn("_anchor_at", at).filter(F.col("_anchor_at").isNotNull())
    both = F.explode(F.array(F.floor(F.col("_anchor_at") / width) - 1, F.floor(F.col("_anchor_at") / width)))
    asked = parted(placed.select("_anchor_at", *anchor_columns, both.alias("_slot")))
    copied = asked.select(
        "_slot", "_anchor_at", *anchor_columns, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")
    )
    gap = F.col("_anchor_at") - F.col("_event_at")
    return (
        copied.join(others, ["_slot", "_part"])
        .filter(gap.between(1, width))
        .select(*anchor_columns, *[f"before_{c}" for c in columns], (gap / 1e6).alias("seconds_before"))
    )
