"""The event timeline: raw rows to events, redacted, merged and ordered."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.levels import level_by_priority
from faultline.functions.normalize import (
    event_level,
    event_message,
    event_metadata,
    event_service,
    with_event_time,
)
from faultline.functions.redact import redact_metadata, with_redacted
from faultline.functions.timestamps import find_timestamp
from faultline.plans.ranking import exact_row_number
from faultline.session import require_utc
from faultline.sources.files import raw_rows

# The total order of a timeline within one incident.
ORDER = ["timestamp", "source_file", "line_number"]


def to_events(
    raw: DataFrame,
    as_of: Column,
    incident_id: Column | None = None,
    strict_redaction: bool = False,
    redact_extras: bool = False,
) -> DataFrame:
    """Raw rows as events of the fixed schema.

    ``as_of`` stands in for a missing or unreadable time; such rows are flagged.
    By default every source file is an incident of its own.
    """
    require_utc(raw.sparkSession)
    fields, line = F.col("fields"), F.col("line")
    is_text = line.isNotNull()
    metadata = F.coalesce(event_metadata(fields), F.create_map().cast("map<string,string>"))
    if redact_extras:
        metadata = redact_metadata(metadata, strict_redaction)
    timed = with_event_time(raw.filter(F.col("reason").isNull()), "_field_time")
    read = timed.select(
        (incident_id if incident_id is not None else F.col("source_file")).alias("incident_id"),
        F.when(is_text, find_timestamp(line))
        .otherwise(F.col("_field_time"))
        .alias("_time"),
        F.when(is_text, F.coalesce(level_by_priority(line), F.lit("INFO")))
        .otherwise(event_level(fields))
        .alias("level"),
        F.when(is_text, "unknown").otherwise(event_service(fields)).alias("service"),
        F.when(is_text, line).otherwise(event_message(fields)).alias("_message"),
        "source_file",
        "line_number",
        metadata.alias("metadata"),
    )
    return with_redacted(read, "_message", "message", strict_redaction).select(
        "incident_id",
        F.coalesce("_time", as_of).alias("timestamp"),
        "level",
        "service",
        "message",
        "source_file",
        "line_number",
        "metadata",
        F.col("_time").isNull().alias("ts_inferred"),
    )


def quarantined(raw: DataFrame) -> DataFrame:
    """Rows that could not be read, with the reason."""
    return raw.filter(F.col("reason").isNotNull()).select(
        "source_file", "line_number", "raw", "reason"
    )


def read_timeline(
    spark: SparkSession,
    paths: Sequence[str],
    as_of: Column,
    incident_id: Column | None = None,
    **options: bool,
) -> DataFrame:
    """Events of all files below ``paths``."""
    return to_events(raw_rows(spark, paths, **options), as_of, incident_id)


def merge(parts: Sequence[DataFrame]) -> DataFrame:
    """Events of several sources in one table; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sorted_timeline(events: DataFrame, order: Sequence[str] = tuple(ORDER)) -> DataFrame:
    """Events with ``seq``, their place in their incident, from 1."""
    return exact_row_number(events, ["incident_id"], list(order), "seq")


def for_writing(events: DataFrame, order: Sequence[str] = tuple(ORDER)) -> DataFrame:
    """Events range-partitioned and sorted, for a sink that keeps global order."""
    keys = ["incident_id", *order]
    return events.repartitionByRange(*keys).sortWithinPartitions(*keys)
