"""Append-only tables and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def save_reports(reports: DataFrame, path: str, kind: str = "markdown") -> str:
    """Write reports below ``path``, a folder per incident and part; returns the path used.

    A rerun replaces the incidents it writes and leaves the others. JSON reports always end
    up below a path that ends in ``.json``.
    """
    if kind.lower() == "json" and not path.endswith(".json"):
        path = path.rsplit(".", 1)[0] + ".json"
    places = [c for c in ("incident_id", "part") if c in reports.columns]
    rows = reports.select(*places, "report")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*places).text(path)
    return path


def audit_entries(
    df: DataFrame, action: str, outcome: Column, at: Column, context: dict[str, Column] | None = None
) -> DataFrame:
    """One audit entry per row of ``df``."""
    pairs = [part for k, v in (context or {}).items() for part in (F.lit(k), v.cast("string"))]
    return df.select(
        at.alias("timestamp"),
        F.lit(action).alias("action"),
        F.create_map(*pairs).cast("map<string,string>").alias("user_context"),
        outcome.alias("outcome"),
    )


def append_audit(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def append_outbox(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("kind").json(path)


def land_events(events: DataFrame, path: str) -> None:
    """Write events as Parquet by day, so that later reads prune and push down."""
    (
        events.withColumn("day", F.to_date("timestamp"))
        .repartitionByRange("day", "incident_id", "timestamp")
        .write.mode("append")
        .partitionBy("day")
        .parquet(path)
    )
