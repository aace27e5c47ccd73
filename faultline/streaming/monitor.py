"""The scan cycle: one micro-batch is one scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.alerts import (
    alert_severity,
    alerts_of_breakdown,
    error_rate_alerts,
    service_breakdown,
)
from faultline.operators.metrics import error_stats
from faultline.operators.timeline import quarantined
from faultline.operators.trends import windowed_rates
from faultline.schema import ERROR_RATE_ALERT, ERROR_RATE_CRITICAL

SCAN_INTERVAL = "30 seconds"


_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Use the RocksDB state store, whose state may outgrow the memory of executors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS_DB)


def _trigger(once: bool, interval: str) -> dict:
    return {"availableNow": True} if once else {"processingTime": interval}


def running_rates(events: DataFrame, keys: Sequence[str] = ("incident_id",)) -> DataFrame:
    """Error rate over all history so far; one row of state per key."""
    return error_stats(events, keys)


def write_running(
    rates: DataFrame,
    path: str,
    checkpoint: str,
    once: bool = False,
    interval: str = SCAN_INTERVAL,
    high: float = ERROR_RATE_ALERT,
    critical: float = ERROR_RATE_CRITICAL,
) -> StreamingQuery:
    """Write the changed rows of every scan, with severity and scan number.

    Rows of one scan are a folder of their own, which a retry replaces whole; the
    newest scan of a key is its present state.
    """

    keep_state_on_disk(rates.sparkSession)

    def scan(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("severity", alert_severity(F.col("error_rate"), high, critical))
            .write.mode("overwrite")
            .parquet(f"{path}/scan_number={batch_id + 1}")
        )

    return (
        rates.writeStream.outputMode("update")
        .foreachBatch(scan)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(once, interval))
        .start()
    )


def write_breakdown(
    events: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = ("incident_id",),
    order: Sequence[str] = ("timestamp", "seq"),
    once: bool = False,
    interval: str = SCAN_INTERVAL,
) -> StreamingQuery:
    """Write the changed counts per key and service of every scan: the state behind full alerts."""
    keep_state_on_disk(events.sparkSession)

    def scan(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/scan_number={batch_id + 1}")

    return (
        service_breakdown(events, keys, order)
        .writeStream.outputMode("update")
        .foreachBatch(scan)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(once, interval))
        .start()
    )


def running_alerts(
    written: DataFrame, detected_at: Column, keys: Sequence[str] = ("incident_id",)
) -> DataFrame:
    """Full alert rows over all history so far, from what :func:`write_breakdown` wrote."""
    # A missing service is a service of its own here, as in the batch.
    return alerts_of_breakdown(newest_state(written, [*keys, "service"]), detected_at, keys)


def newest_state(written: DataFrame, keys: Sequence[str] = ("incident_id",)) -> DataFrame:
    """The present row of every key from what :func:`write_running` wrote."""
    values = [c for c in written.columns if c not in keys]
    newest = F.max_by(F.struct(*values), "scan_number").alias("_row")
    return written.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def monitor(
    raw: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    scan_time: Column | None = None,
    once: bool = False,
    interval: str = SCAN_INTERVAL,
) -> StreamingQuery:
    """Scan what arrived since the last cycle: scans, alerts, events and bad rows.

    ``prepare`` makes events of raw rows. Bad rows go to quarantine and do not
    stop the loop; a failing batch does, after its scan row says ``error: …``, and a repeat of
    the batch replaces that row. Without new files there is no batch: see :func:`idle_scan`.
    """
    now = scan_time if scan_time is not None else F.current_timestamp()
    # Lines of a stream have no number; equal times are put in order by their text.
    order = ["timestamp", "source_file", "message"]

    def scan(batch: DataFrame, batch_id: int) -> None:
        def save(rows: DataFrame, name: str) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/{name}/scan_number={batch_id + 1}")

        batch = batch.persist()
        try:
            process(batch, batch_id, save)
        except Exception as error:
            save(scan_row(batch.sparkSession, f"error: {type(error).__name__}").withColumn("scan_time", now), "scans")
            raise
        finally:
            batch.unpersist()

    def process(batch: DataFrame, batch_id: int, save: Callable[[DataFrame, str], None]) -> None:
        events = prepare(batch)
        save(quarantined(batch), "quarantine")
        save(events, "events")
        # Read back as written: the texts are not read once more for the alerts and again for the counts.
        events = batch.sparkSession.read.schema(events.schema).parquet(f"{path}/events/scan_number={batch_id + 1}")
        alerts = error_rate_alerts(events, now, order=order).persist()
        save(alerts, "alerts")
        counts = events.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("events")).unionByName(
            alerts.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("alerts"))
        )
        summary = counts.agg(
            F.sum(F.when(F.col("kind") == "events", F.col("n"))).alias("events_processed"),
            F.sum(F.when(F.col("kind") == "alerts", F.col("n"))).alias("n_trends"),
        )
        status = F.when(F.col("events_processed") == 0, "no_data").otherwise("success")
        save(summary.withColumns({"scan_time": now, "status": status}), "scans")
        alerts.unpersist()

    return (
        raw.writeStream.foreachBatch(scan)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(once, interval))
        .start()
    )


def scan_row(spark: SparkSession, status: str) -> DataFrame:
    """The scan row of a cycle that processed nothing."""
    return spark.createDataFrame([(0, 0, status)], "events_processed long, n_trends long, status string")


def idle_scan(spark: SparkSession, path: str, label: str, scan_time: Column | None = None) -> None:
    """The scan row of a cycle that found no new files, below the scans of :func:`monitor`.

    A stream runs no batch then; whoever starts the cycles calls this, with a ``label`` of its
    own for each, and a repeated call replaces its row.
    """
    now = scan_time if scan_time is not None else F.current_timestamp()
    row = scan_row(spark, "no_data").withColumn("scan_time", now)
    row.write.mode("overwrite").parquet(f"{path}/scans/idle={label}")


def write_windows(
    events: DataFrame,
    width: str,
    late: str,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = ("service",),
    once: bool = False,
    interval: str = SCAN_INTERVAL,
) -> StreamingQuery:
    """Windowed error rates, each written once when the watermark has closed it."""
    keep_state_on_disk(events.sparkSession)
    return (
        windowed_rates(events, width, keys, late=late)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(once, interval))
        .start()
    )
