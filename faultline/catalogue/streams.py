"""The same tables read as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.catalogue.incidents import as_of
from faultline.catalogue.registry import Tables, log_view, query, second, sql_second, sql_stamp, stamp, with_log
from faultline.operators import timeline
from faultline.session import new_folder
from faultline.sources.growing import file_system, follow_text
from faultline.sources.streams import stream_csv, stream_json_documents, stream_table, stream_text
from faultline.streaming import monitor, runs
from faultline.streaming.lifecycle import alert_changes

# Events in a JSON document or CSV file that a stream finds.
FILE_ROWS = 10_000


def _event_stream(t: Tables) -> DataFrame:
    return log_view(stream_table(t.spark, t.folder, t.events.schema, "events.parquet"))


@query(
    with_log(
        """
SELECT incident_id, n_events, n_errors, round(n_errors / n_events, 6) AS error_rate,
       CASE WHEN n_errors / n_events > 0.25 THEN 'critical' WHEN n_errors / n_events > 0.15 THEN 'high' END AS severity
FROM (SELECT incident_id, count(*) AS n_events, count(*) FILTER (WHERE level = 'ERROR') AS n_errors
      FROM log_events GROUP BY 1)"""
    )
)
def stream_error_rate(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "running")
    rates = monitor.running_rates(_event_stream(t))
    monitor.write_running(rates, path, new_folder(t.spark, "state"), once=True).awaitTermination()
    now = monitor.newest_state(t.spark.read.parquet(path))
    return now.select(
        "incident_id", "n_events", "n_errors", F.round("error_rate", 6).alias("error_rate"), "severity"
    )


@query(
    with_log(
        """
SELECT incident_id, n_events, n_errors, CASE WHEN n_errors / n_events > 0.25 THEN 'critical' ELSE 'high' END AS severity,
       services, concat('Share of errors above the limit: ', printf('%.0f%%', n_errors / n_events * 100)) AS description,
       concat('Begin with ', split_part(services, ', ', 1), ', the first to fail') AS action
FROM (SELECT incident_id, CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(e) AS BIGINT) AS n_errors,
             string_agg(service, ', ' ORDER BY f) FILTER (WHERE e > 0) AS services
      FROM (SELECT strftime(timestamp, '%Y%m%d%H') AS incident_id, service, count(*) AS n,
                   count(*) FILTER (WHERE level = 'ERROR') AS e,
                   min((timestamp, seq)) FILTER (WHERE level = 'ERROR') AS f
            FROM log_events GROUP BY 1, 2)
      GROUP BY 1)
WHERE n_errors / n_events > 0.15"""
    )
)
def stream_running_alerts(t: Tables) -> DataFrame:
    """Whole alerts over all history of a stream, an incident per hour."""
    path = new_folder(t.spark, "breakdown")
    hourly = _event_stream(t).withColumn("incident_id", F.date_format("timestamp", "yyyyMMddHH"))
    monitor.write_breakdown(hourly, path, new_folder(t.spark, "state"), once=True).awaitTermination()
    return monitor.running_alerts(t.spark.read.parquet(path), as_of()).select(
        F.col("incident_id").cast("string").alias("incident_id"),
        "n_events",
        "n_errors",
        "severity",
        F.array_join("affected_services", ", ").alias("services"),
        "description",
        F.get("recommended_actions", F.lit(0)).alias("action"),
    )


@query(
    with_log(
        f"""
SELECT {sql_second("w")} AS window_start, service, n_events, n_errors FROM (
    SELECT time_bucket(INTERVAL '6 hours', timestamp, TIMESTAMP '1970-01-01') AS w, service, count(*) AS n_events,
           count(*) FILTER (WHERE level = 'ERROR') AS n_errors FROM log_events GROUP BY 1, 2)
WHERE w + INTERVAL '6 hours' <= (SELECT max(timestamp) FROM log_events) - INTERVAL '1 day'"""
    )
)
def stream_closed_windows(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "windows")
    monitor.write_windows(
        _event_stream(t), "6 hours", "1 day", path, new_folder(t.spark, "state"), once=True
    ).awaitTermination()
    closed = t.spark.read.parquet(path)
    return closed.select(second("window_start").alias("window_start"), "service", "n_events", "n_errors")


@query(
    with_log(
        f"""
SELECT 'opened' AS change, service, {sql_second("window_start")} AS opened_at, NULL::VARCHAR AS resolved_at
FROM turns WHERE firing
UNION ALL
SELECT 'resolved', service, {sql_second("window_start")}, {sql_second("next_start")}
FROM turns WHERE firing AND next_start IS NOT NULL""",
        """closed AS (
    SELECT * FROM (
        SELECT time_bucket(INTERVAL '6 hours', timestamp, TIMESTAMP '1970-01-01') AS window_start, service,
               count(*) FILTER (WHERE level = 'ERROR') / count(*) > 0.15 AS firing FROM log_events GROUP BY 1, 2)
    WHERE window_start + INTERVAL '6 hours' <= (SELECT max(timestamp) FROM log_events) - INTERVAL '1 day')""",
        """turns AS (
    SELECT service, window_start, firing,
           lead(window_start) OVER (PARTITION BY service ORDER BY window_start) AS next_start
    FROM (SELECT *, coalesce(lag(firing) OVER (PARTITION BY service ORDER BY window_start), false) AS before
          FROM closed) WHERE firing <> before)""",
    )
)
def stream_alert_changes(t: Tables) -> DataFrame:
    windows, out = new_folder(t.spark, "windows"), new_folder(t.spark, "changes")
    monitor.write_windows(
        _event_stream(t), "6 hours", "1 day", windows, new_folder(t.spark, "state"), once=True
    ).awaitTermination()
    closed = stream_table(t.spark, windows, t.spark.read.parquet(windows).schema)
    changes = alert_changes(closed).writeStream.format("parquet").option("path", out)
    changes.option("checkpointLocation", new_folder(t.spark, "state")).trigger(
        availableNow=True
    ).start().awaitTermination()
    return t.spark.read.parquet(out).select(
        "change", "service", second("opened_at").alias("opened_at"), second("resolved_at").alias("resolved_at")
    )


def _runs_sql(where: str, gap: str, totals: str) -> str:
    """Closed runs of a service: with no pause over the gap, and over a day and the gap before the last event."""
    return with_log(
        f"""
SELECT service, {sql_stamp("min(timestamp)")} AS started_at, {sql_stamp("max(timestamp)")} AS ended_at, {totals}
FROM (SELECT *, sum(fresh) OVER (PARTITION BY service ORDER BY timestamp, seq) AS run
      FROM (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY service ORDER BY timestamp, seq)
                                <= INTERVAL '{gap}' THEN 0 ELSE 1 END AS fresh FROM chosen))
GROUP BY service, run
HAVING max(timestamp) + INTERVAL '{gap}' <= (SELECT max(timestamp) FROM chosen) - INTERVAL '1 day'""",
        f"chosen AS (SELECT * FROM log_events WHERE {where})",
    )


def _written_runs(t: Tables, found: DataFrame) -> DataFrame:
    path = new_folder(t.spark, "runs")
    runs.write_runs(found, path, new_folder(t.spark, "state"), once=True).awaitTermination()
    return t.spark.read.parquet(path).withColumns(
        {"started_at": stamp("started_at"), "ended_at": stamp("ended_at")}
    )


@query(_runs_sql("level IN ('ERROR', 'FATAL')", "30 minutes", "count(*) AS n_errors"))
def stream_error_sessions(t: Tables) -> DataFrame:
    """Error sessions of a stream, as far as its watermark has closed them."""
    return _written_runs(t, runs.session_stream(_event_stream(t)))


@query(
    _runs_sql(
        "true", "1 hour", "count(*) AS n_events, count(*) FILTER (WHERE level = 'ERROR') AS n_errors,"
        " round(count(*) FILTER (WHERE level = 'ERROR') / count(*), 6) AS error_rate"
    )
)
def stream_ending_rates(t: Tables) -> DataFrame:
    """Error rates of services, each from when it is heard of until it is silent for an hour."""
    return _written_runs(t, runs.ending_rates(_event_stream(t))).withColumn("error_rate", F.round("error_rate", 6))


@query(
    with_log(
        """
SELECT concat('level ', level) AS what, count(*) AS n FROM log_events GROUP BY 1
UNION ALL SELECT 'scan success', count(*) FROM log_events"""
    )
)
def stream_text_scan(t: Tables) -> DataFrame:
    """Text logs arrive in a folder, are scanned once, and leave events and a scan row."""
    logs, out = new_folder(t.spark, "logs"), new_folder(t.spark, "scans")
    line = F.concat(second("timestamp"), F.lit(" "), "level", F.lit(" "), "service", F.lit(": "), "message")
    t.log_events.select(F.regexp_replace(line, "error by", "fault by")).write.text(logs)
    raw = stream_text(t.spark, logs)
    scans = monitor.monitor(
        raw, lambda rows: timeline.to_events(rows, as_of()), out, new_folder(t.spark, "state"), once=True
    )
    scans.awaitTermination()
    read = t.spark.read
    events = read.parquet(f"{out}/events").groupBy(F.concat(F.lit("level "), "level").alias("what"))
    bad = read.parquet(f"{out}/quarantine").groupBy(F.concat(F.lit("bad "), "reason").alias("what"))
    scanned = read.parquet(f"{out}/scans").groupBy(F.concat(F.lit("scan "), "status").alias("what"))
    n = F.count(F.lit(1)).alias("n")
    return events.agg(n).unionByName(bad.agg(n)).unionByName(
        scanned.agg(F.sum("events_processed").alias("n"))
    )


def _landed_json_and_csv(t: Tables) -> DataFrame:
    """(kind, timestamp, level, service, message) of the events that the two streams land."""
    logs, out = new_folder(t.spark, "logs"), new_folder(t.spark, "scans")
    rows = t.log_events.select(second("timestamp").alias("timestamp"), "level", "service", "message")
    # Every other event has its time in seconds, as a number.
    seconds = F.unix_timestamp("timestamp").cast("string")
    timed = rows.withColumn("timestamp", F.when(F.col("level") == "INFO", seconds).otherwise(F.col("timestamp")))
    rows.write.option("maxRecordsPerFile", FILE_ROWS).json(f"{logs}/json")
    timed.write.option("maxRecordsPerFile", FILE_ROWS).option("header", True).csv(f"{logs}/csv")
    streams = {
        "json": stream_json_documents(t.spark, f"{logs}/json"),
        "csv": stream_csv(t.spark, f"{logs}/csv", "timestamp,level,service,message"),
    }
    found = []
    for kind, raw in streams.items():
        monitor.monitor(
            raw, lambda r: timeline.to_events(r, as_of()), f"{out}/{kind}", new_folder(t.spark, "state"), once=True
        ).awaitTermination()
        events = t.spark.read.parquet(f"{out}/{kind}/events")
        found.append(
            events.select(F.lit(kind).alias("kind"), second("timestamp").alias("timestamp"), "level", "service", "message")
        )
    return found[0].unionByName(found[1])


@query(
    with_log(
        f"""
SELECT kind, {sql_second("timestamp")} AS timestamp, level, service, message
FROM log_events, (VALUES ('json'), ('csv')) k(kind)"""
    )
)
def stream_json_and_csv(t: Tables) -> DataFrame:
    """All events arrive as JSON documents and as CSV files, and are scanned by two streams."""
    return _landed_json_and_csv(t)


# Triggers between which the logs of stream_growing_files grow.
GROWTHS = 3


def _grow_logs(t: Tables, folder: str, step: int) -> None:
    """One log per day, as far as it is written by a step; but for the last, a step ends in the middle of a line."""
    line = F.concat(second("timestamp"), F.lit(" "), "level", F.lit(" "), "service", F.lit(": #"), F.col("seq").cast("string"), F.lit("\n"))
    third = F.floor(F.hour("timestamp") / (24 / GROWTHS)).cast("int") + 1
    lines = t.log_events.select("incident_id", "seq", line.alias("line"), third.alias("step"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of a day follow each other by step; a repeated task writes the same files anew."""
        system, root = file_system(folder)
        day, out, cut = None, None, False

        def close() -> None:
            out.close()
            system.move(f"{root}/{day}.new", f"{root}/{day}.log")

        for batch in batches:
            days = batch.column(0).dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero(days[1:] != days[:-1]) + 1), batch.num_rows]
            texts = batch.column(2).cast(pa.large_string())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = memoryview(texts.buffers()[2])
            dues = batch.column(3).to_numpy()
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                own = batch.column(0)[int(first)].as_py()
                if own != day:
                    if out:
                        close()
                    day, out, cut = own, system.open_output_stream(f"{root}/{own}.new"), False
                # Lines lie end to end, those of this step and the ones before it in front.
                here = first + int((dues[first:last] <= step).sum())
                out.write(data[ends[first] : ends[here]])
                if here < last and not cut:
                    out.write(data[ends[here] : (ends[here] + ends[here + 1]) // 2])
                    cut = True
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([0])], names=["done"])

    # By step first: a line of a later step must not stand between those of this one.
    ordered = lines.repartition("incident_id").sortWithinPartitions("incident_id", "step", "seq")
    ordered.mapInArrow(write, "done long").agg(F.count("done")).collect()


@query(
    with_log(
        f"""
SELECT seq, {sql_second("timestamp")} AS timestamp, level,
       concat({sql_second("timestamp")}, ' ', level, ' ', service, ': #', seq) AS message
FROM log_events"""
    )
)
def stream_growing_files(t: Tables) -> DataFrame:
    """Logs grow between three triggers, mostly in the middle of a line; each line is scanned once."""
    logs, out, state = (new_folder(t.spark, n) for n in ("growing", "scans", "state"))
    t.spark.createDataFrame([], "none string").write.parquet(logs)
    for step in range(1, GROWTHS + 1):
        _grow_logs(t, logs, step)
        raw = follow_text(t.spark, logs, split_bytes=1 << 16)
        monitor.monitor(raw, lambda r: timeline.to_events(r, as_of()), out, state, once=True).awaitTermination()
    events = t.spark.read.parquet(f"{out}/events")
    return events.select(
        F.regexp_extract("message", r"#(\d+)$", 1).cast("long").alias("seq"),
        second("timestamp").alias("timestamp"),
        "level",
        "message",
    )
