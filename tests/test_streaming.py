from pyspark.sql import functions as F

from faultline.operators import metrics, timeline, trends
from faultline.sinks import tables as sinks
from faultline.sources.streams import (
    stream_csv,
    stream_json_documents,
    stream_json_lines,
    stream_table,
    stream_text,
)
from faultline.streaming import monitor


def as_of():
    return F.lit("2030-01-01").cast("timestamp")


def test_running_rates_follow_the_files(spark, make_events, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = make_events([("i", n, "ERROR" if n < 2 else "INFO", "s", "m") for n in range(10)])
    second = make_events([("i", n, "ERROR", "s", "m") for n in range(10, 20)] + [("j", 5, "INFO", "s", "m")])
    for batch in (first, second):
        batch.write.mode("append").parquet(source)
        stream = stream_table(spark, source, first.schema)
        monitor.write_running(monitor.running_rates(stream), out, state, once=True).awaitTermination()
    written = spark.read.parquet(out)
    assert {r.scan_number for r in written.select("scan_number").distinct().collect()} == {1, 2}
    found = {r.incident_id: (r.n_events, r.n_errors, r.severity) for r in monitor.newest_state(written).collect()}
    assert found == {"i": (20, 12, "critical"), "j": (1, 0, None)}
    batch = {r.incident_id: r.error_rate for r in metrics.error_stats(first.unionByName(second)).collect()}
    assert batch == {r.incident_id: r.error_rate for r in monitor.newest_state(written).collect()}


def test_closed_windows_equal_batch(spark, make_events, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = make_events([("i", n * 60, "ERROR" if n % 4 == 0 else "INFO", f"s{n % 3}", "m") for n in range(200)])
    events.write.parquet(source)
    stream = stream_table(spark, source, events.schema)
    monitor.write_windows(stream, "5 minutes", "10 minutes", out, state, once=True).awaitTermination()
    closed = {tuple(r) for r in spark.read.parquet(out).select("window_start", "service", "n_events", "n_errors").collect()}
    batch = trends.windowed_rates(events, "5 minutes")
    last = events.agg(F.max("timestamp")).first()[0]
    done = batch.filter(F.col("window_start") + F.expr("interval 15 minutes") <= F.lit(last))
    assert closed == {tuple(r) for r in done.select("window_start", "service", "n_events", "n_errors").collect()}


def test_text_scan_cycles(spark, tmp_path):
    logs, out, state = (tmp_path / n for n in ("logs", "out", "state"))
    logs.mkdir()

    def scan():
        raw = stream_text(spark, str(logs))
        monitor.monitor(raw, lambda rows: timeline.to_events(rows, as_of()), str(out), str(state), once=True).awaitTermination()

    (logs / "a.log").write_text("2024-01-15 10:30:00 ERROR x a@b.co\n\nplain")
    scan()
    (logs / "b.log").write_text("   \n")
    scan()
    scans = {r.scan_number: (r.status, r.events_processed, r.n_trends) for r in spark.read.parquet(str(out / "scans")).collect()}
    assert scans == {1: ("success", 2, 1), 2: ("no_data", 0, 0)}
    assert [r.severity for r in spark.read.parquet(str(out / "alerts")).collect()] == ["critical"]
    assert {r.message for r in spark.read.parquet(str(out / "events")).collect()} == {"2024-01-15 10:30:00 ERROR x [EMAIL]", "plain"}


def test_json_stream_sets_bad_lines_aside(spark, tmp_path):
    logs, out, state = (tmp_path / n for n in ("logs", "out", "state"))
    logs.mkdir()
    (logs / "a.jsonl").write_text('{"msg": "one", "level": "error"}\n{"cut": \n')
    raw = stream_json_lines(spark, str(logs))
    monitor.monitor(raw, lambda rows: timeline.to_events(rows, as_of()), str(out), str(state), once=True).awaitTermination()
    assert [r.level for r in spark.read.parquet(str(out / "events")).collect()] == ["ERROR"]
    assert [r.reason for r in spark.read.parquet(str(out / "quarantine")).collect()] == ["invalid JSON"]


def test_sinks(spark, make_events, tmp_path):
    frame = spark.createDataFrame([("i", "# r\nline")], "incident_id string, report string")
    path = sinks.save_reports(frame, str(tmp_path / "r.md"), "json")
    assert path.endswith("r.json")
    assert [r.value for r in spark.read.text(path).collect()] == ["# r", "line"]
    entries = sinks.audit_entries(frame, "export", F.lit("success"), as_of(), {"id": F.col("incident_id")})
    sinks.append_audit(entries, str(tmp_path / "audit"))
    sinks.append_audit(entries, str(tmp_path / "audit"))
    read = spark.read.json(str(tmp_path / "audit"))
    assert read.count() == 2 and read.first().user_context.id == "i"
    events = make_events([("i", 0, "INFO", "s", "m"), ("i", 90000, "INFO", "s", "m")])
    sinks.land_events(events, str(tmp_path / "landed"))
    landed = spark.read.parquet(str(tmp_path / "landed")).filter("day = '1970-01-02'")
    assert landed.count() == 1
    assert "PartitionFilters: [isnotnull(day" in landed._jdf.queryExecution().executedPlan().toString()


def test_alert_changes_equal_the_batch_life_cycle(spark, make_events, tmp_path):
    from faultline.operators.alerts import alert_life_cycle
    from faultline.streaming.lifecycle import alert_changes

    source, windows, out = (str(tmp_path / n) for n in ("in", "windows", "out"))
    noisy = [n for n in range(600) if (n // 60) % 3 == 1]
    events = make_events([("i", n * 10, "ERROR" if n in noisy and n % 3 == 0 else "INFO", f"s{n % 2}", "m") for n in range(600)])
    for part in (events.filter("seq <= 330"), events.filter("seq > 330")):
        part.write.mode("append").parquet(source)
        monitor.write_windows(stream_table(spark, source, events.schema), "5 minutes", "1 minute", windows,
                              str(tmp_path / "s1"), once=True).awaitTermination()
        closed = stream_table(spark, windows, spark.read.parquet(windows).schema)
        (alert_changes(closed).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start().awaitTermination())
    batch = alert_life_cycle(spark.read.parquet(windows), ["service"]).collect()
    changes = spark.read.parquet(out).collect()
    assert {(r.service, r.opened_at) for r in changes if r.change == "opened"} == {(r.service, r.opened_at) for r in batch}
    assert {(r.service, r.opened_at, r.resolved_at) for r in changes if r.change == "resolved"} == {
        (r.service, r.opened_at, r.resolved_at) for r in batch if r.resolved_at is not None}
    assert len(batch) > 2


def _scan(spark, raw, out, state):
    monitor.monitor(raw, lambda rows: timeline.to_events(rows, as_of()), str(out), str(state), once=True).awaitTermination()


def test_json_documents_and_csv_arrive(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    (logs / "a.json").write_text('[{"level": "ERROR",\n "message": "a"}, 5]')
    (logs / "b.json").write_text('{"level": "WARN",\n "message": "b"}')
    (logs / "c.json").write_text('{"level": "INFO", "message": "c"}\nbroken\n')
    (logs / "d.csv").write_text('level,message\nFATAL,"two\nlines"\nINFO,x,y\n')
    _scan(spark, stream_json_documents(spark, str(logs)), out / "json", tmp_path / "s1")
    _scan(spark, stream_csv(spark, str(logs), "level,message"), out / "csv", tmp_path / "s2")
    events = spark.read.parquet(str(out / "json" / "events")).unionByName(spark.read.parquet(str(out / "csv" / "events")))
    assert {(r.level, r.message) for r in events.collect()} == {
        ("ERROR", "a"), ("WARN", "b"), ("INFO", "c"), ("FATAL", "two\nlines")}
    bad = spark.read.parquet(str(out / "json" / "quarantine")).collect() + spark.read.parquet(str(out / "csv" / "quarantine")).collect()
    assert sorted((r.raw, r.reason) for r in bad) == [
        ("5", "not a JSON object"), ("INFO,x,y", "more fields than the header"), ("broken", "invalid JSON")]


def test_idle_and_failed_cycles_leave_a_scan_row(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    (logs / "a.log").write_text("ERROR x")

    def broken(rows):
        raise RuntimeError("no events today")

    query = monitor.monitor(stream_text(spark, str(logs)), broken, str(out), str(tmp_path / "s"), once=True)
    try:
        query.awaitTermination()
        failed = False
    except Exception:
        failed = True
    assert failed
    scans = spark.read.parquet(str(out / "scans"))
    assert [r.status for r in scans.collect()] == ["error: RuntimeError"]
    monitor.idle_scan(spark, str(out), "2024-01-15T10-30")
    monitor.idle_scan(spark, str(out), "2024-01-15T10-30")
    assert [r.status for r in spark.read.parquet(str(out / "scans" / "idle=2024-01-15T10-30")).collect()] == ["no_data"]


def test_events_of_all_days_pass_the_json_and_csv_streams(spark, monkeypatch):
    from faultline.catalogue import streams
    from faultline.catalogue.registry import Tables

    tables, scanned, monitor_raw = Tables(spark, "/root/testdata/sf0.001"), [], streams.monitor.monitor

    def watched(raw, to_events, out, *args, **more):
        scanned.append(out)
        return monitor_raw(raw, to_events, out, *args, **more)

    monkeypatch.setattr(streams, "FILE_ROWS", 300, raising=False)
    monkeypatch.setattr(streams.monitor, "monitor", watched)
    streams.stream_json_and_csv(tables).collect()

    def days(frame):
        return {tuple(r) for r in frame.groupBy(F.to_date("timestamp"), "level").count().collect()}

    whole = days(tables.log_events)
    assert len(scanned) == 2 and len({day for day, _, _ in whole}) > 1
    for out in scanned:
        landed = spark.read.parquet(f"{out}/events")
        assert landed.select("source_file").distinct().count() > 1
        assert days(landed) == whole


def test_runs_end_and_their_state_with_them(spark, make_events, tmp_path):
    from faultline.operators import sessions
    from faultline.streaming import runs

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    # Each service fails for a while and is never heard of again; one late row belongs to a closed run.
    rows = [("i", n * 60, "ERROR" if n % 3 else "INFO", f"s{n // 40}", "m") for n in range(400)]
    parts = [rows[:200], rows[200:], [("i", 30, "ERROR", "s0", "late"), ("i", 400 * 60, "ERROR", "s9", "m")]]
    kept = []
    for part in parts:
        events = make_events(part)
        events.write.mode("append").parquet(source)
        stream = stream_table(spark, source, events.schema)
        query = runs.write_runs(runs.session_stream(stream, "10 minutes", "5 minutes"), out, state, once=True)
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None)
    found = sorted((r.service, r.started_at, r.ended_at, r.n_errors) for r in spark.read.parquet(out).collect())
    batch = sessions.error_sessions(make_events(rows), 10).collect()
    want = sorted((r.service, r.started_at, r.ended_at, r.n_errors) for r in batch)
    # All but the last run are closed, each once; the late row has changed none of them.
    assert found == want[:-1] and len(found) == 9
    assert max(k for k in kept if k is not None) <= 3


def test_texts_of_a_scan_are_read_once(spark, make_events, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    made = make_events([("i", n, "ERROR", "s", "m") for n in range(10)]).withColumn("source_file", F.lit("f"))
    nothing = {"reason": F.lit(None).cast("string"), "raw": F.lit(None).cast("string"), "line_number": F.lit(1)}
    made.withColumns(nothing).write.parquet(source)
    read = spark.sparkContext.accumulator(0)

    def seen(level):
        read.add(1)
        return level

    marked = F.udf(seen, "string").asNondeterministic()
    stream = stream_table(spark, source, spark.read.parquet(source).schema)
    monitor.monitor(
        stream, lambda rows: rows.withColumn("level", marked("level")), out, state, F.current_timestamp(), once=True
    ).awaitTermination()
    assert spark.read.parquet(f"{out}/events").count() == 10
    assert [r.events_processed for r in spark.read.parquet(f"{out}/scans").collect()] == [10]
    assert read.value == 10
