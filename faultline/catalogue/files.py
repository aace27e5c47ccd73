"""Log files in every format, written by Spark from the event view and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.catalogue.incidents import as_of
from faultline.catalogue.reporting import _analysed
from faultline.catalogue.registry import Tables, query, second, sql_second, with_log
from faultline.operators import reports, timeline
from faultline.schema import AUDIT
from faultline.session import new_folder
from faultline.sinks import tables as sinks
from faultline.sources import files
from faultline.sources.scenarios import read_catalogue, with_scenario


def _write_text(t: Tables) -> str:
    """Text logs with a blank line between any two lines."""
    folder = new_folder(t.spark, "text")
    line = F.concat(second("timestamp"), F.lit(" "), "level", F.lit(" "), "service", F.lit(": #"), F.col("seq").cast("string"))
    t.spread_log.select(F.concat(line, F.lit("\n  "))).write.option("lineSep", "\n").text(folder)
    return folder


@query(
    with_log(
        f"""
SELECT seq, {sql_second("timestamp")} AS timestamp, level, 'unknown' AS service,
       concat({sql_second("timestamp")}, ' ', level, ' ', service, ': #', seq) AS message, false AS ts_inferred
FROM log_events"""
    )
)
def scan_text_files(t: Tables) -> DataFrame:
    events = timeline.to_events(files.raw_text(t.spark, [_write_text(t)]), as_of())
    return events.select(
        F.regexp_extract("message", r"#(\d+)$", 1).cast("long").alias("seq"),
        second("timestamp").alias("timestamp"),
        "level",
        "service",
        "message",
        "ts_inferred",
    )


@query("SELECT count(*) AS n_lines, true AS odd, true AS complete FROM events")
def text_line_numbers(t: Tables) -> DataFrame:
    """Every second line is blank, so the numbers of a file must be 1, 3, 5, ..."""
    lines = files.text_lines(t.spark, [_write_text(t)])
    per_file = lines.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("line_number").alias("last"),
        F.count_distinct("line_number").alias("different"),
        F.bool_and(F.col("line_number") % 2 == 1).alias("odd"),
    )
    return per_file.agg(
        F.sum("n").alias("n_lines"),
        F.bool_and("odd").alias("odd"),
        F.bool_and((F.col("last") == F.col("n") * 2 - 1) & (F.col("different") == F.col("n"))).alias("complete"),
    )


def _plain(events: DataFrame) -> DataFrame:
    return events.select(
        F.try_element_at("metadata", F.lit("seq")).cast("long").alias("seq"),
        second("timestamp").alias("timestamp"),
        "level",
        "service",
        "message",
    )


_PLAIN_SQL = with_log(f"SELECT seq, {sql_second('timestamp')} AS timestamp, level, service, message FROM log_events")


def _flat(t: Tables) -> DataFrame:
    return t.spread_log.select(second("timestamp").alias("time"), "level", "service", "message", "seq")


@query(_PLAIN_SQL)
def scan_json_lines(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "jsonl")
    _flat(t).write.json(folder)
    return _plain(timeline.to_events(files.raw_json(t.spark, [folder]), as_of()))


@query(_PLAIN_SQL)
def scan_json_documents(t: Tables) -> DataFrame:
    """JSON arrays of up to 2000 events, each written over several lines in a file of its own."""
    folder = new_folder(t.spark, "documents")
    entry = F.to_json(F.struct("time", "level", "service", "message", "seq"))
    entries = F.array_join(F.collect_list(entry), ",\n")
    documents = (
        _flat(t)
        .groupBy(F.expr("seq div 2000").alias("document"))
        .agg(F.concat(F.lit("[\n"), entries, F.lit("\n]")).alias("text"))
    )
    documents.select("text").write.option("maxRecordsPerFile", 1).text(folder)
    found = files.raw_json(t.spark, [folder], extensions=["txt"])
    return _plain(timeline.to_events(found, as_of()))


@query(_PLAIN_SQL)
def scan_csv_files(t: Tables) -> DataFrame:
    """Two headers: the columns of one half are named and ordered differently."""
    folder = new_folder(t.spark, "csv")
    flat = _flat(t)
    errors = F.col("level") == "ERROR"
    flat.filter(errors).write.csv(f"{folder}/a", header=True)
    flat.filter(~errors).select(
        F.col("message").alias("msg"), F.col("service").alias("app"), "seq", F.col("level").alias("severity"),
        F.col("time").alias("date"),
    ).write.csv(f"{folder}/b", header=True)
    return _plain(timeline.to_events(files.raw_csv(t.spark, [folder]), as_of()))


@query(
    with_log(
        """
SELECT reason, count(*) AS n FROM (
    SELECT CASE level WHEN 'WARN' THEN 'invalid JSON' WHEN 'DEBUG' THEN 'not a JSON object' ELSE 'read' END AS reason
    FROM log_events)
GROUP BY 1
UNION ALL SELECT 'file not found', 1"""
    )
)
def scan_with_quarantine(t: Tables) -> DataFrame:
    """Bad records are set aside with a reason; a missing path does not stop the rest."""
    folder = new_folder(t.spark, "mixed")
    good = F.to_json(F.struct("timestamp", "level", "message"))
    line = (
        F.when(F.col("level") == "WARN", F.concat(F.lit('{"cut": "'), "message"))
        .when(F.col("level") == "DEBUG", F.concat(F.lit("["), F.col("seq").cast("string"), F.lit("]")))
        .otherwise(good)
    )
    # The first line of every file is good, so each file is read line by line.
    ordered = t.log_events.withColumn("line", line).withColumn("_first", F.col("level").isin("WARN", "DEBUG"))
    ordered.sortWithinPartitions("_first").select("line").write.text(folder)
    raw = files.raw_json(t.spark, [folder], extensions=["txt"])
    _, missing = files.present_paths(t.spark, [f"{folder}/absent"])
    absent = t.spark.createDataFrame([(m,) for m in missing], "source_file string")
    both = raw.select("reason").unionByName(absent.select(F.lit("file not found").alias("reason")))
    return both.groupBy(F.coalesce("reason", F.lit("read")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    with_log(
        """
SELECT source, count(*) AS n_events, count(*) FILTER (WHERE level = 'ERROR') AS n_errors
FROM (SELECT level, unnest(['csv', 'json', 'txt']) AS source FROM log_events) GROUP BY 1"""
    )
)
def scan_mixed_folder(t: Tables) -> DataFrame:
    """One folder with text, JSON and CSV files, each read by its extension."""
    folder = new_folder(t.spark, "formats")
    flat = _flat(t)
    line = F.concat_ws(" ", "time", "level", "service")
    flat.select(line).write.text(f"{folder}/text")
    flat.write.json(f"{folder}/json")
    flat.write.csv(f"{folder}/csv", header=True)
    events = timeline.read_timeline(t.spark, [folder], as_of(), strict=True)
    extension = F.regexp_extract("source_file", r"\.(\w+)$", 1)
    return events.groupBy(extension.alias("source")).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("level") == "ERROR").alias("n_errors")
    )


@query(
    """
SELECT o_orderpriority AS scenario, count(*) AS n, any_value(concat('About ', o_orderpriority)) AS description
FROM orders GROUP BY 1"""
)
def scenario_lookup(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "scenarios")
    orders = t.table("orders")
    names = orders.select("o_orderpriority").distinct()
    body = F.to_json(
        F.struct(
            F.col("o_orderpriority").alias("name"),
            F.concat(F.lit("About "), "o_orderpriority").alias("description"),
        )
    )
    names.select(body.alias("body")).write.option("maxRecordsPerFile", 1).text(folder)
    catalogue = read_catalogue(t.spark, folder).withColumn("scenario", F.col("name"))
    joined = with_scenario(orders.withColumnRenamed("o_orderpriority", "scenario"), catalogue)
    return joined.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.max("description").alias("description")
    )


@query(
    with_log(
        """SELECT incident_id AS session, 'analyze' AS action, 'success' AS outcome, count(*) AS n
           FROM log_events GROUP BY 1"""
    )
)
def audit_log(t: Tables) -> DataFrame:
    """One audit line per event, appended as JSON and read back."""
    folder = new_folder(t.spark, "audit")
    entries = sinks.audit_entries(
        t.log_events, "analyze", F.lit("success"), as_of(), {"session": F.col("incident_id")}
    )
    sinks.append_audit(entries, folder)
    read = t.spark.read.schema(AUDIT).json(folder)
    return read.groupBy(F.col("user_context")["session"].alias("session"), "action", "outcome").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    with_log(
        """SELECT incident_id, '85.0%' AS confidence, least(count(*), 25) AS n_rows FROM log_events GROUP BY 1"""
    )
)
def saved_reports(t: Tables) -> DataFrame:
    """Markdown reports saved to a folder per incident, read back line by line."""
    made = reports.markdown_reports(_analysed(t), t.log_events, as_of())
    path = sinks.save_reports(made, new_folder(t.spark, "reports"))
    lines = t.spark.read.text(path)
    return lines.groupBy(F.col("incident_id").cast("string").alias("incident_id")).agg(
        F.max(F.regexp_extract("value", r"^\*\*Confidence:\*\* (.*)$", 1)).alias("confidence"),
        F.count_if(F.col("value").rlike(r"^\| 2")).alias("n_rows"),
    )


@query(with_log("SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n FROM log_events GROUP BY 1"))
def landed_events(t: Tables) -> DataFrame:
    """Events landed as Parquet by day, where a date filter prunes folders."""
    path = new_folder(t.spark, "landed")
    sinks.land_events(t.log_events, path)
    landed = t.spark.read.parquet(path)
    return landed.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def _daily_lines(t: Tables, *extra) -> str:
    """Text files by day: the events as JSON, one per line, and further lines by (place, text)."""
    folder = new_folder(t.spark, "daily")
    body = F.to_json(F.struct(second("timestamp").alias("timestamp"), "level", "service", "message"))
    rows = t.log_events.select(F.col("incident_id").alias("day"), F.lit(1).alias("place"), body.alias("line"))
    days = t.log_events.select(F.col("incident_id").alias("day")).distinct()
    for place, text in extra:
        rows = rows.unionByName(days.select("day", F.lit(place).alias("place"), F.lit(text).alias("line")))
    if extra[0][1] == "[":
        rows = rows.withColumn("line", F.when(F.col("place") == 1, F.concat("line", F.lit(","))).otherwise(F.col("line")))
    rows = rows.repartition("day").sortWithinPartitions("day", "place").select("day", "line")
    rows.write.partitionBy("day").text(folder)
    return folder


def _levels(raw) -> DataFrame:
    """Records by level, and bad ones by reason, with the characters of their messages."""
    events = timeline.to_events(raw, as_of()).select(
        F.concat(F.lit("level "), "level").alias("what"), F.length("message").alias("chars")
    )
    bad = timeline.quarantined(raw).select(F.concat(F.lit("bad "), "reason").alias("what"), F.length("raw").alias("chars"))
    return events.unionByName(bad).groupBy("what").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").cast("long").alias("chars")
    )


@query(
    with_log(
        """
SELECT concat('level ', level) AS what, count(*) AS n, CAST(sum(length(message)) AS BIGINT) AS chars
FROM log_events GROUP BY 1
UNION ALL
SELECT 'bad invalid JSON', count(DISTINCT incident_id), CAST(8 * count(DISTINCT incident_id) AS BIGINT) FROM log_events"""
    )
)
def scan_json_bad_first_line(t: Tables) -> DataFrame:
    """JSON-lines files whose first line is broken lose that line alone."""
    return _levels(files.raw_json(t.spark, [_daily_lines(t, (0, '{"broken'))], extensions=["txt"]))


@query(
    with_log(
        """
SELECT concat('level ', level) AS what, count(*) AS n, CAST(sum(length(message)) AS BIGINT) AS chars
FROM log_events GROUP BY 1
UNION ALL
SELECT 'level FATAL end', count(DISTINCT incident_id), CAST(3 * count(DISTINCT incident_id) AS BIGINT) FROM log_events"""
    )
)
def scan_json_arrays(t: Tables) -> DataFrame:
    """JSON documents that are one array over many lines."""
    end = '{"timestamp":"2024-01-01 00:00:00","level":"FATAL","service":"x","message":"end"}]'
    raw = files.raw_json(t.spark, [_daily_lines(t, (0, "["), (2, end))], extensions=["txt"])
    found = timeline.to_events(raw, as_of())
    last = F.when(F.col("message") == "end", " end").otherwise("")
    return found.groupBy(F.concat(F.lit("level "), "level", last).alias("what")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("message")).cast("long").alias("chars")
    )


@query(
    with_log(
        """
SELECT concat('level ', level) AS what, count(*) AS n,
       CAST(sum(length(message) + length(service) + 5) AS BIGINT) AS chars
FROM log_events GROUP BY 1"""
    )
)
def scan_csv_line_breaks(t: Tables) -> DataFrame:
    """CSV files whose quoted cells hold line breaks, commas and quotes."""
    folder = new_folder(t.spark, "broken")
    message = F.concat("message", F.lit('\n"a",'), "service")
    t.log_events.select(second("timestamp").alias("timestamp"), "level", "service", message.alias("message")).write.csv(
        folder, header=True, escape='"'
    )
    return _levels(files.raw_csv(t.spark, [folder]))
