"""Counts, rates, alerts, slices and sessions over the event view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.catalogue.registry import (
    Tables,
    query,
    second,
    sql_second,
    sql_stamp,
    stamp,
    with_log,
)
from faultline.functions.text import percent_text
from faultline.operators import alerts, context, intervals, metrics, quantiles, sessions, timeline, trends

def as_of() -> Column:
    """The moment at which the queries stand."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def _hourly(events: DataFrame) -> DataFrame:
    return events.withColumn("hour", F.date_trunc("hour", "timestamp"))


# ---------------------------------------------------------------------------
# Counts and rates
# ---------------------------------------------------------------------------


@query(with_log("SELECT incident_id, count(*) AS n_events FROM log_events GROUP BY 1"))
def event_count_by_incident(t: Tables) -> DataFrame:
    return metrics.event_counts(t.log_events)


@query(
    with_log(
        """
SELECT incident_id, count(*) AS n_events,
       count(*) FILTER (WHERE level = 'ERROR') AS n_errors,
       round(count(*) FILTER (WHERE level = 'ERROR') / count(*), 6) AS error_rate
FROM log_events GROUP BY 1"""
    )
)
def error_rate_by_incident(t: Tables) -> DataFrame:
    stats = metrics.error_stats(t.log_events)
    return stats.withColumn("error_rate", F.round("error_rate", 6))


@query(
    with_log(
        f"""
SELECT {sql_second("date_trunc('hour', timestamp)")} AS window_start, service,
       count(*) AS n_events, count(*) FILTER (WHERE level = 'ERROR') AS n_errors,
       round(count(*) FILTER (WHERE level = 'ERROR') / count(*), 6) AS error_rate
FROM log_events GROUP BY 1, 2"""
    )
)
def error_rate_by_hour(t: Tables) -> DataFrame:
    rates = trends.windowed_rates(t.log_events, "1 hour")
    return rates.select(
        second("window_start").alias("window_start"),
        "service",
        "n_events",
        "n_errors",
        F.round("error_rate", 6).alias("error_rate"),
    )


@query(
    with_log(
        f"""
SELECT {sql_second("s")} AS window_start, service, count(*) AS n_events,
       count(*) FILTER (WHERE level = 'ERROR') AS n_errors
FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', timestamp),
                     time_bucket(INTERVAL '1 hour', timestamp) - INTERVAL '1 hour']) AS s, *
      FROM log_events)
GROUP BY 1, 2"""
    )
)
def error_rate_sliding(t: Tables) -> DataFrame:
    rates = trends.windowed_rates(t.log_events, "2 hours", slide="1 hour")
    return rates.select(second("window_start").alias("window_start"), "service", "n_events", "n_errors")


_ALERTS_SQL = """
    SELECT incident_id, date_trunc('hour', timestamp) AS hour, count(*) AS n_events,
           count(*) FILTER (WHERE level = 'ERROR') AS n_errors
    FROM log_events GROUP BY 1, 2"""

_ERRING_SQL = """
    SELECT hour, string_agg(service, ', ' ORDER BY f) AS affected_services
    FROM (SELECT date_trunc('hour', timestamp) AS hour, service, min((timestamp, seq)) AS f
          FROM log_events WHERE level = 'ERROR' GROUP BY 1, 2)
    GROUP BY 1"""


@query(
    with_log(
        f"""
SELECT {sql_second("r.hour")} AS hour, r.n_events, r.n_errors,
       CASE WHEN n_errors / n_events > 0.25 THEN 'critical' ELSE 'high' END AS severity,
       e.affected_services,
       concat('Share of errors above the limit: ', printf('%.0f%%', n_errors / n_events * 100)) AS description,
       round(n_errors / n_events, 6) AS current_value,
       0.05::DOUBLE AS baseline_value, 0.85::DOUBLE AS confidence, 'increasing_errors' AS trend_type,
       sha256('increasing_errors|' || {sql_second("r.hour")}) AS alert_id
FROM rates r JOIN erring e USING (hour)
WHERE n_errors / n_events > 0.15""",
        f"rates AS ({_ALERTS_SQL})",
        f"erring AS ({_ERRING_SQL})",
    )
)
def threshold_alerts_hourly(t: Tables) -> DataFrame:
    found = alerts.error_rate_alerts(_hourly(t.log_events), as_of(), keys=["hour"])
    return found.select(
        second("hour").alias("hour"),
        "n_events",
        "n_errors",
        "severity",
        F.array_join("affected_services", ", ").alias("affected_services"),
        "description",
        F.round("trend.current_value", 6).alias("current_value"),
        "trend.baseline_value",
        "trend.confidence",
        "trend_type",
        "alert_id",
    )


@query(
    with_log(
        f"""
SELECT {sql_second("hour")} AS hour, count(*) AS n_alerts
FROM rates WHERE n_errors / n_events > 0.15 GROUP BY 1""",
        f"rates AS ({_ALERTS_SQL})",
    )
)
def alert_counts(t: Tables) -> DataFrame:
    found = alerts.error_rate_alerts(_hourly(t.log_events), as_of(), keys=["hour"])
    return alerts.alerts_per_key(found, ["hour"]).withColumn("hour", second("hour"))


@query(
    with_log(
        f"""
SELECT {sql_second("hour")} AS hour, printf('%.0f%%', n_errors / n_events * 100) AS whole,
       printf('%.1f%%', n_errors / n_events * 100) AS tenths
FROM rates""",
        f"rates AS ({_ALERTS_SQL})",
    )
)
def percent_texts(t: Tables) -> DataFrame:
    stats = metrics.error_stats(_hourly(t.log_events), ["hour"])
    rate = F.col("error_rate")
    return stats.select(
        second("hour").alias("hour"),
        percent_text(rate).alias("whole"),
        percent_text(rate, 1).alias("tenths"),
    )


@query(
    with_log(
        """
SELECT incident_id, service, n, row_number() OVER (PARTITION BY incident_id ORDER BY n DESC, f) AS rank
FROM (SELECT incident_id, service, count(*) AS n, min((timestamp, seq)) AS f
      FROM log_events WHERE level IN ('ERROR', 'FATAL') GROUP BY 1, 2)"""
    )
)
def errors_by_service(t: Tables) -> DataFrame:
    return metrics.errors_per_service(t.log_events)


@query(
    with_log(
        """
SELECT incident_id, service, row_number() OVER (PARTITION BY incident_id ORDER BY f) AS place
FROM (SELECT incident_id, service, min((timestamp, seq)) AS f FROM log_events GROUP BY 1, 2)"""
    )
)
def service_topology(t: Tables) -> DataFrame:
    return metrics.services_by_appearance(t.log_events)


@query(
    with_log(
        """
SELECT incident_id, string_agg(service, ', ' ORDER BY f) AS services
FROM (SELECT incident_id, service, min((timestamp, seq)) AS f
      FROM log_events WHERE level = 'ERROR' GROUP BY 1, 2)
GROUP BY 1"""
    )
)
def error_services(t: Tables) -> DataFrame:
    lists = metrics.service_lists(t.log_events, errors_only=True)
    return lists.withColumn("services", F.array_join("services", ", "))


@query(
    with_log(
        """
SELECT a.incident_id, b.errors, a.topology FROM
 (SELECT incident_id, string_agg(service, ', ' ORDER BY f) AS topology
  FROM (SELECT incident_id, service, min((timestamp, seq)) AS f FROM log_events GROUP BY 1, 2)
  GROUP BY 1) a
JOIN
 (SELECT incident_id, string_agg(concat(service, '=', n), ', ' ORDER BY service) AS errors
  FROM (SELECT incident_id, service, count(*) AS n
        FROM log_events WHERE level IN ('ERROR', 'FATAL') GROUP BY 1, 2)
  GROUP BY 1) b USING (incident_id)"""
    )
)
def incident_contexts(t: Tables) -> DataFrame:
    made = metrics.incident_context(t.log_events)
    pairs = F.transform(
        F.array_sort(F.map_entries("error_clusters")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return made.select(
        "incident_id",
        F.array_join(pairs, ", ").alias("errors"),
        F.array_join("service_topology", ", ").alias("topology"),
    )


@query("SELECT user_id, count(*) AS used, greatest(0, 100 - count(*)) AS remaining FROM events GROUP BY 1")
def usage_quota(t: Tables) -> DataFrame:
    return metrics.client_quota(t.events, "user_id")


@query(
    with_log(
        """
SELECT incident_id, count(*) AS original_count, least(count(*), 50) AS kept, count(*) > 50 AS truncated
FROM log_events GROUP BY 1"""
    )
)
def truncation_notices(t: Tables) -> DataFrame:
    return metrics.truncation_notice(t.log_events, 50)


@query(
    """
WITH days AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS incident_id FROM orders
              UNION SELECT strftime(ts, '%Y%m%d') FROM events),
     n AS (SELECT strftime(ts, '%Y%m%d') AS incident_id, count(*) AS c FROM events GROUP BY 1)
SELECT incident_id, coalesce(c, 0) AS events_processed,
       CASE WHEN coalesce(c, 0) = 0 THEN 'no_data' ELSE 'success' END AS status
FROM days LEFT JOIN n USING (incident_id)"""
)
def scan_statuses(t: Tables) -> DataFrame:
    ordered = t.table("orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("incident_id"))
    days = ordered.distinct().union(t.log_events.select("incident_id").distinct()).distinct()
    return metrics.scan_status(days, t.log_events)


@query(
    """
SELECT user_id, last.event_id AS event_id, last.event_type AS event_type, last.value AS value
FROM (SELECT user_id, arg_max({'event_id': event_id, 'event_type': event_type, 'value': value},
                              (ts, event_id)) AS last
      FROM events GROUP BY 1)"""
)
def session_latest(t: Tables) -> DataFrame:
    newest = metrics.latest(t.events, ["user_id"], ["ts", "event_id"])
    return newest.select("user_id", "event_id", "event_type", "value")


@query(
    """
WITH sessions AS (SELECT c_custkey AS session_id, c_name AS analysis, c_acctbal AS bal FROM customer),
     newest AS (SELECT session_id, analysis FROM sessions ORDER BY session_id DESC LIMIT 1),
     requests AS (SELECT o_orderkey AS request,
                         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS session_id FROM orders)
SELECT r.request, coalesce(r.session_id, n.session_id) AS session_id,
       CASE WHEN r.session_id IS NULL THEN n.analysis ELSE s.analysis END AS analysis
FROM requests r LEFT JOIN sessions s USING (session_id) CROSS JOIN newest n"""
)
def session_or_latest(t: Tables) -> DataFrame:
    sessions_ = t.table("customer").select(
        F.col("c_custkey").alias("session_id"), F.col("c_name").alias("analysis")
    )
    requests = t.table("orders").select(
        F.col("o_orderkey").alias("request"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("session_id"),
    )
    stored = sessions_.withColumn("created_at", F.col("session_id"))
    found = metrics.session_or_latest(requests, stored, ["created_at"])
    return found.select("request", "session_id", "analysis")


# ---------------------------------------------------------------------------
# Slices
# ---------------------------------------------------------------------------


def _slice(df: DataFrame) -> DataFrame:
    return df.select("incident_id", "rn", stamp("timestamp").alias("timestamp"), "level", "service", "message")


def _slice_sql(where: str, order: str = "timestamp, seq") -> str:
    return with_log(
        f"""
SELECT incident_id, rn, {sql_stamp("timestamp")} AS timestamp, level, service, message
FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY {order}) AS rn,
             count(*) OVER (PARTITION BY incident_id) AS n FROM log_events)
WHERE {where}"""
    )


@query(_slice_sql("rn <= 25"))
def timeline_first_25(t: Tables) -> DataFrame:
    return _slice(context.first_events(t.log_events, 25))


@query(_slice_sql("rn <= 50"))
def timeline_first_50(t: Tables) -> DataFrame:
    return _slice(context.first_events(t.log_events, 50))


@query(_slice_sql("n > 5 AND rn > n - 30").replace("incident_id, rn,", "incident_id, rn - greatest(n - 30, 0) AS rn,"))
def timeline_tail_30(t: Tables) -> DataFrame:
    return _slice(context.prediction_tail(t.log_events))


@query(_slice_sql("rn <= 10 AND level IN ('ERROR', 'WARN', 'FATAL')"))
def key_events_first_10(t: Tables) -> DataFrame:
    return _slice(context.key_events(t.log_events))


@query(
    with_log(
        f"""
SELECT incident_id, rn, {sql_stamp("timestamp")} AS timestamp, message, n AS n_errors,
       greatest(n - 5, 0) AS more
FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, seq) AS rn,
             count(*) OVER (PARTITION BY incident_id) AS n
      FROM log_events WHERE level = 'ERROR')
WHERE rn <= 5"""
    )
)
def first_errors_and_more(t: Tables) -> DataFrame:
    found = context.first_errors(t.log_events)
    return found.select(
        "incident_id", "rn", stamp("timestamp").alias("timestamp"), "message", "n_errors", "more"
    )


@query(
    with_log(
        f"""
SELECT incident_id, seq AS event_id, row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, seq) AS seq,
       {sql_stamp("timestamp")} AS timestamp, level, service, message
FROM log_events"""
    )
)
def timeline_sorted(t: Tables) -> DataFrame:
    events = t.log_events.withColumnRenamed("seq", "event_id")
    ordered = timeline.sorted_timeline(events, ["timestamp", "event_id"])
    return ordered.select(
        "incident_id", "event_id", "seq", stamp("timestamp").alias("timestamp"), "level", "service", "message"
    )


@query(
    with_log(
        f"""
SELECT f.incident_id, f.seq AS event_id, f.rn - e.rn AS distance, e.level, e.service, e.message,
       {sql_stamp("e.timestamp")} AS timestamp
FROM numbered f JOIN numbered e
  ON e.incident_id = f.incident_id AND e.rn BETWEEN f.rn - 3 AND f.rn - 1
WHERE f.level = 'FATAL'""",
        """numbered AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, seq) AS rn
           FROM log_events)""",
    )
)
def before_each_fatal(t: Tables) -> DataFrame:
    found = sessions.events_before(t.log_events, F.col("level") == "FATAL", 3)
    return found.select(
        "incident_id",
        F.col("seq").alias("event_id"),
        (-F.col("before_offset")).alias("distance"),
        F.col("before_level").alias("level"),
        F.col("before_service").alias("service"),
        F.col("before_message").alias("message"),
        stamp("before_timestamp").alias("timestamp"),
    )


# Seconds that within_minutes_of_fatal looks back.
BEFORE_FATAL = 600


@query(
    with_log(
        f"""
SELECT f.seq AS event_id, e.seq AS before_id, e.level, e.service, round(epoch(f.timestamp - e.timestamp), 6) AS seconds_before
FROM log_events f JOIN log_events e
     ON e.timestamp < f.timestamp AND e.timestamp >= f.timestamp - INTERVAL '{BEFORE_FATAL} seconds'
WHERE f.level = 'FATAL'"""
    )
)
def within_minutes_of_fatal(t: Tables) -> DataFrame:
    """What happened in the minutes before each fatal event, in any service."""
    anchors = t.log_events.filter(F.col("level") == "FATAL").withColumnRenamed("seq", "event_id")
    found = intervals.events_within(t.log_events, anchors, BEFORE_FATAL, ["event_id"], ["seq", "level", "service"])
    return found.select(
        "event_id",
        F.col("before_seq").alias("before_id"),
        F.col("before_level").alias("level"),
        F.col("before_service").alias("service"),
        F.round("seconds_before", 6).alias("seconds_before"),
    )


@query(
    """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, true AS p50_within, true AS p95_within, true AS p99_within
FROM events GROUP BY 1, 2"""
)
def merged_quantiles(t: Tables) -> DataFrame:
    """Quantile sketches of every hour merged to days; the true rank of each quantile lies within the stated bound."""
    points = t.events.select(F.col("ts").cast("timestamp").alias("timestamp"), "event_type", "value")
    hours = quantiles.sketched_windows(points, "1 hour", ["event_type"])
    days = quantiles.quantiles_of(quantiles.merged_windows(hours, "1 day", ["event_type"]))
    day = F.date_format("timestamp", "yyyy-MM-dd").alias("day")
    beside = points.select(day, "event_type", "value").join(
        days.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "p50", "p95", "p99"),
        ["day", "event_type"],
    )
    checks = []
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        below = F.count_if(F.col("value") < F.col(name)) / F.count(F.lit(1))
        up_to = F.count_if(F.col("value") <= F.col(name)) / F.count(F.lit(1))
        checks.append(((below <= q + quantiles.RANK_ERROR) & (up_to >= q - quantiles.RANK_ERROR)).alias(f"{name}_within"))
    return beside.groupBy("day", "event_type").agg(F.max("n").cast("long").alias("n"), *checks)


# ---------------------------------------------------------------------------
# Filters and lookups
# ---------------------------------------------------------------------------


@query(with_log("SELECT incident_id, seq, service FROM log_events WHERE level = 'ERROR'"))
def error_events(t: Tables) -> DataFrame:
    return t.log_events.filter(metrics.is_error()).select("incident_id", "seq", "service")


@query(with_log("SELECT incident_id, seq, level FROM log_events WHERE level IN ('ERROR', 'FATAL')"))
def failure_events(t: Tables) -> DataFrame:
    return t.log_events.filter(metrics.is_failure()).select("incident_id", "seq", "level")


@query(
    with_log(
        """
SELECT seq, level, r.rank FROM log_events
JOIN (VALUES ('DEBUG', 0), ('TRACE', 0), ('INFO', 1), ('WARN', 2), ('WARNING', 2), ('ERROR', 3),
             ('FATAL', 4), ('CRITICAL', 4)) r(level, rank) USING (level)
WHERE r.rank >= 2"""
    )
)
def severity_rank_filter(t: Tables) -> DataFrame:
    return metrics.severity_filter(t.log_events, "WARN").select("seq", "level", "rank")


_KNOWN_SQL = "known AS (SELECT DISTINCT concat('svc-', n_regionkey) AS service FROM nation)"


def _known(t: Tables) -> DataFrame:
    region = F.col("n_regionkey").cast("string")
    return t.table("nation").select(F.concat(F.lit("svc-"), region).alias("service"))


@query(
    with_log(
        "SELECT seq, service, service IN (SELECT service FROM known) AS exists FROM log_events", _KNOWN_SQL
    )
)
def known_service_check(t: Tables) -> DataFrame:
    return metrics.known_service_check(t.log_events, _known(t)).select("seq", "service", "exists")


@query(with_log("SELECT seq, service FROM log_events WHERE service NOT IN (SELECT service FROM known)", _KNOWN_SQL))
def unknown_services(t: Tables) -> DataFrame:
    return metrics.known_service_check(t.log_events, _known(t), "left_anti").select("seq", "service")


# ---------------------------------------------------------------------------
# Sessions and trends
# ---------------------------------------------------------------------------


@query(
    with_log(
        f"""
SELECT service, session, {sql_stamp("min(timestamp)")} AS started_at,
       {sql_stamp("max(timestamp)")} AS ended_at, count(*) AS n_errors
FROM (SELECT *, sum(fresh) OVER (PARTITION BY service ORDER BY timestamp, seq)::BIGINT AS session
      FROM (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY service ORDER BY timestamp, seq)
                                <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh
            FROM log_events WHERE level IN ('ERROR', 'FATAL')))
GROUP BY 1, 2"""
    )
)
def error_sessions(t: Tables) -> DataFrame:
    found = sessions.error_sessions(t.log_events)
    return found.select(
        "service",
        "session",
        stamp("started_at").alias("started_at"),
        stamp("ended_at").alias("ended_at"),
        "n_errors",
    )


_SIX_HOURS = """rates AS (
    SELECT service, time_bucket(INTERVAL '6 hours', timestamp, TIMESTAMP '1970-01-01') AS window_start,
           count(*) FILTER (WHERE level = 'ERROR') / count(*) AS error_rate
    FROM log_events GROUP BY 1, 2)"""


@query(
    with_log(
        """
SELECT service, count(*) AS n_windows,
       round(regr_slope(error_rate, epoch(window_start) / 3600.0), 9) AS slope
FROM rates GROUP BY 1""",
        _SIX_HOURS,
    )
)
def trend_slope(t: Tables) -> DataFrame:
    rates = trends.windowed_rates(t.log_events, "6 hours")
    return trends.trend_slopes(rates, ["service"]).withColumn("slope", F.round("slope", 9))


@query(
    with_log(
        f"""
SELECT service, {sql_second("window_start")} AS window_start, round(error_rate, 6) AS error_rate,
       round(baseline, 6) AS baseline,
       CASE WHEN baseline IS NULL THEN 'unknown'
            WHEN round(error_rate, 9) > round(baseline, 9) THEN 'increasing'
            WHEN round(error_rate, 9) < round(baseline, 9) THEN 'decreasing' ELSE 'stable' END AS direction
FROM (SELECT *, avg(error_rate) OVER (PARTITION BY service ORDER BY window_start
                                      ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS baseline FROM rates)""",
        _SIX_HOURS,
    )
)
def trend_baseline(t: Tables) -> DataFrame:
    rates = trends.windowed_rates(t.log_events, "6 hours")
    found = trends.against_baseline(rates, ["service"], 4)
    return found.select(
        "service",
        second("window_start").alias("window_start"),
        F.round("error_rate", 6).alias("error_rate"),
        F.round("baseline", 6).alias("baseline"),
        "direction",
    )


@query(
    with_log(
        f"""
SELECT service, string_agg(concat({sql_second("window_start")}, '=', printf('%.1f%%', error_rate * 100)), ' '
                           ORDER BY window_start) AS points
FROM rates GROUP BY 1""",
        _SIX_HOURS,
    )
)
def trend_points(t: Tables) -> DataFrame:
    rates = trends.windowed_rates(t.log_events, "6 hours")
    found = trends.data_points(rates, ["service"])
    text = F.transform(
        "data_points",
        lambda p: F.concat(second(p["ts"]), F.lit("="), percent_text(p["value"], 1)),
    )
    return found.select("service", F.array_join(text, " ").alias("points"))


@query(
    with_log(
        f"""
SELECT o.service, {sql_second("o.window_start")} AS opened_at, {sql_second("resolved_at")} AS resolved_at,
       (SELECT count(*) FROM flagged f WHERE f.service = o.service AND f.firing
          AND f.window_start >= o.window_start
          AND (o.resolved_at IS NULL OR f.window_start < o.resolved_at)) AS n_windows
FROM (SELECT service, window_start, firing,
             lead(window_start) OVER (PARTITION BY service ORDER BY window_start) AS resolved_at
      FROM changed WHERE change) o
WHERE o.firing""",
        _SIX_HOURS,
        "flagged AS (SELECT service, window_start, error_rate > 0.15 AS firing FROM rates)",
        """changed AS (SELECT *, firing <> coalesce(lag(firing) OVER
           (PARTITION BY service ORDER BY window_start), false) AS change FROM flagged)""",
    )
)
def alert_life_cycle(t: Tables) -> DataFrame:
    rates = trends.windowed_rates(t.log_events, "6 hours")
    found = alerts.alert_life_cycle(rates, ["service"])
    return found.select(
        "service",
        second("opened_at").alias("opened_at"),
        second("resolved_at").alias("resolved_at"),
        "n_windows",
    )


# Messages with measurements, made from the numbers in the table.
_MEASURED_SQL = """measured AS (
    SELECT timestamp, service, seq,
           CASE e.event_type
             WHEN 'view' THEN concat('pool at ', e.event_id % 50, '/50 connections')
             WHEN 'click' THEN concat('heap ', 200 + e.event_id % 300, 'MB/512MB')
             WHEN 'purchase' THEN concat('request done duration=', e.user_id, 'ms')
             WHEN 'signup' THEN concat('Disk usage at ', e.user_id % 100, '%')
             ELSE l.message END AS message
    FROM log_events l JOIN events e ON e.event_id = l.seq)"""


def _measured(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    event, user = F.col("event_id"), F.col("user_id")

    def number(value) -> Column:
        return value.cast("string")

    message = (
        F.when(kind == "view", F.concat(F.lit("pool at "), number(event % 50), F.lit("/50 connections")))
        .when(kind == "click", F.concat(F.lit("heap "), number(event % 300 + 200), F.lit("MB/512MB")))
        .when(kind == "purchase", F.concat(F.lit("request done duration="), number(user), F.lit("ms")))
        .when(kind == "signup", F.concat(F.lit("Disk usage at "), number(user % 100), F.lit("%")))
        .otherwise(F.concat(kind, F.lit(" by user "), number(user)))
    )
    return t.events.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("svc-"), number(user % 7)).alias("service"),
        event.alias("seq"),
        message.alias("message"),
    )


_POINTS_SQL = """points AS (
    SELECT timestamp, service, seq, 'connection_pool_exhaustion' AS metric,
           regexp_extract(message, '(\\d+)/(\\d+) connections', 1) AS v,
           regexp_extract(message, '(\\d+)/(\\d+) connections', 2) AS c
    FROM measured WHERE regexp_matches(message, '\\d+/\\d+ connections')
    UNION ALL
    SELECT timestamp, service, seq, 'memory_leak', regexp_extract(message, 'heap (\\d+)MB/(\\d+)MB', 1),
           regexp_extract(message, 'heap (\\d+)MB/(\\d+)MB', 2)
    FROM measured WHERE regexp_matches(message, 'heap \\d+MB/\\d+MB')
    UNION ALL
    SELECT timestamp, service, seq, 'rising_latency', regexp_extract(message, 'duration=(\\d+)ms', 1), ''
    FROM measured WHERE regexp_matches(message, 'duration=\\d+ms')
    UNION ALL
    SELECT timestamp, service, seq, 'disk_usage_growth', regexp_extract(message, 'usage at (\\d+)%', 1), ''
    FROM measured WHERE regexp_matches(message, 'usage at \\d+%'))"""

_METRIC_WINDOWS_SQL = """windows AS (
    SELECT date_trunc('day', timestamp) AS window_start, service, metric, count(*) AS n_points,
           max(v::DOUBLE) AS max_value, max(v::DOUBLE / nullif(c, '')::DOUBLE) AS max_ratio
    FROM points GROUP BY 1, 2, 3)"""


@query(
    with_log(
        f"""
SELECT {sql_second("window_start")} AS window_start, service, metric, n_points, max_value,
       round(max_ratio, 6) AS max_ratio
FROM windows""",
        _MEASURED_SQL,
        _POINTS_SQL,
        _METRIC_WINDOWS_SQL,
    )
)
def metric_windows(t: Tables) -> DataFrame:
    found = trends.metric_windows(trends.metric_points(_measured(t)), "1 day", ["service"])
    return found.select(
        second("window_start").alias("window_start"),
        "service",
        "metric",
        "n_points",
        "max_value",
        F.round("max_ratio", 6).alias("max_ratio"),
    )


@query(
    with_log(
        f"""
SELECT service, metric, run, count(*) AS n_windows, {sql_second("min(window_start)")} AS started_at,
       max(max_value) AS peak, round(regr_slope(max_value, epoch(window_start) / 3600.0), 6) AS per_hour
FROM (SELECT *, sum(CASE WHEN fell THEN 1 ELSE 0 END)
                  OVER (PARTITION BY service, metric ORDER BY window_start)::BIGINT AS run
      FROM (SELECT *, max_value < 0.9 * lag(max_value)
                        OVER (PARTITION BY service, metric ORDER BY window_start) AS fell FROM windows))
GROUP BY 1, 2, 3""",
        _MEASURED_SQL,
        _POINTS_SQL,
        _METRIC_WINDOWS_SQL,
    )
)
def growth_runs(t: Tables) -> DataFrame:
    windows = trends.metric_windows(trends.metric_points(_measured(t)), "1 day", ["service"])
    found = trends.growth_runs(windows, ["service", "metric"], drop_to=0.9)
    return found.select(
        "service",
        "metric",
        "run",
        "n_windows",
        second("started_at").alias("started_at"),
        "peak",
        F.round("per_hour", 6).alias("per_hour"),
    )


@query(
    with_log(
        """
SELECT seq, problem, strategy, step::BIGINT AS step FROM classed
JOIN (VALUES ('memory_leak', 'restart', 1), ('memory_leak', 'increase_memory', 2), ('memory_leak', 'rollback', 3),
             ('database_connection', 'scale_pool', 1), ('database_connection', 'restart_db', 2),
             ('database_connection', 'check_config', 3),
             ('disk_space', 'cleanup', 1), ('disk_space', 'increase_volume', 2),
             ('disk_space', 'archive_logs', 3)) s(problem, strategy, step) USING (problem)""",
        _MEASURED_SQL,
        """classed AS (SELECT seq, CASE WHEN message LIKE '%heap%' THEN 'memory_leak'
               WHEN message LIKE '%connections%' THEN 'database_connection'
               WHEN message LIKE '%Disk%' THEN 'disk_space' END AS problem FROM measured)""",
    )
)
def problem_strategies(t: Tables) -> DataFrame:
    return trends.strategies(_measured(t), "message").select("seq", "problem", "strategy", "step")
