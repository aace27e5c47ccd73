"""Redaction, lines, levels, timestamps, field maps and JSON in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.catalogue.incidents import as_of
from faultline.catalogue.registry import Tables, query, second, sql_second, sql_stamp, stamp, with_log
from faultline.functions import json_text, levels, redact, text, tiers, timestamps
from faultline.operators import analysis, timeline, trends
from faultline.operators.remediation import request_commands, split_requests, with_remediation
from faultline.sources.tables import json_column, lines_of_column

# DuckDB's \b knows ASCII words only. The SQL fences letters beyond ASCII with marks
# whose outer characters are ASCII word characters, and takes the marks out again
# after the replacements, so that both sides see the same word bounds.
_MARKED_SQL = """marked AS (
    SELECT *, regexp_replace(text, '([\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)',
                             concat('_', chr(1), '_\\1_', chr(1), '_'), 'g') AS t
    FROM documents)"""

_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
_PHONE = r"\b(?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b"
_CARD = r"\b(?:\d[ \-]?){13,16}\b"
_SECRET = r"(?i)\b(?:api[_\-]?key|secret|token|password)\s*[=:]\s*\S+"
_BEARER = r"(?i)Bearer\s+[A-Za-z0-9\-._~+/]+=*"


def _redacted_sql(column: str) -> str:
    made = column
    for pattern, mark in [
        (_EMAIL, "[EMAIL]"),
        (_PHONE, "[PHONE]"),
        (_CARD, "[CARD]"),
        (_SECRET, "[REDACTED]"),
        (_BEARER, "[REDACTED]"),
    ]:
        made = f"regexp_replace({made}, '{pattern}', '{mark}', 'g')"
    return f"regexp_replace({made}, concat('_?', chr(1), '_?'), '', 'g')"


@query(f"WITH {_MARKED_SQL} SELECT doc_id, {_redacted_sql('t')} AS redacted FROM marked")
def redact_documents(t: Tables) -> DataFrame:
    return redact.with_redacted(t.spread("documents"), "text", "redacted").select("doc_id", "redacted")


@query(
    f"""
WITH {_MARKED_SQL}
SELECT source, count(*) AS n_documents,
       count(*) FILTER (WHERE regexp_matches(t, '{_EMAIL}')) AS n_email,
       count(*) FILTER (WHERE regexp_matches(t, '{_PHONE}')) AS n_phone,
       count(*) FILTER (WHERE regexp_matches(t, '{_CARD}')) AS n_card,
       count(*) FILTER (WHERE regexp_matches(t, '{_SECRET}')) AS n_secret,
       count(*) FILTER (WHERE regexp_matches(t, '{_BEARER}')) AS n_bearer
FROM marked GROUP BY 1"""
)
def pii_counts_by_source(t: Tables) -> DataFrame:
    found = redact.found_kinds(F.col("text"))
    return (
        t.spread("documents")
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("n_documents"),
            *[F.count_if(flag).alias(f"n_{kind}") for kind, flag in found.items()],
        )
    )


_LINES_SQL = """lines AS (
    SELECT doc_id, line_number, trim(line, E' \\t\\r\\n') AS line
    FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_number
          FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS parts FROM documents))
    WHERE trim(line, E' \\t\\r\\n') <> '')"""


@query(f"WITH {_LINES_SQL} SELECT doc_id, line_number, line FROM lines")
def document_lines(t: Tables) -> DataFrame:
    return lines_of_column(t.spread("documents"), "text", ["doc_id"])


_SYNTHETIC_SQL = """synthetic AS (
    SELECT seq, concat(strftime(timestamp, '%Y-%m-%d %H:%M:%S'), ' ', level, ' ', service, ': ', message,
                       CASE WHEN level = 'DEBUG' THEN ' after fatal error' WHEN level = 'INFO' THEN ' terror'
                            ELSE '' END) AS line
    FROM log_events)"""


def _synthetic(t: Tables) -> DataFrame:
    tail = (
        F.when(F.col("level") == "DEBUG", " after fatal error")
        .when(F.col("level") == "INFO", " terror")
        .otherwise("")
    )
    line = F.concat(
        second("timestamp"), F.lit(" "), "level", F.lit(" "), "service", F.lit(": "), "message", tail
    )
    return t.spread_log.select("seq", line.alias("line"))


@query(
    with_log(
        r"""
SELECT seq, CASE WHEN regexp_matches(line, '(?i)\bFATAL\b') THEN 'FATAL'
                 WHEN regexp_matches(line, '(?i)\bERROR\b') THEN 'ERROR'
                 WHEN regexp_matches(line, '(?i)\bWARN\b') THEN 'WARN'
                 WHEN regexp_matches(line, '(?i)\bWARNING\b') THEN 'WARNING'
                 WHEN regexp_matches(line, '(?i)\bINFO\b') THEN 'INFO'
                 WHEN regexp_matches(line, '(?i)\bDEBUG\b') THEN 'DEBUG'
                 WHEN regexp_matches(line, '(?i)\bTRACE\b') THEN 'TRACE' END AS level,
       upper(nullif(regexp_extract(line, '(?i)\b(FATAL|ERROR|WARN|WARNING|INFO|DEBUG|TRACE)\b', 1), ''))
         AS level_token
FROM synthetic""",
        _SYNTHETIC_SQL,
    )
)
def level_of_lines(t: Tables) -> DataFrame:
    line = F.col("line")
    return _synthetic(t).select(
        "seq",
        levels.level_by_priority(line).alias("level"),
        levels.level_by_position(line).alias("level_token"),
    )


@query(
    with_log(
        r"""
SELECT seq, regexp_extract(line, '^\S+ \S+ (\w+) ([\w-]+): (.*)$', 1) AS line_level,
       regexp_extract(line, '^\S+ \S+ (\w+) ([\w-]+): (.*)$', 2) AS line_service,
       regexp_extract(line, '^\S+ \S+ (\w+) ([\w-]+): (.*)$', 3) AS line_text
FROM synthetic""",
        _SYNTHETIC_SQL,
    )
)
def line_parts(t: Tables) -> DataFrame:
    parts = trends.line_parts(F.col("line"))
    return _synthetic(t).select("seq", *[c.alias(name) for name, c in parts.items()])


_FORMATS = [
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "%Y-%m-%dT%H:%M:%S.%f"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "%Y-%m-%dT%H:%M:%S.%fZ"),
    ("dd/MM/yyyy HH:mm:ss", "%d/%m/%Y %H:%M:%S"),
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("EEE dd MMM yyyy", "%a %d %b %Y"),
]


@query(
    f"""
WITH written AS (
    SELECT event_id, CASE event_id % 8
        {" ".join(f"WHEN {i} THEN strftime(ts, '{sql}')" for i, (_, sql) in enumerate(_FORMATS))}
        END AS written FROM events)
SELECT event_id, {sql_stamp("coalesce(" + ", ".join(f"try_strptime(written, '{sql}')" for _, sql in _FORMATS[:-1])
       + ")")} AS parsed,
       {sql_second('''coalesce(
           try_strptime(nullif(regexp_extract(written, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}'), ''), '%Y-%m-%d %H:%M:%S'),
           try_strptime(nullif(regexp_extract(written, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}'), ''), '%Y-%m-%dT%H:%M:%S'),
           try_strptime(nullif(regexp_extract(written, '\\d{2}/\\d{2}/\\d{4} \\d{2}:\\d{2}:\\d{2}'), ''), '%d/%m/%Y %H:%M:%S'))''')} AS found
FROM written"""
)
def timestamp_formats(t: Tables) -> DataFrame:
    chain = F
    for i, (spark_format, _) in enumerate(_FORMATS):
        chain = chain.when(F.col("event_id") % 8 == i, F.date_format("ts", spark_format))
    written = t.spread("events").select("event_id", chain.otherwise(None).alias("written"))
    return written.select(
        "event_id",
        stamp(timestamps.parse_timestamp(F.col("written"))).alias("parsed"),
        second(timestamps.find_timestamp(F.concat(F.lit("at ["), F.col("written"), F.lit("] x")))).alias(
            "found"
        ),
    )


@query(f"SELECT event_id, {sql_second('date_trunc(' + chr(39) + 'second' + chr(39) + ', ts)')} AS at FROM events")
def epoch_timestamps(t: Tables) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    return t.events.select("event_id", second(timestamps.parse_seconds(seconds)).alias("at"))


# ---------------------------------------------------------------------------
# Field maps
# ---------------------------------------------------------------------------


def _field_json(t: Tables) -> DataFrame:
    """The event view as JSON objects whose field names differ by event type."""
    when, level, service, message = second("timestamp"), F.lower("level"), F.col("service"), F.col("message")
    number = F.col("seq")

    def body(*pairs) -> Column:
        return F.to_json(F.struct(*[value.alias(name) for name, value in pairs]))

    epoch = F.unix_timestamp("timestamp")
    kind = F.col("event_type")
    return t.spread_log.select(
        "seq",
        F.when(kind == "error", body(("timestamp", when), ("level", level), ("service", service), ("message", message), ("n", number)))
        .when(kind == "view", body(("@timestamp", when), ("severity", level), ("component", service), ("msg", message)))
        .when(kind == "signup", body(("time", epoch), ("log_level", level), ("module", service), ("text", message)))
        .when(kind == "click", body(("time", F.lit("soon")), ("date", when), ("priority", level), ("app", service), ("description", message), ("n", number)))
        .otherwise(body(("at", when), ("n", number)))
        .alias("body"),
    )


@query(
    with_log(
        f"""
SELECT seq,
       CASE e.event_type WHEN 'purchase' THEN '2024-02-01 00:00:00'
            ELSE {sql_second("l.timestamp")} END AS timestamp,
       e.event_type = 'purchase' AS ts_inferred,
       CASE e.event_type WHEN 'purchase' THEN 'INFO' ELSE l.level END AS level,
       CASE e.event_type WHEN 'purchase' THEN 'unknown' ELSE l.service END AS service,
       CASE e.event_type
            WHEN 'purchase' THEN concat('{{"at":"', {sql_second("l.timestamp")}, '","n":"', l.seq, '"}}')
            ELSE l.message END AS message,
       CASE e.event_type WHEN 'error' THEN concat('n=', l.seq) WHEN 'click' THEN concat('n=', l.seq)
            WHEN 'purchase' THEN concat('at=', {sql_second("l.timestamp")}, ',n=', l.seq) ELSE '' END AS metadata
FROM log_events l JOIN events e ON e.event_id = l.seq"""
    )
)
def normalize_fields(t: Tables) -> DataFrame:
    raw = json_column(_field_json(t), "body", ["seq"]).select(
        F.col("seq").alias("line_number"),
        F.lit("events").alias("source_file"),
        "fields",
        "seconds",
        F.lit(None).cast("string").alias("line"),
        F.lit(None).cast("string").alias("reason"),
    )
    events = timeline.to_events(raw, as_of())
    pairs = F.transform(
        F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return events.select(
        F.col("line_number").alias("seq"),
        second("timestamp").alias("timestamp"),
        "ts_inferred",
        "level",
        "service",
        "message",
        F.array_join(pairs, ",").alias("metadata"),
    )


# ---------------------------------------------------------------------------
# JSON in text
# ---------------------------------------------------------------------------

_REPLIES_SQL = """replies AS (
    SELECT event_id, event_type, CASE event_type
        WHEN 'click' THEN concat('Here it is: ', props, ' as asked.')
        WHEN 'view' THEN concat('```json', chr(10), props, chr(10), '```')
        WHEN 'signup' THEN concat('see ', props, ' or rather {"z": 1')
        WHEN 'purchase' THEN props
        ELSE concat('no object, only ', event_id) END AS reply
    FROM events)"""


def _replies(t: Tables) -> DataFrame:
    kind, props = F.col("event_type"), F.col("props")
    reply = (
        F.when(kind == "click", F.concat(F.lit("Here it is: "), props, F.lit(" as asked.")))
        .when(kind == "view", F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == "signup", F.concat(F.lit("see "), props, F.lit(' or rather {"z": 1')))
        .when(kind == "purchase", props)
        .otherwise(F.concat(F.lit("no object, only "), F.col("event_id").cast("string")))
    )
    return t.spread("events").select("event_id", reply.alias("reply"))


@query(
    f"""
WITH {_REPLIES_SQL}
SELECT event_id, nullif(regexp_extract(reply, '(?s)\\{{.*\\}}'), '') AS found,
       event_type <> 'error' AS valid,
       CASE WHEN event_type = 'error' THEN reply
            ELSE regexp_extract(reply, '(?s)\\{{.*\\}}') END AS block
FROM replies"""
)
def analysis_json_extract(t: Tables) -> DataFrame:
    reply = F.col("reply")
    return _replies(t).select(
        "event_id",
        json_text.outer_object(reply).alias("found"),
        json_text.holds_valid_json(reply).alias("valid"),
        json_text.json_block(reply).alias("block"),
    )


@query(
    f"""
WITH {_REPLIES_SQL}
SELECT event_id, CASE WHEN event_type = 'error'
       THEN concat('{{"error":"no JSON object found in the reply","raw_response":"', reply, '"}}')
       ELSE regexp_extract(reply, '\\{{[^}}]*\\}}') END AS found
FROM replies"""
)
def json_by_strategy(t: Tables) -> DataFrame:
    return json_text.extract_json(_replies(t), "reply", "found").drop("reply")


@query(
    f"""
WITH {_REPLIES_SQL}
SELECT event_id, CASE WHEN event_type = 'view' THEN regexp_extract(reply, '\\{{[^}}]*\\}}') ELSE reply END AS cleaned
FROM replies"""
)
def replies_without_fences(t: Tables) -> DataFrame:
    return _replies(t).select("event_id", json_text.strip_fences(F.col("reply")).alias("cleaned"))


# ---------------------------------------------------------------------------
# Tiers and commands
# ---------------------------------------------------------------------------


@query(
    """
WITH scored AS (SELECT event_id, event_type, least(value / 100.0, 1.5) AS score FROM events)
SELECT event_id,
       CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.7 THEN 'high'
            WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS severity,
       CASE WHEN score >= 0.85 THEN 'Highest' WHEN score >= 0.7 THEN 'High'
            WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END AS priority,
       CASE WHEN score >= 0.8 THEN 'green' WHEN score >= 0.6 THEN 'yellow' ELSE 'red' END AS display,
       CASE WHEN score >= 0.85 THEN 'Highest' WHEN score >= 0.7 THEN 'High'
            WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END AS issue_priority,
       CASE WHEN score >= 0.85 THEN '#dc143c' WHEN score >= 0.7 THEN '#ff6347'
            WHEN score >= 0.5 THEN '#daa520' ELSE '#36a64f' END AS colour,
       'High' AS default_priority, '#808080' AS default_colour, 'medium' AS default_severity,
       score BETWEEN 0 AND 1 AS valid
FROM scored"""
)
def confidence_tiers(t: Tables) -> DataFrame:
    score, severity = F.col("score"), F.col("severity")
    kind = F.col("event_type")
    scored = t.events.select(
        "event_id", "event_type", F.least(F.col("value") / 100.0, F.lit(1.5)).alias("score")
    ).withColumn("severity", tiers.severity_of_confidence(score))
    return scored.select(
        "event_id",
        "severity",
        tiers.priority_of_confidence(score).alias("priority"),
        tiers.display_of_confidence(score).alias("display"),
        tiers.priority_of_severity(severity).alias("issue_priority"),
        tiers.colour_of_severity(severity).alias("colour"),
        tiers.priority_of_severity(kind).alias("default_priority"),
        tiers.colour_of_severity(kind).alias("default_colour"),
        tiers.known_severity(kind).alias("default_severity"),
        tiers.valid_confidence(score).alias("valid"),
    )


@query(
    """
SELECT CASE WHEN coalesce(value / 100.0 BETWEEN 0 AND 1, false) THEN 'good' ELSE 'refused' END AS kind, count(*) AS n
FROM events GROUP BY 1"""
)
def confidence_check(t: Tables) -> DataFrame:
    scored = t.events.select((F.col("value") / 100.0).alias("confidence_score"))
    good, refused = analysis.split_by_confidence(scored)
    both = good.withColumn("kind", F.lit("good")).unionByName(refused.withColumn("kind", F.lit("refused")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_CAUSES_SQL = """causes AS (
    SELECT event_id, CASE event_type
        WHEN 'error' THEN concat('{"root_cause_description":"a NULL reference in build ', user_id,
                                 '","affected_components":["svc;', user_id, ' [CRITICAL]","db"]}')
        WHEN 'click' THEN concat('{"root_cause_description":"pool timeout","affected_components":[]}')
        WHEN 'view' THEN 'the Payment-Service was deployed again'
        ELSE concat('{"root_cause_description":"heap of user-service ', user_id, '"}') END AS analysis,
        event_type, user_id
    FROM events)"""


@query(
    f"""
WITH {_CAUSES_SQL}
SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 'undo' ELSE 'restart' END AS action,
       CASE event_type WHEN 'error' THEN concat('svc;', user_id) WHEN 'click' THEN 'auth-service'
            WHEN 'view' THEN 'payment-service' ELSE 'user-service' END AS service,
       concat('kubectl rollout ', CASE WHEN event_type IN ('error', 'view') THEN 'undo' ELSE 'restart' END,
              ' deployment/',
              CASE event_type WHEN 'error' THEN concat('svc', user_id) WHEN 'click' THEN 'auth-service'
                   WHEN 'view' THEN 'payment-service' ELSE 'user-service' END, ' -n default') AS command
FROM causes"""
)
def remediation_commands(t: Tables) -> DataFrame:


    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    cause = (
        F.when(
            kind == "error",
            F.concat(
                F.lit('{"root_cause_description":"a NULL reference in build '),
                user,
                F.lit('","affected_components":["svc;'),
                user,
                F.lit(' [CRITICAL]","db"]}'),
            ),
        )
        .when(kind == "click", '{"root_cause_description":"pool timeout","affected_components":[]}')
        .when(kind == "view", "the Payment-Service was deployed again")
        .otherwise(F.concat(F.lit('{"root_cause_description":"heap of user-service '), user, F.lit('"}')))
    )
    made = with_remediation(t.spread("events").select("event_id", cause.alias("analysis")))
    return made.drop("analysis")


_REQUESTS_SQL = """requests AS (
    SELECT p_partkey AS request, CASE p_partkey % 3 WHEN 0 THEN 'scale' WHEN 1 THEN 'rollback' ELSE 'restart' END AS tool,
           CASE WHEN p_size % 10 = 0 THEN '  ' ELSE concat(p_brand, ';rm -rf /') END AS service,
           p_type AS namespace, p_size - 5 AS replicas FROM part)"""


def _requests(t: Tables) -> DataFrame:
    key = F.col("p_partkey") % 3
    return t.table("part").select(
        F.col("p_partkey").alias("request"),
        F.when(key == 0, "scale").when(key == 1, "rollback").otherwise("restart").alias("tool"),
        F.when(F.col("p_size") % 10 == 0, "  ")
        .otherwise(F.concat("p_brand", F.lit(";rm -rf /")))
        .alias("service"),
        F.col("p_type").alias("namespace"),
        (F.col("p_size") - 5).alias("replicas"),
    )


@query(
    f"""
WITH {_REQUESTS_SQL}, clean AS (
    SELECT *, regexp_replace(service, '[^\\p{{L}}\\p{{N}}-]', '', 'g') AS s,
           regexp_replace(namespace, '[^\\p{{L}}\\p{{N}}-]', '', 'g') AS n
    FROM requests WHERE trim(service) <> '' AND replicas >= 0)
SELECT request, CASE tool
         WHEN 'scale' THEN concat('kubectl scale deployment/', s, ' --replicas=', replicas, ' -n ', n)
         WHEN 'rollback' THEN concat('kubectl rollout undo deployment/', s, ' -n ', n)
         ELSE concat('kubectl rollout restart deployment/', s, ' -n ', n) END AS command,
       s AS service, n AS namespace
FROM clean"""
)
def tool_commands(t: Tables) -> DataFrame:
    good, _ = split_requests(_requests(t))
    return request_commands(good).drop("tool", "replicas")


@query(
    f"""
WITH {_REQUESTS_SQL}
SELECT request, CASE WHEN trim(service) = '' THEN 'empty service name' ELSE 'negative replicas' END AS reason
FROM requests WHERE trim(service) = '' OR replicas < 0"""
)
def refused_requests(t: Tables) -> DataFrame:
    return split_requests(_requests(t))[1].select("request", "reason")


@query(
    with_log(
        """
SELECT seq, replace(concat(message, ' | ', service), '|', '\\|') AS escaped, left(message, 12) AS cut,
       trim(split_part(concat(message, ' [TAG] x'), '[', 1)) AS untagged
FROM log_events"""
    )
)
def text_helpers(t: Tables) -> DataFrame:
    message = F.col("message")
    return t.log_events.select(
        "seq",
        text.escape_pipe(F.concat(message, F.lit(" | "), "service")).alias("escaped"),
        text.cut_text(message, 12).alias("cut"),
        text.before_tag(F.concat(message, F.lit(" [TAG] x"))).alias("untagged"),
    )
