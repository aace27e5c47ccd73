"""Reports, tickets, outbox payloads and analysis replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.catalogue.incidents import as_of
from faultline.catalogue.questions import rule_analyses
from faultline.catalogue.registry import Tables, query, sql_second, with_log
from faultline.operators import alerts, analysis, context, metrics, outbox, remediation, reports
from faultline.functions.json_text import with_prediction

# Within a quoted text of a concat().
_CAUSE = "', n_errors, ' of ', n_events, ' events are errors; no single cause is named by rule."

_STATS_SQL = """stats AS (
    SELECT incident_id, count(*) AS n_events, count(*) FILTER (WHERE level = 'ERROR') AS n_errors,
           concat('Counted: ', count(*) FILTER (WHERE level = 'ERROR'), ' errors, ', count(*), ' events.')
             AS summary
    FROM log_events GROUP BY 1)"""

_NUMBERED_SQL = """numbered AS (
    SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, seq) AS rn FROM log_events)"""

_COMMAND = "kubectl rollout restart deployment/auth-service -n default"


def _analysed(t: Tables) -> DataFrame:
    return remediation.with_remediation(rule_analyses(t)).drop("action", "service")


@query(
    with_log(
        f"""
SELECT incident_id, concat('{{"summary":"', summary, '","root_cause_description":"{_CAUSE}",',
    '"affected_components":["auth-service","database"],"confidence_score":0.85}}') AS analysis
FROM stats""",
        _STATS_SQL,
    )
)
def rule_based_analyses(t: Tables) -> DataFrame:
    return rule_analyses(t)


@query(
    with_log(
        f"""
SELECT s.incident_id, concat_ws(chr(10), '# Incident report', '',
    concat('**Incident ID:** ', s.incident_id), '**Generated:** 2024-02-01 00:00:00 UTC', '**Confidence:** 85.0%',
    '', '## Summary', '', summary, '', '## Root cause', '', concat('{_CAUSE}'), '', '## Affected components', '',
    '- auth-service', '- database', '', '## Timeline', '', '| Time | Level | Service | Message |', '|---|---|---|---|',
    t.rows, '', '## Remediation', '', '**Command:**', '```bash', '{_COMMAND}', '```') AS report
FROM stats s JOIN (
    SELECT incident_id, string_agg(concat('| ', {sql_second("timestamp")}, ' | ', level, ' | ', service, ' | ',
                                          replace(left(message, 80), '|', '\\|'), ' |'), chr(10) ORDER BY rn) AS rows
    FROM numbered WHERE rn <= 25 GROUP BY 1) t USING (incident_id)""",
        _STATS_SQL,
        _NUMBERED_SQL,
    )
)
def report_markdown(t: Tables) -> DataFrame:
    return reports.reports(_analysed(t), t.log_events, as_of(), "markdown")


@query(
    with_log(
        f"""
SELECT s.incident_id, concat('{{"report_version":"1.0","generated_at":"2024-02-01T00:00:00","incident_id":"',
    s.incident_id, '","summary":"', summary, '","root_cause":{{"description":"{_CAUSE}","confidence_score":0.85}},',
    '"affected_components":["auth-service","database"],"remediation":{{"command":"{_COMMAND}","steps":[]}},',
    '"timeline":[', t.entries, '],"investigation":[]}}') AS report
FROM stats s JOIN (
    SELECT incident_id, string_agg(concat('{{"timestamp":"', {sql_second("timestamp")}, '","level":"', level,
        '","service":"', service, '","message":"', message, '"}}'), ',' ORDER BY rn) AS entries
    FROM numbered WHERE rn <= 50 GROUP BY 1) t USING (incident_id)""",
        _STATS_SQL,
        _NUMBERED_SQL,
    )
)
def report_json(t: Tables) -> DataFrame:
    return reports.reports(_analysed(t), t.log_events, as_of(), "json")


@query(
    with_log(
        f"""
SELECT incident_id, concat_ws(chr(10), '### Incident ticket', '', concat('**Summary:** ', summary), '',
    '**Root cause:**', concat('{_CAUSE}'), '', '**Affected components:**', '• auth-service', '• database', '',
    '**Confidence:** 85.0%', '', '**Remediation:**', '```bash', '{_COMMAND}', '```', '',
    '**Generated:** 2024-02-01 00:00:00 UTC') AS ticket
FROM stats""",
        _STATS_SQL,
    )
)
def tickets(t: Tables) -> DataFrame:
    return reports.tickets(_analysed(t), as_of())


_HOUR_ALERTS = """hourly AS (
    SELECT date_trunc('hour', timestamp) AS hour, count(*) AS n, count(*) FILTER (WHERE level = 'ERROR') AS e
    FROM log_events GROUP BY 1),
erring AS (
    SELECT hour, string_agg(service, ', ' ORDER BY f) AS services,
           string_agg(concat('"', service, '"'), ',' ORDER BY f) AS quoted
    FROM (SELECT date_trunc('hour', timestamp) AS hour, service, min((timestamp, seq)) AS f
          FROM log_events WHERE level = 'ERROR' GROUP BY 1, 2) GROUP BY 1),
alerts AS (
    SELECT strftime(hour, '%Y%m%d%H') AS incident_id, services, quoted,
           CASE WHEN e / n > 0.25 THEN 'critical' ELSE 'high' END AS severity,
           concat('Share of errors above the limit: ', printf('%.0f%%', e / n * 100)) AS description, n, e
    FROM hourly JOIN erring USING (hour) WHERE e / n > 0.15)"""


def _hour_alerts(t: Tables) -> DataFrame:
    hourly = t.log_events.withColumn("incident_id", F.date_format("timestamp", "yyyyMMddHH"))
    return alerts.error_rate_alerts(hourly, as_of())


# Within a quoted text of a concat().
_FIRST = "Begin with ', split_part(services, ', ', 1), ', the first to fail"
_COUNT = "Find what changed before these ', e, ' errors"
_ACTIONS_TEXT = f"• {_FIRST}\\n• {_COUNT}"
_ACTIONS_JSON = f'"{_FIRST}","{_COUNT}"'


@query(
    with_log(
        f"""
SELECT incident_id, 'chat_alert' AS kind, 'dry_run' AS mode, true AS ok,
    concat('{{"channel":"#incidents","attachments":[{{"color":"',
        CASE severity WHEN 'critical' THEN '#dc143c' ELSE '#ff6347' END,
        '","blocks":[{{"type":"header","text":{{"type":"plain_text","text":"Alert: increasing_errors"}}}},',
        '{{"type":"section","fields":[{{"type":"mrkdwn","text":"*Grade*\\n', upper(severity),
        '"}},{{"type":"mrkdwn","text":"*Affected*\\n', services,
        '"}}]}},{{"type":"section","text":{{"type":"mrkdwn","text":"', description,
        '"}}}},{{"type":"section","text":{{"type":"mrkdwn","text":"*What to do next*\\n{_ACTIONS_TEXT}"}}}}]}}]}}') AS payload
FROM alerts""",
        _HOUR_ALERTS,
    )
)
def chat_alert_payloads(t: Tables) -> DataFrame:
    return outbox.chat_alerts(_hour_alerts(t), key="incident_id")


@query(
    with_log(
        """
SELECT incident_id, '$.blocks' AS part, header, length(section) AS section_chars, 'dry_run' AS mode FROM (
    SELECT s.incident_id, concat('Incident report ', s.incident_id) AS header,
           left(string_agg(concat(rn, ' ', message, ' ', repeat('x', 60)), chr(10) ORDER BY rn), 3000) AS section
    FROM stats s JOIN numbered USING (incident_id) WHERE rn <= 50 GROUP BY 1)""",
        _STATS_SQL,
        _NUMBERED_SQL,
    )
)
def chat_report_payloads(t: Tables) -> DataFrame:
    line = F.concat(F.col("rn").cast("string"), F.lit(" "), "message", F.lit(" " + "x" * 60))
    bodies = context.as_text(context.first_events(t.log_events, 50), line, "report")
    sent = outbox.chat_reports(bodies, as_of())
    return sent.select(
        "incident_id",
        F.lit("$.blocks").alias("part"),
        F.get_json_object("payload", "$.blocks[0].text.text").alias("header"),
        F.length(F.get_json_object("payload", "$.blocks[1].text.text")).cast("long").alias("section_chars"),
        "mode",
    )


@query(
    with_log(
        """
SELECT incident_id, 'dry_run' AS mode, 'INC' AS project, 'Bug' AS issuetype,
       concat('[Incident] ', description) AS summary,
       CASE severity WHEN 'critical' THEN 'Highest' ELSE 'High' END AS priority,
       '["auto-generated","incident"]' AS labels,
       concat_ws(chr(10), 'h3. Incident', '', description, '', 'h4. Services',
                 concat('* ', replace(services, ', ', concat(chr(10), '* '))), '', 'h4. Steps',
                 '# no automated remediation', '', '----', '_Generated at 2024-02-01T00:00:00_') AS description
FROM alerts""",
        _HOUR_ALERTS,
    )
)
def issue_payloads(t: Tables) -> DataFrame:
    found = _hour_alerts(t).select(
        "incident_id",
        F.col("description").alias("summary"),
        "description",
        "severity",
        F.col("affected_services").alias("services"),
        F.array().cast("array<string>").alias("steps"),
    )
    made = outbox.issues(found, as_of())

    def field(path: str) -> Column:
        return F.get_json_object("payload", f"$.fields.{path}")

    return made.select(
        "incident_id",
        "mode",
        field("project.key").alias("project"),
        field("issuetype.name").alias("issuetype"),
        field("summary").alias("summary"),
        field("priority.name").alias("priority"),
        field("labels").alias("labels"),
        field("description").alias("description"),
    )


@query(
    """
SELECT concat('INC-', conv_id) AS ticket_key, 'issue_comment' AS kind, 'dry_run' AS mode,
       md5(concat('*Incident update*', chr(10), chr(10), text, chr(10), chr(10),
                  '_Updated at 2024-02-01T00:00:00_')) AS body
FROM conversations"""
)
def issue_comment_payloads(t: Tables) -> DataFrame:
    comments = t.table("conversations").select(
        F.concat(F.lit("INC-"), F.col("conv_id").cast("string")).alias("ticket_key"),
        F.col("text").alias("comment"),
    )
    made = outbox.issue_comments(comments, as_of())
    body = F.get_json_object("payload", "$.comment.body")
    return made.select("ticket_key", "kind", "mode", F.md5(body).alias("body"))


@query(
    with_log(
        f"""
SELECT incident_id, concat('{{"status":"success","session_id":"', incident_id, '","analysis":{{"summary":"', summary,
    '","root_cause_description":"{_CAUSE}","affected_components":["auth-service","database"],',
    '"confidence_score":0.85}},"remediation_command":"{_COMMAND}","trial_remaining":',
    greatest(0, 100 - n_errors), '}}') AS response
FROM stats""",
        _STATS_SQL,
    )
)
def analysis_responses(t: Tables) -> DataFrame:
    usage = metrics.error_stats(t.log_events).select("incident_id", F.col("n_errors").alias("used"))
    return outbox.analysis_responses(_analysed(t), usage)


@query(
    with_log(
        f"""
SELECT incident_id, concat('{{"status":"success","events_processed":', n,
    ',"abnormal_trends":[{{"type":"increasing_errors","severity":"', severity, '","description":"', description,
    '","affected_services":[', quoted, '],"actions":[{_ACTIONS_JSON}]}}]}}') AS response
FROM alerts""",
        _HOUR_ALERTS,
    )
)
def monitoring_responses(t: Tables) -> DataFrame:
    found = _hour_alerts(t)
    scans = found.select("incident_id").distinct()
    hourly = t.log_events.withColumn("incident_id", F.date_format("timestamp", "yyyyMMddHH"))
    return outbox.status_responses(metrics.scan_status(scans, hourly), found)


# ---------------------------------------------------------------------------
# Replies of a completion function
# ---------------------------------------------------------------------------


def _stub(prompt: str) -> str:
    """A completion function that judges a prompt by its number of warnings."""
    warnings = prompt.count(" [WARN] ")
    if "[FATAL]" in prompt:
        return "Error: the service refused"
    if warnings < 3:
        return "safe"
    severity = "HIGH" if warnings > 6 else "odd"
    return f'As asked: {{"issue_detected": true, "severity": "{severity}", "description": "{warnings} warnings"}}'


_TAIL_SQL = """tails AS (
    SELECT incident_id, count(*) FILTER (WHERE level = 'WARN') AS warnings,
           count(*) FILTER (WHERE level = 'FATAL') AS fatals
    FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY timestamp DESC, seq DESC) AS back,
                 count(*) OVER (PARTITION BY incident_id) AS n FROM log_events)
    WHERE n > 5 AND back <= 30 GROUP BY 1)"""


def _replies(t: Tables) -> DataFrame:
    return analysis.complete(context.prediction_prompts(t.log_events), _stub)


@query(
    with_log(
        """
SELECT incident_id, 'performance_degradation' AS trend_type,
       CASE WHEN warnings > 6 THEN 'high' ELSE 'medium' END AS severity, 'unknown' AS affected_services,
       concat(warnings, ' warnings') AS description, 0.7::DOUBLE AS confidence
FROM tails WHERE fatals = 0 AND warnings >= 3""",
        _TAIL_SQL,
    )
)
def predicted_alerts(t: Tables) -> DataFrame:
    parsed = with_prediction(_replies(t))
    found = alerts.predicted_alerts(parsed, as_of())
    return found.select(
        "incident_id",
        "trend_type",
        "severity",
        F.array_join("affected_services", ", ").alias("affected_services"),
        "description",
        "trend.confidence",
    )


@query(
    with_log(
        """
SELECT trend_type, count(*) AS n FROM (
    SELECT 'increasing_errors' AS trend_type FROM stats WHERE n_errors / n_events > 0.15
    UNION ALL
    SELECT 'performance_degradation' FROM tails WHERE fatals = 0 AND warnings >= 3)
GROUP BY 1""",
        _STATS_SQL,
        _TAIL_SQL,
    )
)
def alerts_of_both_kinds(t: Tables) -> DataFrame:
    parsed = with_prediction(_replies(t))
    both = alerts.all_alerts(
        alerts.error_rate_alerts(t.log_events, as_of()), alerts.predicted_alerts(parsed, as_of())
    )
    return both.groupBy("trend_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_log(
        """
SELECT s.incident_id, coalesce(fatals = 0 AND warnings >= 3, false) AS from_reply,
       CASE WHEN fatals = 0 AND warnings >= 3 THEN NULL ELSE summary END AS summary
FROM stats s LEFT JOIN tails USING (incident_id)""",
        _STATS_SQL,
        _TAIL_SQL,
    )
)
def chosen_analyses(t: Tables) -> DataFrame:
    chosen = analysis.choose_analysis(_replies(t), rule_analyses(t))
    return chosen.select(
        "incident_id", "from_reply", F.get_json_object("analysis", "$.summary").alias("summary")
    )


@query(
    with_log(
        """
SELECT seq, concat('INC-', incident_id, '-', left(sha256(concat(incident_id, '|', seq)), 8)) AS id,
       coalesce(CASE WHEN level = 'INFO' THEN NULL ELSE level END, 'N/A') AS report_id
FROM log_events"""
    )
)
def incident_ids(t: Tables) -> DataFrame:
    own = F.struct(F.lit(None).cast("string").alias("incident_id"))
    given = F.when(F.col("level") == "INFO", "").otherwise(F.col("level"))
    return t.log_events.select(
        "seq",
        reports.new_incident_id(
            F.col("timestamp"), F.col("incident_id"), F.col("seq").cast("string")
        ).alias("id"),
        reports.report_id(given, own, "N/A").alias("report_id"),
    )
