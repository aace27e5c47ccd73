"""Messages to chat and issue trackers as rows of an outbox table.

Nothing is sent: rows carry ``mode = 'dry_run'`` and the payload. Delivery is left
to a ``foreachBatch`` or a writer of the user's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.json_text import with_analysis
from faultline.functions.text import bullet_list, cut_text
from faultline.functions.timestamps import iso_text
from faultline.functions.tiers import colour_of_severity, priority_of_severity
from faultline.operators.reports import issue_description
from faultline.sources.scenarios import with_scenario
from faultline.schema import (
    CHAT_REPORT_CHARS,
    CLIENT_QUOTA,
    LABEL_ACTIONS,
    LABEL_SERVICES,
    LABEL_SEVERITY,
)

DEFAULT_LABELS = ["auto-generated", "incident"]


def _outbox(df: DataFrame, key: str, kind: str, payload: Column) -> DataFrame:
    return df.select(
        key,
        F.lit(kind).alias("kind"),
        F.lit("dry_run").alias("mode"),
        F.lit(True).alias("ok"),
        F.to_json(payload).alias("payload"),
    )


_TEXT = "struct<type:string,text:string>"


def _text(text: Column, kind: str = "mrkdwn") -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"))


def _block(
    kind: str,
    text: Column | None = None,
    fields: list[Column] | None = None,
    elements: list[Column] | None = None,
) -> Column:
    """One block of a chat message; members that are null do not appear in the JSON."""

    def several(items: list[Column] | None) -> Column:
        return F.array(*items) if items else F.lit(None).cast(f"array<{_TEXT}>")

    return F.struct(
        F.lit(kind).alias("type"),
        (text if text is not None else F.lit(None).cast(_TEXT)).alias("text"),
        several(fields).alias("fields"),
        several(elements).alias("elements"),
    )


def chat_alerts(alerts: DataFrame, key: str = "alert_id", channel: str = "#incidents") -> DataFrame:
    """One message per alert, coloured by severity."""
    services = F.coalesce(F.nullif(F.array_join("affected_services", ", "), F.lit("")), F.lit("N/A"))
    actions = F.coalesce("recommended_actions", F.array().cast("array<string>"))
    severity = F.concat(F.lit(LABEL_SEVERITY), F.upper("severity"))
    todo = F.concat(F.lit(LABEL_ACTIONS), bullet_list(actions, "• "))
    blocks = F.filter(
        F.array(
            _block("header", _text(F.concat(F.lit("Alert: "), F.col("trend_type")), "plain_text")),
            _block(
                "section", fields=[_text(severity), _text(F.concat(F.lit(LABEL_SERVICES), services))]
            ),
            _block("section", _text(F.col("description"))),
            F.when(F.size(actions) > 0, _block("section", _text(todo))),
        ),
        lambda block: block.isNotNull(),
    )
    payload = F.struct(
        F.lit(channel).alias("channel"),
        F.array(
            F.struct(colour_of_severity(F.col("severity")).alias("color"), blocks.alias("blocks"))
        ).alias("attachments"),
    )
    return _outbox(alerts, key, "chat_alert", payload)


def chat_reports(
    reports: DataFrame, generated_at: Column, channel: str = "#incidents"
) -> DataFrame:
    """One message per report, its body cut to what a message can hold."""
    title = F.concat(F.lit("Incident report "), F.col("incident_id"))
    made = F.concat(F.lit("Generated at "), iso_text(generated_at))
    payload = F.struct(
        F.lit(channel).alias("channel"),
        F.array(
            _block("header", _text(title, "plain_text")),
            _block("section", _text(cut_text(F.col("report"), CHAT_REPORT_CHARS))),
            _block("context", elements=[_text(made)]),
        ).alias("blocks"),
    )
    return _outbox(reports, "incident_id", "chat_report", payload)


def issues(
    incidents: DataFrame,
    generated_at: Column,
    project: str = "INC",
    prefix: str = "[Incident] ",
    labels: str | None = None,
) -> DataFrame:
    """One new issue per row: ``incident_id, summary, description, severity, services, steps``."""
    default = F.array(*[F.lit(label) for label in DEFAULT_LABELS])
    own = F.col(labels) if labels else F.lit(None).cast("array<string>")
    fields = F.struct(
        F.struct(F.lit(project).alias("key")).alias("project"),
        F.struct(F.lit("Bug").alias("name")).alias("issuetype"),
        F.concat(F.lit(prefix), F.col("summary")).alias("summary"),
        issue_description(
            F.col("description"), F.col("services"), F.col("steps"), generated_at
        ).alias("description"),
        F.struct(priority_of_severity(F.col("severity")).alias("name")).alias("priority"),
        F.coalesce(F.when(F.size(own) > 0, own), default).alias("labels"),
    )
    key = F.concat(
        F.lit(f"{project}-"), F.pmod(F.xxhash64("incident_id"), F.lit(10000)).cast("string")
    )
    return _outbox(incidents, "incident_id", "issue", F.struct(fields.alias("fields"))).withColumn(
        "key", key
    )


def issue_comments(comments: DataFrame, generated_at: Column) -> DataFrame:
    """One comment per row of ``ticket_key``, ``comment``."""
    body = F.concat(
        F.lit("*Incident update*\n\n"),
        F.col("comment"),
        F.lit("\n\n_Updated at "),
        iso_text(generated_at),
        F.lit("_"),
    )
    payload = F.struct("ticket_key", F.struct(body.alias("body")).alias("comment"))
    return _outbox(comments, "ticket_key", "issue_comment", payload)


def analysis_responses(analyses: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """The response to an analysis: status, parsed analysis, command and what is left.

    ``usage`` holds ``incident_id`` and ``used``, the analyses of its client so far.
    """
    base = with_analysis(analyses)
    if usage is not None:
        base = base.join(usage.select("incident_id", "used"), "incident_id", "left")
    else:
        base = base.withColumn("used", F.lit(0))
    response = F.struct(
        F.lit("success").alias("status"),
        F.col("incident_id").alias("session_id"),
        F.col("_a").alias("analysis"),
        F.col("command").alias("remediation_command"),
        F.greatest(F.lit(0), F.lit(CLIENT_QUOTA) - F.coalesce("used", F.lit(0))).alias(
            "trial_remaining"
        ),
    )
    return base.select("incident_id", F.to_json(response).alias("response"))


def scenario_responses(analyses: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The response to a scenario: its description, the parsed analysis and the command.

    ``analyses`` has one row per ``scenario``; unknown scenarios are dropped.
    """
    described = with_scenario(
        with_analysis(analyses).select(
            "scenario", F.col("_a").alias("_analysis"), F.col("command").alias("_command")
        ),
        catalogue,
    )
    metadata = F.struct(*[c for c in catalogue.columns if c != "scenario"])
    response = F.struct(
        F.lit(True).alias("demo"),
        F.col("scenario"),
        metadata.alias("metadata"),
        F.col("_analysis").alias("analysis"),
        F.col("_command").alias("remediation_command"),
    )
    return described.select("scenario", F.to_json(response).alias("response"))


def flat_alerts(alerts: DataFrame, keys: list[str]) -> DataFrame:
    """Alerts with the five fields that a status page shows."""
    return alerts.select(
        *keys,
        F.col("trend_type").alias("type"),
        "severity",
        "description",
        "affected_services",
        F.col("recommended_actions").alias("actions"),
    )


def status_responses(scans: DataFrame, alerts: DataFrame) -> DataFrame:
    """Status, events processed and flat alerts of each scan (``incident_id``)."""
    flat = flat_alerts(alerts, ["incident_id"])
    entry = F.struct("type", "severity", "description", "affected_services", "actions")
    gathered = flat.groupBy("incident_id").agg(
        F.sort_array(F.collect_list(entry)).alias("abnormal_trends")
    )
    empty = F.array().cast(
        "array<struct<type:string,severity:string,description:string,"
        "affected_services:array<string>,actions:array<string>>>"
    )
    body = F.struct(
        "status", "events_processed", F.coalesce("abnormal_trends", empty).alias("abnormal_trends")
    )
    return scans.join(gathered, "incident_id", "left").select(
        "incident_id", F.to_json(body).alias("response")
    )
