"""Incident reports and tickets as text columns, one row per incident."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.json_text import with_analysis
from faultline.functions.text import bullet_list, cut_text, escape_pipe, numbered_list, percent_text
from faultline.functions.timestamps import iso_text, timestamp_text
from faultline.operators.context import as_text, first_events, in_parts
from faultline.operators.metrics import ORDER
from faultline.schema import (
    HISTORY_ANSWER_CHARS,
    JSON_EVENTS,
    MARKDOWN_CHARS,
    MARKDOWN_EVENTS,
)

# Questions and answers that one report row holds.
HISTORY_PART = 500


def report_id(given: Column | None, analysis: Column, default: str) -> Column:
    """The given id, else the one in the analysis, else the default."""
    own = F.nullif(given, F.lit("")) if given is not None else F.lit(None).cast("string")
    return F.coalesce(own, analysis["incident_id"], F.lit(default))


def new_incident_id(day: Column, *parts: Column) -> Column:
    """``INC-yyyymmdd-xxxxxxxx``, the same for the same parts on every run."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(
        F.lit("INC-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), F.substring(digest, 1, 8)
    )


def timeline_table(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The first events as table rows."""
    row = F.concat(
        F.lit("| "),
        timestamp_text(F.col("timestamp")),
        F.lit(" | "),
        F.col("level"),
        F.lit(" | "),
        F.col("service"),
        F.lit(" | "),
        escape_pipe(cut_text(F.col("message"), MARKDOWN_CHARS)),
        F.lit(" |"),
    )
    return as_text(first_events(events, MARKDOWN_EVENTS, order), row, "rows")


def history_parts(history: DataFrame, per_part: int = HISTORY_PART) -> DataFrame:
    """Questions with shortened answers (``incident_id``, ``rn``, ``question``, ``answer``)."""
    entry = F.concat(
        F.lit("**Q:** "),
        F.col("question"),
        F.lit("\n\n> "),
        cut_text(F.col("answer"), HISTORY_ANSWER_CHARS),
        F.lit("\n"),
    )
    return as_text(in_parts(history, per_part), entry, "history", ["incident_id", "part"])


def markdown_reports(
    analyses: DataFrame,
    events: DataFrame,
    generated_at: Column,
    history: DataFrame | None = None,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """A Markdown report per incident (``incident_id``, ``analysis``, ``command``).

    ``history`` holds numbered questions and answers. The first part of them is
    in the report; a longer history goes on in rows of its own (``part`` 2, 3, ...).
    """
    base = with_analysis(analyses).join(
        timeline_table(events, order), "incident_id", "left"
    )
    if history is not None:
        parts = history_parts(history)
        first = parts.filter("part = 1").select("incident_id", "history")
        base = base.join(first, "incident_id", "left")
    else:
        base = base.withColumn("history", F.lit(None).cast("string"))
    a, command = F.col("_a"), F.col("command")
    steps = a["remediation_steps"]
    components = F.coalesce(a["affected_components"], F.array(F.lit("Unknown")))
    report = F.concat_ws(
        "\n",
        F.lit("# Incident report\n"),
        F.concat(F.lit("**Incident ID:** "), report_id(F.col("incident_id"), a, "N/A")),
        F.concat(F.lit("**Generated:** "), timestamp_text(generated_at), F.lit(" UTC")),
        F.concat(
            F.lit("**Confidence:** "),
            percent_text(F.coalesce(a["confidence_score"], F.lit(0.0)), 1),
        ),
        F.lit("\n## Summary\n"),
        F.coalesce(a["summary"], F.lit("There is no summary.")),
        F.lit("\n## Root cause\n"),
        F.coalesce(a["root_cause_description"], F.lit("The root cause is not known.")),
        F.lit("\n## Affected components\n"),
        F.when(F.size(components) > 0, bullet_list(components, "- ")),
        F.lit("\n## Timeline\n\n| Time | Level | Service | Message |\n|---|---|---|---|"),
        F.col("rows"),
        F.lit("\n## Remediation\n"),
        F.when(
            command.isNotNull() & (command != ""),
            F.concat(F.lit("**Command:**\n```bash\n"), command, F.lit("\n```")),
        ),
        F.when(F.size(steps) > 0, F.concat(F.lit("\n**Steps:**\n"), numbered_list(steps))),
        F.when(
            F.col("history").isNotNull(),
            F.concat(F.lit("\n## Questions and answers\n\n"), F.col("history")),
        ),
    )
    if history is None:
        return base.select("incident_id", report.alias("report"))
    further = parts.filter("part > 1").select("incident_id", "part", F.col("history").alias("report"))
    return base.select(
        "incident_id", F.lit(1).cast("long").alias("part"), report.alias("report")
    ).unionByName(further)


def json_timeline(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The first events of every incident as an array, in time order."""
    entry = F.struct(
        timestamp_text(F.col("timestamp")).alias("timestamp"), "level", "service", "message"
    )
    return (
        first_events(events, JSON_EVENTS, order)
        .groupBy("incident_id")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rn", entry.alias("e")))), lambda s: s["e"]
            ).alias("timeline")
        )
    )


def json_reports(
    analyses: DataFrame,
    events: DataFrame,
    generated_at: Column,
    history: DataFrame | None = None,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """A JSON report per incident (``incident_id``, ``analysis``, ``command``).

    A history longer than one part goes on in rows of its own, as in Markdown.
    """
    base = with_analysis(analyses).join(
        json_timeline(events, order), "incident_id", "left"
    )
    asked = "array<struct<question:string,answer:string,timestamp:string>>"
    if history is not None:
        entry = F.struct(
            "question",
            "answer",
            F.coalesce(F.col("timestamp").cast("string"), F.lit("")).alias("timestamp"),
        )
        parts = in_parts(history, HISTORY_PART).groupBy("incident_id", "part").agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rn", entry.alias("e")))), lambda s: s["e"]
            ).alias("investigation")
        )
        base = base.join(parts.filter("part = 1").drop("part"), "incident_id", "left")
    else:
        base = base.withColumn("investigation", F.lit(None).cast(asked))
    a = F.col("_a")
    texts = "array<string>"
    events_type = "array<struct<timestamp:string,level:string,service:string,message:string>>"
    report = F.struct(
        F.lit("1.0").alias("report_version"),
        iso_text(generated_at).alias("generated_at"),
        report_id(F.col("incident_id"), a, "").alias("incident_id"),
        F.coalesce(a["summary"], F.lit("")).alias("summary"),
        F.struct(
            F.coalesce(a["root_cause_description"], F.lit("")).alias("description"),
            F.coalesce(a["confidence_score"], F.lit(0.0)).alias("confidence_score"),
        ).alias("root_cause"),
        F.coalesce(a["affected_components"], F.array().cast(texts)).alias("affected_components"),
        F.struct(
            F.coalesce("command", F.lit("")).alias("command"),
            F.coalesce(a["remediation_steps"], F.array().cast(texts)).alias("steps"),
        ).alias("remediation"),
        F.coalesce("timeline", F.array().cast(events_type)).alias("timeline"),
        F.coalesce("investigation", F.array().cast(asked)).alias("investigation"),
    )
    if history is None:
        return base.select("incident_id", F.to_json(report).alias("report"))
    further = parts.filter("part > 1").select(
        "incident_id",
        "part",
        F.to_json(F.struct("incident_id", "part", "investigation")).alias("report"),
    )
    return base.select(
        "incident_id", F.lit(1).cast("long").alias("part"), F.to_json(report).alias("report")
    ).unionByName(further)


def reports(analyses: DataFrame, events: DataFrame, generated_at: Column, kind: str, **more) -> DataFrame:
    """Reports of the kind ``markdown`` or ``json``."""
    made = json_reports if kind.lower() == "json" else markdown_reports
    return made(analyses, events, generated_at, **more)


def tickets(analyses: DataFrame, generated_at: Column) -> DataFrame:
    """A Markdown ticket per incident (``incident_id``, ``analysis``, ``command``)."""
    a = F.col("_a")
    components = F.coalesce(a["affected_components"], F.array(F.lit("unknown")))
    text = F.concat_ws(
        "\n",
        F.lit("### Incident ticket\n"),
        F.concat(F.lit("**Summary:** "), F.coalesce(a["summary"], F.lit("N/A"))),
        F.concat(
            F.lit("\n**Root cause:**\n"), F.coalesce(a["root_cause_description"], F.lit("N/A"))
        ),
        F.concat(F.lit("\n**Affected components:**\n"), bullet_list(components, "• ")),
        F.concat(
            F.lit("\n**Confidence:** "),
            percent_text(F.coalesce(a["confidence_score"], F.lit(0.0)), 1),
        ),
        F.concat(
            F.lit("\n**Remediation:**\n```bash\n"), F.coalesce("command", F.lit("")), F.lit("\n```")
        ),
        F.concat(F.lit("\n**Generated:** "), timestamp_text(generated_at), F.lit(" UTC")),
    )
    return with_analysis(analyses).select("incident_id", text.alias("ticket"))


def issue_description(
    description: Column, services: Column, steps: Column, generated_at: Column
) -> Column:
    """The body of an issue, in wiki markup."""

    def listed(items: Column, mark: str, nothing: str) -> Column:
        return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, bullet_list(items, mark)).otherwise(
            mark + nothing
        )

    return F.concat_ws(
        "\n",
        F.lit("h3. Incident\n"),
        description,
        F.lit("\nh4. Services"),
        listed(services, "* ", "N/A"),
        F.lit("\nh4. Steps"),
        listed(steps, "# ", "no automated remediation"),
        F.concat(F.lit("\n----\n_Generated at "), iso_text(generated_at), F.lit("_")),
    )
