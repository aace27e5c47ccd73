"""Remediation requests: what to do, on which service, and whether it is allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.commands import (
    clean_name,
    first_known_service,
    invalid_request,
    remediation_action,
    rollout_command,
    scale_command,
)
from faultline.functions.json_text import with_analysis
from faultline.functions.text import before_tag


def with_remediation(analyses: DataFrame, namespace: str = "default") -> DataFrame:
    """Action, service and command for each ``analysis`` text.

    Without a root cause the whole text is searched for the action; without an
    affected component it is searched for a known service.
    """
    text = F.col("analysis")
    component = F.when(F.col("_a_ok"), F.get(F.col("_a.affected_components"), F.lit(0)))
    return (
        with_analysis(analyses)
        .withColumns(
            {
                "action": remediation_action(F.coalesce("_a.root_cause_description", text)),
                "service": before_tag(F.coalesce(component, first_known_service(text))),
            }
        )
        .withColumn(
            "command", rollout_command(F.col("action"), F.col("service"), F.lit(namespace))
        )
        .drop("_a", "_a_ok")
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that may be turned into commands, and those with a reason not to."""
    replicas = F.col("replicas") if "replicas" in requests.columns else None
    judged = requests.withColumn("reason", invalid_request(F.col("service"), replicas))
    good = judged.filter(F.col("reason").isNull()).drop("reason")
    return good, judged.filter(F.col("reason").isNotNull())


def request_commands(requests: DataFrame) -> DataFrame:
    """Commands for rows of ``tool`` (rollback, restart, scale), service, namespace, replicas."""
    service, namespace, tool = F.col("service"), F.col("namespace"), F.col("tool")
    return requests.select(
        *[c for c in requests.columns if c not in ("service", "namespace")],
        F.when(tool == "scale", scale_command(service, F.col("replicas"), namespace))
        .when(tool == "rollback", rollout_command(F.lit("undo"), service, namespace))
        .otherwise(rollout_command(F.lit("restart"), service, namespace))
        .alias("command"),
        clean_name(service).alias("service"),
        clean_name(namespace).alias("namespace"),
    )
