"""Remediation commands: clean names, the action for a root cause, the text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import is_blank
from faultline.schema import DEFAULT_SERVICE, REMEDIATION_SERVICES, UNDO_WORDS


def clean_name(name: Column) -> Column:
    """Only letters, digits and ``-`` remain."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}-]", "")


def first_known_service(
    text: Column, services: list[str] = REMEDIATION_SERVICES, default: str = DEFAULT_SERVICE
) -> Column:
    """The service of the list, by its order, that the text names."""
    lowered = F.lower(text)
    return F.coalesce(
        *[F.when(lowered.contains(name), F.lit(name)) for name in services], F.lit(default)
    )


def remediation_action(root_cause: Column) -> Column:
    lowered = F.lower(root_cause)
    undo = reduce(lambda a, b: a | b, [lowered.contains(word) for word in UNDO_WORDS])
    return F.when(undo, "undo").otherwise("restart")


# The command formats.


def rollout_command(action: Column, service: Column, namespace: Column) -> Column:
    return F.format_string(
        "kubectl rollout %s deployment/%s -n %s", action, clean_name(service), clean_name(namespace)
    )


def scale_command(service: Column, replicas: Column, namespace: Column) -> Column:
    return F.format_string(
        "kubectl scale deployment/%s --replicas=%d -n %s",
        clean_name(service),
        replicas,
        clean_name(namespace),
    )


def invalid_request(service: Column, replicas: Column | None = None) -> Column:
    """Why a command request must be turned down; null for a good one."""
    reason = F.when(service.isNull() | is_blank(service), "empty service name")
    if replicas is not None:
        reason = reason.when(replicas < 0, "negative replicas")
    return reason
