"""Confidence tiers, severity lookups and range checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.schema import (
    ALERT_SEVERITIES,
    CONFIDENCE_DISPLAY,
    CONFIDENCE_PRIORITY,
    CONFIDENCE_SEVERITY,
    DEFAULT_COLOUR,
    DEFAULT_PRIORITY,
    SEVERITY_COLOUR,
    SEVERITY_PRIORITY,
)


def _tier(score: Column, cuts: Sequence[tuple[float, str]], lowest: str) -> Column:
    chain = F
    for cut, name in cuts:
        chain = chain.when(score >= cut, name)
    return chain.otherwise(lowest)


def _lookup(value: Column, table: Mapping[str, str], default: str) -> Column:
    entries = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.coalesce(F.try_element_at(entries, F.lower(value)), F.lit(default))


def severity_of_confidence(score: Column) -> Column:
    return _tier(score, CONFIDENCE_SEVERITY, "low")


def priority_of_confidence(score: Column) -> Column:
    return _tier(score, CONFIDENCE_PRIORITY, "Low")


def display_of_confidence(score: Column) -> Column:
    return _tier(score, CONFIDENCE_DISPLAY, "red")


def priority_of_severity(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_PRIORITY, DEFAULT_PRIORITY)


def colour_of_severity(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_COLOUR, DEFAULT_COLOUR)


def known_severity(severity: Column) -> Column:
    lowered = F.lower(severity)
    return F.when(lowered.isin(ALERT_SEVERITIES), lowered).otherwise("medium")


def valid_confidence(score: Column) -> Column:
    return F.coalesce(score.between(0.0, 1.0), F.lit(False))
