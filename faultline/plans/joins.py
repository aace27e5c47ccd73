"""Joins that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.plans.cut import cut

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def held_lookup(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, bool]:
    """A lookup table computed once and held, and whether it may be broadcast.

    Rows and bytes are counted on the held table, so that neither the count nor
    the join computes it again.
    """
    held = cut(df)
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in held.columns]))
    size = held.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")
    ).first()
    return held, size["rows"] <= max_rows and size["bytes"] <= max_bytes


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A held lookup table, marked for broadcast when its counted size allows it."""
    held, small = held_lookup(df)
    return F.broadcast(held) if small else held


def lookup_join(
    large: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a fact side to a lookup side that has few rows per key.

    The lookup is broadcast when its counted size allows it. Otherwise it is a plain
    join of both sides, whose skewed partitions Spark splits at run time. ``how`` may be any
    type that keeps rows of the large side (inner, left, left_semi, left_anti).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how} would repeat rows of the lookup side")
    held, fits = held_lookup(small, max_rows)
    return large.join(F.broadcast(held) if fits else held, list(keys), how)
