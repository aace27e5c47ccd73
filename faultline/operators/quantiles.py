"""Quantiles of a metric that are stored per window and merged to wider ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Size of a sketch, and the bound on its normalised rank error (both sides, 99 %) that goes with it.
SKETCH_K, RANK_ERROR = 400, 0.0083
QUANTILES = (0.5, 0.95, 0.99)


def sketched_windows(points: DataFrame, width: str, keys: Sequence[str] = (), value: str = "value", k: int = SKETCH_K) -> DataFrame:
    """(window_start, keys, sketch): a mergeable quantile sketch of each window; values that are null or no number are left out.

    Sketches are built on the map side, so a key with most of the points is one sketch per task in the shuffle.
    """
    numbers = points.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return (
        numbers.groupBy(F.window("timestamp", width).alias("_window"), *keys)
        .agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))
        .select(F.col("_window.start").alias("window_start"), *keys, "sketch")
    )


def merged_windows(windows: DataFrame, width: str, keys: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """Stored windows merged to wider ones, whose width must be a multiple; no point is read again."""
    wide = windows.groupBy(F.window("window_start", width).alias("_window"), *keys)
    return wide.agg(F.kll_merge_agg_double("sketch", k).alias("sketch")).select(
        F.col("_window.start").alias("window_start"), *keys, "sketch"
    )


def quantiles_of(windows: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """The windows with ``n`` and a column per quantile (``p50``, ``p95``, ``p99``) in place of the sketch.

    The rank of each estimate differs from the quantile by ``RANK_ERROR`` of n at most, with 99 % confidence.
    """
    others = [c for c in windows.columns if c != "sketch"]
    return windows.select(
        *others,
        F.kll_sketch_get_n_double("sketch").alias("n"),
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{q * 100:g}") for q in quantiles],
    )
