"""Windowed rates, trend direction, and the metrics written in messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.metrics import is_error
from faultline.schema import STRATEGIES


def windowed_rates(
    events: DataFrame,
    width: str,
    keys: Sequence[str] = ("service",),
    slide: str | None = None,
    late: str | None = None,
) -> DataFrame:
    """Error rate per time window; on a stream ``late`` is the watermark delay."""
    if late is not None:
        events = events.withWatermark("timestamp", late)
    span = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    return (
        events.groupBy(span.alias("_window"), *keys)
        .agg(F.count(F.lit(1)).alias("n_events"), F.count_if(is_error()).alias("n_errors"))
        .select(
            F.col("_window.start").alias("window_start"),
            *keys,
            "n_events",
            "n_errors",
            (F.col("n_errors") / F.col("n_events")).alias("error_rate"),
        )
    )


def against_baseline(
    rates: DataFrame, keys: Sequence[str], previous: int, value: str = "error_rate"
) -> DataFrame:
    """Each window next to the mean of the windows before it."""
    before = (
        Window.partitionBy(*keys).orderBy("window_start").rowsBetween(-previous, -1)
    )
    return rates.withColumn("baseline", F.avg(value).over(before)).withColumn(
        "direction",
        F.when(F.col("baseline").isNull(), "unknown")
        .when(F.col(value) > F.col("baseline"), "increasing")
        .when(F.col(value) < F.col("baseline"), "decreasing")
        .otherwise("stable"),
    )


def trend_slopes(
    rates: DataFrame, keys: Sequence[str], value: str = "error_rate", hour: float = 3600.0
) -> DataFrame:
    """Slope of a windowed value per hour, and its direction."""
    hours = F.unix_micros(F.col("window_start").cast("timestamp")) / 1e6 / hour
    return rates.groupBy(*keys).agg(
        F.regr_slope(F.col(value), hours).alias("slope"), F.count(F.lit(1)).alias("n_windows")
    )


def data_points(
    rates: DataFrame, keys: Sequence[str], value: str = "error_rate", part: str | None = None
) -> DataFrame:
    """The points of a trend, in time order; one per window.

    With ``part`` (a unit such as ``day``) a trend goes on in rows of one unit each, so no
    list grows with the time span.
    """
    extra = [F.date_trunc(part, F.col("window_start")).alias("part")] if part else []
    return rates.groupBy(*keys, *extra).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("window_start").alias("ts"), F.col(value).alias("value")))
        ).alias("data_points")
    )


# How each metric is written: trend type, pattern of (value, capacity), scale.
METRICS = [
    ("connection_pool_exhaustion", r"(\d+)/(\d+) connections"),
    ("memory_leak", r"heap (\d+)MB/(\d+)MB"),
    ("rising_latency", r"(?:p99|duration)=(\d+)()ms"),
    ("disk_usage_growth", r"(?i)disk usage(?: at)? (\d+)()%"),
]


def metric_points(events: DataFrame, metrics: Sequence[tuple[str, str]] = METRICS) -> DataFrame:
    """One row per measurement found in a message: metric, value, ratio to capacity."""
    message = F.col("message")
    found = F.array(
        *[
            F.when(
                message.rlike(pattern),
                F.struct(
                    F.lit(name).alias("metric"),
                    F.regexp_extract(message, pattern, 1).try_cast("double").alias("value"),
                    F.regexp_extract(message, pattern, 2).try_cast("double").alias("capacity"),
                ),
            )
            for name, pattern in metrics
        ]
    )
    return (
        events.withColumn("_found", F.explode(F.filter(found, lambda m: m.isNotNull())))
        .select("*", "_found.*")
        .drop("_found")
        .withColumn("ratio", F.try_divide("value", "capacity"))
    )


def metric_windows(points: DataFrame, width: str, keys: Sequence[str]) -> DataFrame:
    """Highest value and ratio, and the median, per metric and time window."""
    return (
        points.groupBy(F.window("timestamp", width).alias("_window"), *keys, "metric")
        .agg(
            F.count(F.lit(1)).alias("n_points"),
            F.max("value").alias("max_value"),
            F.max("ratio").alias("max_ratio"),
            F.percentile_approx("value", 0.5).alias("median_value"),
        )
        .select(
            F.col("_window.start").alias("window_start"), *keys, "metric", "n_points", "max_value", "max_ratio",
            "median_value",
        )
    )


def growth_runs(
    windows: DataFrame, keys: Sequence[str], drop_to: float = 0.5, value: str = "max_value"
) -> DataFrame:
    """Growth of a windowed metric, split where it falls to a fraction (a restart)."""
    in_time = Window.partitionBy(*keys).orderBy("window_start")
    fell = F.col(value) < F.lag(value).over(in_time) * drop_to
    run = F.sum(F.coalesce(fell, F.lit(False)).cast("long")).over(in_time)
    hours = F.unix_micros(F.col("window_start").cast("timestamp")) / 3.6e9
    return (
        windows.withColumn("run", run)
        .groupBy(*keys, "run")
        .agg(
            F.count(F.lit(1)).alias("n_windows"),
            F.min("window_start").alias("started_at"),
            F.max(value).alias("peak"),
            F.regr_slope(F.col(value), hours).alias("per_hour"),
        )
    )


# Words that place a text in a problem class, tried in this order.
PROBLEM_WORDS = [
    ("memory_leak", ["memory leak", "heap", "out of memory", "oom"]),
    ("database_connection", ["connection pool", "connections", "database"]),
    ("rate_limit", ["rate limit", "throttl", "too many requests"]),
    ("disk_space", ["disk", "volume full", "no space"]),
    ("deployment_bug", ["deployment", "regression", "null", "bug"]),
    ("resource_exhaustion", ["exhaust", "overload", "cpu"]),
    ("configuration_error", ["config", "setting"]),
]


def problem_class(text: Column) -> Column:
    lowered = F.lower(text)
    return F.coalesce(
        *[
            F.when(lowered.contains(word), F.lit(name))
            for name, words in PROBLEM_WORDS
            for word in words
        ]
    )


def strategies(df: DataFrame, text: str) -> DataFrame:
    """One row per strategy of the problem class a text falls in."""
    table = F.create_map(
        *[
            part
            for name, steps in STRATEGIES.items()
            for part in (F.lit(name), F.array(*[F.lit(s) for s in steps]))
        ]
    )
    classed = df.withColumn("problem", problem_class(F.col(text))).filter(
        F.col("problem").isNotNull()
    )
    return classed.select(
        "*", F.posexplode(F.try_element_at(table, F.col("problem"))).alias("_at", "strategy")
    ).withColumn("step", (F.col("_at") + 1).cast("long")).drop("_at")


# The usual line form: time, level, service, text.
_LINE = r"^\S+[ T]?\S*?\s+(FATAL|ERROR|WARN|WARNING|INFO|DEBUG|TRACE)\s+([\w.\-]+):\s+(.*)$"


def line_parts(line: Column) -> dict[str, Column]:
    """Level by position, service and text of a usual line; null where it has none."""
    return {
        "line_level": F.nullif(F.regexp_extract(line, _LINE, 1), F.lit("")),
        "line_service": F.nullif(F.regexp_extract(line, _LINE, 2), F.lit("")),
        "line_text": F.nullif(F.regexp_extract(line, _LINE, 3), F.lit("")),
    }
