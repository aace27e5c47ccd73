"""Counts, rates and first appearances per incident."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.levels import level_rank
from faultline.plans.joins import lookup_join
from faultline.schema import CLIENT_QUOTA

INCIDENT = ("incident_id",)
ORDER = ("timestamp", "seq")


def earliest(df: DataFrame, order: Sequence[str], where: Column | None = None) -> Column:
    """Aggregate: the first place in the order, to be compared with others only.

    A timestamp with an integer is packed into one number, (time, place) with the
    place made non-negative, which a hash aggregate can hold. Other orders are the
    minimum of a struct, for which Spark sorts.
    """
    types = [df.schema[c].dataType for c in order]
    if len(types) == 2 and isinstance(types[0], T.TimestampType) and isinstance(types[1], T.IntegralType):
        wide = "decimal(20,0)"
        micros = F.unix_micros(F.col(order[0])).cast(wide)
        place = F.col(order[1]).cast(wide) + F.lit("9223372036854775808").cast(wide)
        at = micros * F.lit("20000000000000000000").cast(wide) + place
    else:
        at = F.struct(*order)
    return F.min(at if where is None else F.when(where, at))


def is_error(level: Column | None = None) -> Column:
    return F.upper(level if level is not None else F.col("level")) == "ERROR"


def is_failure(level: Column | None = None) -> Column:
    return F.upper(level if level is not None else F.col("level")).isin("ERROR", "FATAL")


def event_counts(events: DataFrame, keys: Sequence[str] = INCIDENT) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"))


def error_stats(events: DataFrame, keys: Sequence[str] = INCIDENT) -> DataFrame:
    """Events, errors and the error rate; ERROR only, FATAL is not counted."""
    counted = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(is_error()).alias("n_errors")
    )
    return counted.withColumn("error_rate", F.try_divide("n_errors", "n_events"))


def errors_per_service(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """ERROR and FATAL events per service, ranked by count, then first appearance."""
    counted = (
        events.filter(is_failure())
        .groupBy("incident_id", "service")
        .agg(F.count(F.lit(1)).alias("n"), earliest(events, order).alias("_first"))
    )
    by_count = Window.partitionBy("incident_id").orderBy(F.desc("n"), "_first")
    return counted.withColumn("rank", F.row_number().over(by_count).cast("long")).drop("_first")


def services_by_appearance(
    events: DataFrame,
    keys: Sequence[str] = INCIDENT,
    order: Sequence[str] = ORDER,
    errors_only: bool = False,
) -> DataFrame:
    """Distinct services of each incident with their place in order of appearance.

    Null services do not count; without the error filter neither do empty ones.
    """
    wanted = events.filter(F.col("service").isNotNull())
    wanted = wanted.filter(is_error() if errors_only else F.col("service") != "")
    seen = wanted.groupBy(*keys, "service").agg(earliest(events, order).alias("_first"))
    by_first = Window.partitionBy(*keys).orderBy("_first")
    return seen.withColumn("place", F.row_number().over(by_first).cast("long")).drop("_first")


def service_lists(
    events: DataFrame,
    keys: Sequence[str] = INCIDENT,
    order: Sequence[str] = ORDER,
    errors_only: bool = False,
) -> DataFrame:
    """The same as one ordered array per incident; one entry per distinct service."""
    places = services_by_appearance(events, keys, order, errors_only)
    return places.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", "service"))), lambda s: s["service"]
        ).alias("services")
    )


def incident_context(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Errors per service as a map, and services in order of appearance."""
    errors = (
        events.filter(is_failure())
        .groupBy("incident_id", "service")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("incident_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("service", "n"))).alias("error_clusters"))
    )
    return (
        service_lists(events, order=order)
        .withColumnRenamed("services", "service_topology")
        .join(errors, "incident_id", "full")
        .select(
            "incident_id",
            F.coalesce(
                "error_clusters", F.create_map().cast("map<string,bigint>")
            ).alias("error_clusters"),
            F.coalesce("service_topology", F.array().cast("array<string>")).alias(
                "service_topology"
            ),
        )
    )


def client_quota(events: DataFrame, client: str, quota: int = CLIENT_QUOTA) -> DataFrame:
    """Uses per client, and what is left of the quota."""
    used = events.groupBy(client).agg(F.count(F.lit(1)).alias("used"))
    return used.withColumn("remaining", F.greatest(F.lit(0), F.lit(quota) - F.col("used")))


def truncation_notice(events: DataFrame, cap: int) -> DataFrame:
    """How many events a capped slice shows, and whether it drops any."""
    return event_counts(events).select(
        "incident_id",
        F.col("n_events").alias("original_count"),
        F.least("n_events", F.lit(cap)).alias("kept"),
        (F.col("n_events") > cap).alias("truncated"),
    )


def scan_status(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """One row per expected incident; those without events read ``no_data``."""
    counted = incidents.join(event_counts(events), "incident_id", "left")
    n_events = F.coalesce("n_events", F.lit(0))
    return counted.select(
        "incident_id",
        n_events.alias("events_processed"),
        F.when(n_events == 0, "no_data").otherwise("success").alias("status"),
    )


def known_service_check(events: DataFrame, known: DataFrame, how: str = "left") -> DataFrame:
    """Whether the service of a row is in the list ``known`` (column ``service``).

    ``left`` adds the flag ``exists``; ``left_semi`` and ``left_anti`` filter.
    """
    listed = known.select("service").distinct()
    if how != "left":
        return lookup_join(events, listed, ["service"], how)
    flagged = listed.withColumn("exists", F.lit(True))
    return lookup_join(events, flagged, ["service"], "left").withColumn(
        "exists", F.coalesce("exists", F.lit(False))
    )


def latest(sessions: DataFrame, keys: Sequence[str], at: Sequence[str]) -> DataFrame:
    """The newest row of every key."""
    others = [c for c in sessions.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*at)).alias("_row")
    return sessions.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def session_or_latest(requests: DataFrame, sessions: DataFrame, at: Sequence[str]) -> DataFrame:
    """The session each request names; without a name, the newest of all.

    The newest session is added to the lookup under a key of its own, so that
    unnamed requests, however many, are an ordinary lookup as well.
    """
    columns = [c for c in sessions.columns if c != "session_id"]
    row = F.struct("session_id", *columns)
    named = F.concat(F.lit("id:"), F.col("session_id").cast("string"))
    newest = sessions.agg(F.max_by(row, F.struct(*at)).alias("_row")).select(
        F.lit("newest").alias("_key"), "_row"
    )
    stored = sessions.select(named.alias("_key"), row.alias("_row")).unionByName(newest)
    keyed = requests.withColumn("_key", F.coalesce(named, F.lit("newest")))
    found = lookup_join(keyed.withColumnRenamed("session_id", "_asked"), stored, ["_key"], "left")
    return found.select(
        *[c for c in requests.columns if c != "session_id"],
        F.coalesce("_asked", "_row.session_id").alias("session_id"),
        *[F.col(f"_row.{c}").alias(c) for c in columns],
    )


def severity_filter(events: DataFrame, minimum: str) -> DataFrame:
    """Events at or above a level, by the fixed rank of levels."""
    return events.withColumn("rank", level_rank(F.col("level"))).filter(
        F.col("rank") >= level_rank(F.lit(minimum))
    )
