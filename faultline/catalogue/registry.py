"""Registration of queries, and the views they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.plans.cut import spread

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The test tables of one folder, and the event view made from them."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table on as many partitions as there are cores, for costly row work."""
        return spread(self.table(name))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def log_events(self) -> DataFrame:
        return log_view(self.events)

    @property
    def spread_log(self) -> DataFrame:
        """The event view for costly row work, with the type of each event."""
        return log_view(self.spread("events"), "event_type")


def log_view(events: DataFrame, *more: str) -> DataFrame:
    """The ``events`` table as log events; one incident per day."""
    kind, value = F.col("event_type"), F.col("value")
    level = (
        F.when((kind == "error") & (value >= 150), "FATAL")
        .when(kind == "error", "ERROR")
        .when(kind == "signup", "WARN")
        .when(kind == "view", "DEBUG")
        .otherwise("INFO")
    )
    return events.select(
        F.date_format("ts", "yyyyMMdd").alias("incident_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        level.alias("level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string")).alias("service"),
        F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string")).alias("message"),
        F.col("event_id").alias("seq"),
        *more,
    )


LOG_SQL = """
log_events AS (
    SELECT strftime(ts, '%Y%m%d') AS incident_id,
           ts AS timestamp,
           CASE WHEN event_type = 'error' AND value >= 150 THEN 'FATAL'
                WHEN event_type = 'error' THEN 'ERROR'
                WHEN event_type = 'signup' THEN 'WARN'
                WHEN event_type = 'view' THEN 'DEBUG'
                ELSE 'INFO' END AS level,
           concat('svc-', user_id % 7) AS service,
           concat(event_type, ' by user ', user_id) AS message,
           event_id AS seq
    FROM events
)"""


def stamp(column: Column | str) -> Column:
    """A timestamp as text to the microsecond, as ``STAMP`` does in SQL."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def second(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def sql_second(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its own name."""

    def register(function: Callable[[Tables], DataFrame]):
        name = function.__name__
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def with_log(body: str, *views: str) -> str:
    """SQL over the event view and further views (``name AS (...)``)."""
    return "WITH " + ",\n".join([LOG_SQL, *views]) + "\n" + body


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
