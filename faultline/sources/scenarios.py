"""The scenario catalogue: a name, its log file and its description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.plans.joins import lookup_join

SCENARIO = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("events_count", T.LongType()),
        T.StructField("services", T.ArrayType(T.StringType())),
        T.StructField("root_cause", T.StringType()),
        T.StructField("remediation", T.StringType()),
    ]
)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One JSON description per scenario, keyed by its file name."""
    scan = spark.read.schema(SCENARIO).json(path, multiLine=True)
    return scan.withColumn(
        "scenario", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    )


def with_scenario(events: DataFrame, catalogue: DataFrame, key: str = "scenario") -> DataFrame:
    """Events with the description of their scenario; unknown names are dropped."""
    return lookup_join(events, catalogue, [key], "inner")
