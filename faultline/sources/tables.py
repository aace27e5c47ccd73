"""Log text held in a table column, and field maps held as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import split_lines, strip
from faultline.sources.files import json_object, json_seconds


def lines_of_column(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per non-blank line of a text column, with its line number."""
    return (
        df.select(*keep, F.posexplode(split_lines(F.col(text))).alias("_at", "line"))
        .select(
            *keep,
            (F.col("_at") + 1).cast("long").alias("line_number"),
            strip(F.col("line")).alias("line"),
        )
        .filter(F.col("line") != "")
    )


def json_column(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Field maps of a column that holds one JSON object per row."""
    fields = df.select(*keep, F.col(text).alias("_text")).withColumn(
        "fields", json_object(F.col("_text"))
    )
    return fields.withColumn("seconds", json_seconds(F.col("_text"), F.col("fields"))).drop("_text")
