"""Continuous sources. Each closed file is read once, at the next trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.text import strip
from faultline.schema import TEXT_EXTENSIONS
from faultline.schema import CSV_EXTENSIONS
from faultline.sources.files import (
    CSV_OPTIONS,
    _json_rows,
    _null,
    column_names,
    csv_rows,
    csv_schema,
    extension_glob,
    json_array,
    json_object,
    json_seconds,
)


def stream_text(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Raw rows of text logs as their files arrive.

    A file that still grows is not read again, so logs must be rotated into the
    folder when closed. Line numbers need a second look at the file, which a
    stream does not have; they stay null.
    """
    reader = spark.readStream.option("pathGlobFilter", extension_glob(TEXT_EXTENSIONS))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(folder).select(
        F.col("_metadata.file_path").alias("source_file"), strip(F.col("value")).alias("value")
    )
    return lines.filter(F.col("value") != "").select(
        "source_file",
        _null("long").alias("line_number"),
        F.col("value").alias("line"),
        _null("map<string,string>").alias("fields"),
        _null("map<string,double>").alias("seconds"),
        _null("string").alias("raw"),
        _null("string").alias("reason"),
    )


def stream_json_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Raw rows of JSON-lines logs as their files arrive."""
    reader = spark.readStream.option("pathGlobFilter", extension_glob(["jsonl"]))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(folder).select(
        F.col("_metadata.file_path").alias("source_file"), strip(F.col("value")).alias("value")
    )
    good = F.col("fields").isNotNull()
    return (
        lines.filter(F.col("value") != "")
        .withColumn("fields", json_object(F.col("value")))
        .select(
            "source_file",
            _null("long").alias("line_number"),
            _null("string").alias("line"),
            "fields",
            F.when(good, json_seconds(F.col("value"), F.col("fields"))).alias("seconds"),
            F.when(~good, F.col("value")).alias("raw"),
            F.when(~good, "invalid JSON").alias("reason"),
        )
    )


def stream_json_documents(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Raw rows of ``.json`` files as they arrive: an object, an array of objects, or a line each.

    A file is one row until it is split, so it must stay below 2 GB.
    """
    reader = spark.readStream.option("pathGlobFilter", extension_glob(["json"]))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    text = strip(F.col("value"))
    documents = reader.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), text.alias("value"))
    one = F.array(F.col("value"))
    lines = F.filter(F.transform(F.split("value", "\r\n|\r|\n"), strip), lambda line: line != "")
    parts = (
        F.when(F.col("value").startswith("["), F.coalesce(json_array(F.col("value")), lines))
        .when(json_object(F.col("value")).isNotNull(), one)
        .otherwise(lines)
    )
    found = documents.filter(F.col("value") != "").select("source_file", F.posexplode(parts).alias("_at", "element"))
    return _json_rows(
        found.select("source_file", (F.col("_at") + 1).cast("long").alias("line_number"), "element")
    )


def stream_csv(spark: SparkSession, folder: str, header: str, max_files: int | None = None) -> DataFrame:
    """Raw rows of CSV files as they arrive; all have the columns of the ``header`` line.

    A stream needs its columns before it starts. Files whose own header differs give
    rows under the names stated here.
    """
    names = column_names(header)
    reader = spark.readStream.schema(csv_schema(names)).option("pathGlobFilter", extension_glob(CSV_EXTENSIONS))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.options(**CSV_OPTIONS, header=True, multiLine=True, enforceSchema=True).csv(folder)
    return csv_rows(
        rows.withColumns({"source_file": F.col("_metadata.file_path"), "line_number": _null("long")}), names
    )


def stream_table(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    pattern: str = "*.parquet",
    max_files: int | None = None,
) -> DataFrame:
    """Rows of a Parquet folder as its files arrive."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)
