"""Record numbers within each file, without one task per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.plans.joins import broadcast_if_small


def pin_splits(spark: SparkSession) -> None:
    """Fix the number of file splits, so that two scans are cut the same way.

    Spark derives it from the cores present when a scan starts, and executors
    may come and go between the two scans of a numbering.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))


def number_records(scan: DataFrame, name: str = "line_number") -> DataFrame:
    """Add ``source_file`` and the 1-based record number within it.

    ``scan`` must be a bare file scan: nothing may be filtered before the
    numbering. Each scan block counts its records, the counts of the blocks of a
    file are summed up in block order, and every record adds its place in its
    block. The rows themselves are not shuffled while the block table is small.
    """
    pin_splits(scan.sparkSession)
    tagged = scan.withColumns(
        {
            "source_file": F.col("_metadata.file_path"),
            "_block": F.col("_metadata.file_block_start"),
            "_id": F.monotonically_increasing_id(),
        }
    )
    blocks = tagged.groupBy("source_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    earlier = (
        Window.partitionBy("source_file")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = broadcast_if_small(
        blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    place = F.col("_id") - F.col("_first")
    # A place outside its block means that the two scans were cut differently.
    checked = F.when(place.between(0, F.col("_n") - 1), place).otherwise(
        F.raise_error(F.lit("file splits changed while records were numbered")).cast("long")
    )
    return (
        tagged.join(offsets, ["source_file", "_block"], "left")
        .withColumn(name, F.col("_before") + checked + 1)
        .drop("_block", "_id", "_n", "_first", "_before")
    )
