"""Cutting lineage where a plan must see the very same partitions twice."""

from __future__ import annotations

from pyspark.sql import DataFrame

from faultline.session import shared_folder


# Partitions for each split of a table that is dealt out.
SPLIT_PARTS = 8


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The result keeps its partitions and their order, also when executors are
    lost later on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table out to all cores, before costly row work.

    A file with one row group is one task's work however it is split, so a table of
    fewer files than cores and of few splits is repartitioned, into several partitions per split: what a task
    holds must not grow with the table. Tables with several splits per core, which is every large one, are left
    as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= 4 * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores if splits == 1 else max(cores, SPLIT_PARTS * splits))
