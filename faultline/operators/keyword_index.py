"""An inverted index on disk for keyword search, with the greatest score of every block.

Texts are dealt into blocks. A posting row holds the texts of one block that have a keyword, with their counts, and
a row of its own says the greatest of them. A search reads the rows of its keywords only, bounds every block by
the sum of its greatest scores, and opens the blocks that can still enter the top k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.search import words_of
from faultline.plans.cut import cut
from faultline.plans.joins import lookup_join
from faultline.plans.ranking import first_n

# Texts of a block, about; and folders that keywords are dealt to.
BLOCK_TEXTS, BUCKETS = 4096, 64
# Blocks, about, whose rows one folder's task writes.
SLICE_BLOCKS = 256


@dataclass
class KeywordIndex:
    """Where an index lies, and how many folders it has."""

    spark: SparkSession
    path: str
    buckets: int

    def bounds(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/bounds")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")


def bucket_of(keyword: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(keyword), F.lit(buckets)).cast("int")


def build_index(
    documents: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    block_texts: int = BLOCK_TEXTS,
    buckets: int = BUCKETS,
) -> KeywordIndex:
    """Write the index of all words of ``documents`` below ``path``, which must be new.

    A keyword in every text is a row per block, so no row outgrows a block. Rows lie by keyword in folders, so a
    reader of a keyword skips the rest by their least and greatest. ``key`` must be unique.
    """
    blocks = max(1, -(-documents.count() // block_texts))
    block = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int")
    # Texts move once, to their block; their words are counted there, without a further exchange.
    placed = documents.select(F.col(key).alias("key"), F.col(text).alias("_text")).withColumn("block", block)
    words = placed.repartition("block").select("block", "key", F.explode(words_of(F.col("_text"))).alias("keyword"))
    counted = words.groupBy("block", "keyword", "key").agg(F.count(F.lit(1)).alias("score"))
    entry = F.struct(F.col("key"), F.col("score"))
    rows = (
        counted.groupBy("block", "keyword")
        .agg(F.max("score").alias("greatest"), F.array_sort(F.collect_list(entry)).alias("entries"))
        .withColumn("bucket", bucket_of(F.col("keyword"), buckets))
    )
    # Not by ranges, whose bounds would be found by counting all words once more. A folder's blocks are dealt to slices,
    # so a keyword in every text is no single task's work.
    slices = F.pmod("block", F.lit(-(-blocks // SLICE_BLOCKS)))
    (
        rows.repartition("bucket", slices)
        .sortWithinPartitions("bucket", "keyword", "block")
        .write.partitionBy("bucket")
        .parquet(f"{path}/postings")
    )
    index = KeywordIndex(documents.sparkSession, path, buckets)
    # Narrow, and read from what was written: the words are not counted again.
    (
        index.postings()
        .select("bucket", "keyword", "block", "greatest")
        .repartitionByRange("bucket", "keyword", "block")
        .sortWithinPartitions("bucket", "keyword", "block")
        .write.partitionBy("bucket")
        .parquet(f"{path}/bounds")
    )
    return index


def _of_keywords(rows: DataFrame, wanted: DataFrame, buckets: list[int]) -> DataFrame:
    """Rows of the asked keywords, from the folders that can hold them."""
    return lookup_join(rows.filter(F.col("bucket").isin(buckets)).drop("bucket"), wanted, ["keyword"], "left_semi")


def opened_blocks(index: KeywordIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, block): the blocks that can hold one of the ``k`` best texts of each query.

    The k-th greatest block score of a keyword is reached by k texts, as blocks share none; what any keyword of the
    query reaches is a floor for the k-th best sum. A block whose greatest scores add up to less stays closed.
    """
    wanted = cut(queries.select("keyword").distinct())
    buckets = [r.b for r in wanted.select(bucket_of(F.col("keyword"), index.buckets).alias("b")).distinct().collect()]
    bounds = _of_keywords(index.bounds(), wanted, buckets)
    by_query = queries.select("query_id", "keyword").distinct().join(bounds, "keyword")
    kth = first_n(by_query, ["query_id", "keyword"], [F.desc("greatest"), "block"], k)
    floors = kth.filter(F.col("rn") == k).groupBy("query_id").agg(F.max("greatest").alias("floor"))
    sums = by_query.groupBy("query_id", "block").agg(F.sum("greatest").alias("bound"))
    return lookup_join(sums, floors, ["query_id"], "left").filter(
        F.col("bound") >= F.coalesce(F.col("floor"), F.lit(0))
    ).select("query_id", "block")


def search_index(index: KeywordIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` texts with the most occurrences of a query's keywords, ties by key.

    ``queries`` has a row per (query_id, keyword); keywords are lower-case words, and repeated ones count once.
    """
    opened = cut(opened_blocks(index, queries, k))
    wanted = cut(
        queries.select("query_id", "keyword").distinct().join(opened, "query_id")
        .select("query_id", "keyword", "block")
    )
    buckets = [r.b for r in wanted.select(bucket_of(F.col("keyword"), index.buckets).alias("b")).distinct().collect()]
    read = lookup_join(
        index.postings().filter(F.col("bucket").isin(buckets)).select("keyword", "block", "entries"),
        wanted.select("keyword", "block").distinct(),
        ["keyword", "block"],
        "left_semi",
    )
    # A block's entries meet the queries that open it in one task, which passes on k rows per query.
    words = queries.select("query_id", "keyword").distinct().groupBy("query_id").agg(F.collect_list("keyword").alias("keywords"))
    asked = lookup_join(opened, words, ["query_id"])

    def score(entries: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if entries.empty or asking.empty:
            return pd.DataFrame({"query_id": [], "key": [], "score": []})
        place = {word: at for at, word in enumerate(entries["keyword"])}
        keys = sorted({entry["key"] for some in entries["entries"] for entry in some})
        at = {key: i for i, key in enumerate(keys)}
        counts = np.zeros((len(place), len(keys)), dtype=np.int64)
        for row, some in enumerate(entries["entries"]):
            for entry in some:
                counts[row, at[entry["key"]]] = entry["score"]
        rows = []
        for query, keywords in zip(asking["query_id"], asking["keywords"], strict=True):
            total = counts[[place[word] for word in keywords if word in place]].sum(axis=0)
            best = np.argsort(-total, kind="stable")[:k]
            rows += [(query, keys[i], int(total[i])) for i in best if total[i] > 0]
        return pd.DataFrame(rows, columns=["query_id", "key", "score"])

    kinds = {"query_id": queries, "key": read.select(F.explode("entries.key").alias("key"))}
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c, rows in kinds.items()) + ", score long"
    best = read.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(score, schema)
    return first_n(best, ["query_id"], [F.desc("score"), "key"], k, "rank")
