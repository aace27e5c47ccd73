"""Exact nearest vectors and keyword search, top k per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.plans.joins import held_lookup, lookup_join
from faultline.plans.ranking import first_n

# Query vectors that every task holds at once; more are searched block by block.
QUERY_BLOCK = 1024
VECTOR_BLOCK = 16384
# As many best scores are looked for one by one; more are found by sorting.
FEW_BEST = 16

_RESULT = "query_id long, vec_id long, similarity double"


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype=np.float64)


def _best(ids: np.ndarray, scores: np.ndarray, query_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best vectors of one batch for every query; ties go to the lower id."""
    by_id = np.argsort(ids, kind="stable")
    ids, scores = ids[by_id], scores[:, by_id]
    if k <= FEW_BEST:
        keep = np.empty((len(scores), min(k, scores.shape[1])), dtype=np.int64)
        left, rows = scores.copy(), np.arange(len(scores))
        for place in range(keep.shape[1]):
            # The first of equal scores, which is that of the lowest id.
            keep[:, place] = left.argmax(axis=1)
            left[rows, keep[:, place]] = -np.inf
    else:
        keep = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return pd.DataFrame(
        {
            "query_id": np.repeat(query_ids, keep.shape[1]),
            "vec_id": ids[keep].ravel(),
            "similarity": np.take_along_axis(scores, keep, axis=1).ravel(),
        }
    )


def nearest_vectors(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` most similar vectors by cosine for every query vector, exactly.

    ``vectors`` has ``vec_id`` and ``embedding``, ``queries`` has ``query_id`` and
    ``embedding``. Each task scores a batch against the queries and passes on k
    rows per query, never all pairs. Few queries travel to every task; many are
    cut into blocks, and each block meets each block of vectors in a task of its own.
    Null vectors, and vectors with a null in them, match nothing.
    """
    vectors = vectors.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    queries = queries.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    held, few = held_lookup(queries.select("query_id", "embedding"), max_rows=block)
    if few:
        found = _against_few(vectors, held, k)
    else:
        found = _block_by_block(vectors, held, k, block)
    return first_n(found, ["query_id"], [F.desc("similarity"), "vec_id"], k, "rank")


def _against_few(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark = vectors.sparkSession
    held = queries.select("query_id", "embedding").toPandas()
    if held.empty:
        return spark.createDataFrame([], _RESULT)
    shared = spark.sparkContext.broadcast(
        (held["query_id"].to_numpy(), _unit(_matrix(held["embedding"])))
    )

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, directions = shared.value
        for frame in frames:
            if len(frame):
                scores = directions @ _unit(_matrix(frame["embedding"])).T
                yield _best(frame["vec_id"].to_numpy(), scores, query_ids, k)

    return vectors.select("vec_id", "embedding").mapInPandas(score, _RESULT)


def _block_by_block(vectors: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    n_queries = max(1, -(-queries.count() // block))
    n_vectors = max(1, -(-vectors.count() // VECTOR_BLOCK))

    def bucket(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = (
        queries.select("query_id", "embedding")
        .withColumn("q", bucket("query_id", n_queries))
        .withColumn("v", every(n_vectors))
    )
    right = (
        vectors.select("vec_id", "embedding")
        .withColumn("v", bucket("vec_id", n_vectors))
        .withColumn("q", every(n_queries))
    )

    def score(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if some.empty or others.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
        scores = _unit(_matrix(some["embedding"])) @ _unit(_matrix(others["embedding"])).T
        return _best(others["vec_id"].to_numpy(), scores, some["query_id"].to_numpy(), k)

    return left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInPandas(score, _RESULT)


def label_centroids(vectors: DataFrame) -> DataFrame:
    """The mean vector of every label, as queries (``query_id`` is the label)."""
    parts = vectors.select("label", F.posexplode("embedding").alias("at", "value"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "mean"))), lambda s: s["mean"]).alias(
            "embedding"
        )
    )


WORD_BREAK = r"[^\p{L}\p{N}_]+"


def words_of(text: Column) -> Column:
    """Lower-case words of a text; letters, digits and ``_`` make a word."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda word: word != "")


def keyword_search(
    documents: DataFrame, keywords: DataFrame, k: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """For every keyword the ``k`` texts in which it occurs most; ties by key.

    Words are counted per text before they meet the keywords, so a word that is
    in every text weighs one row per text.
    """
    words = documents.select(key, F.explode(words_of(F.col(text))).alias("keyword"))
    wanted = keywords.select(F.lower("keyword").alias("keyword")).distinct()
    counted = (
        lookup_join(words, wanted, ["keyword"], "left_semi")
        .groupBy("keyword", key)
        .agg(F.count(F.lit(1)).alias("score"))
    )
    return first_n(counted, ["keyword"], [F.desc("score"), key], k, "rank")
