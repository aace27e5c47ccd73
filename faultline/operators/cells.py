"""Exact nearest vectors for many queries: cells around centroids, opened only if their bound can win.

Vectors are dealt to the nearest of some centroids, and each cell knows the widest angle of its members. A vector in a
cell can't be nearer to a query than the angle to the centroid less that width. Every query first searches the
cells around it until they hold k vectors; their k-th best is a floor, and only cells whose bound reaches it are opened.
Vectors are written once, a folder per cell, and tasks that hold a block of queries read the cells that these open, so disk and
memory stay in proportion however many cells a query opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.search import _best, _matrix, _unit
from faultline.plans.cut import cut
from faultline.plans.ranking import first_n
from faultline.session import new_folder
from faultline.sources.growing import file_system

# Centroids that every task holds, at most; vectors of a cell that are read at once, and queries that meet them.
CENTROIDS, CELL_PART, QUERY_PART = 1024, 2048, 4096
# Queries of a block, at least, while there are fewer blocks than tasks are wanted; tasks for a core.
LEAST_PART, TASKS = 256, 4
# Angles are rounded; bounds are widened by this much, so that nothing is lost.
SLACK = 1e-6
# Similarities that differ by rounding only are equal.
TIE, TIE_DIGITS = 1e-12, 12

_PAIRS = "query_id long, vec_id long, similarity double"


def clean(vectors: DataFrame, key: str) -> DataFrame:
    """(key, embedding) of vectors without a null in them."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    return vectors.filter(whole).select(F.col(key).cast("long").alias(key), "embedding")


def choose_centroids(vectors: DataFrame, most: int = CENTROIDS) -> np.ndarray:
    """Some of the vectors, as many as the square root of their number, chosen by hash of the id; at most ``most``."""
    n = vectors.count()
    wanted = int(min(most, np.ceil(np.sqrt(n)))) if n else 0
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).toPandas()
    return _unit(_matrix(chosen["embedding"])) if wanted else np.zeros((0, 0))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def dealt(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(.., embedding, cell, angle): each vector in the cell of its nearest centroid; zero vectors in cell -1."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                unit = _unit(_matrix(frame["embedding"]))
                away = angles(unit, shared.value)
                cell = away.argmin(axis=1)
                nothing = ~unit.any(axis=1)
                yield frame.assign(
                    cell=np.where(nothing, -1, cell), angle=np.where(nothing, 0.0, away[np.arange(len(cell)), cell])
                )

    kinds = ", ".join(f"{c} {kind}" for c, kind in vectors.dtypes)
    return vectors.mapInPandas(deal, f"{kinds}, cell int, angle double")


def cells_to_open(queries: DataFrame, centroids: np.ndarray, cells: pd.DataFrame, k: int, floors: bool) -> DataFrame:
    """(query_id, cell): the cells around each query, best bound first, until they hold ``k`` vectors.

    With ``floors``, the other cells whose bound reaches the ``floor`` of the query; a null floor opens all. The bound is
    the greatest similarity that a vector of the cell can have. A query knows all cells, of which there are at most
    CENTROIDS and one, and only those that it opens leave the task.
    """
    cells = cells.sort_values("cell")
    shared = queries.sparkSession.sparkContext.broadcast(
        (centroids, cells["cell"].to_numpy(), cells["radius"].to_numpy(), cells["n"].to_numpy())
    )

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for start in range(0, len(whole), 512):
                frame = whole.iloc[start : start + 512]
                best, opened = bounds(_unit(_matrix(frame["embedding"])), *shared.value, k)
                if floors:
                    floor = frame["floor"].to_numpy(dtype=np.float64, na_value=-np.inf)
                    floor = np.where(np.isnan(floor), -np.inf, floor)
                    opened = ~opened & (best >= floor[:, None] - SLACK)
                row, column = np.nonzero(opened)
                yield pd.DataFrame({"query_id": frame["query_id"].to_numpy()[row], "cell": shared.value[1][column]})

    return queries.mapInPandas(find, "query_id long, cell int")


def bounds(unit: np.ndarray, centres: np.ndarray, cell: np.ndarray, radius: np.ndarray, n: np.ndarray, k: int):
    """The bound of each cell for each query, and whether it is one of those, best bound first, that hold ``k`` vectors."""
    near = np.maximum(angles(unit, centres[np.maximum(cell, 0)]) - radius - SLACK, 0.0)
    best = np.where(cell < 0, 0.0, np.cos(near))
    best[~unit.any(axis=1)] = 0.0
    order = np.argsort(-best, axis=1, kind="stable")
    held = np.cumsum(n[order], axis=1) - n[order]
    first = np.zeros(best.shape, dtype=bool)
    np.put_along_axis(first, order, held < k, axis=1)
    return best, first


class Best:
    """The ``k`` best (similarity, vec_id) of some queries so far; equal similarities go by the lower id."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    @property
    def floors(self) -> np.ndarray:
        """The k-th best of each query, below everything while there are fewer."""
        return self.scores[:, -1]

    def meet(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Add the scores of some of the queries (``rows``) with vectors whose ids ascend."""
        k, floors = self.scores.shape[1], self.floors[rows]
        hits = scores >= floors[:, None] - TIE
        counts = hits.sum(axis=1)
        few = (counts > 0) & (counts <= 4 * k)
        many = counts > 4 * k
        if few.any():
            some, column = np.nonzero(hits[few])
            at = np.flatnonzero(few)[some]
            self._merge(rows[few], np.searchsorted(rows[few], rows[at]), ids[column], np.round(scores[at, column], TIE_DIGITS))
        if many.any():
            found = _best(ids, np.round(scores[many], TIE_DIGITS), np.arange(int(many.sum())), k)
            self._merge(rows[many], *(found[c].to_numpy() for c in ("query_id", "vec_id", "similarity")))

    def _merge(self, rows: np.ndarray, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        k = self.scores.shape[1]
        at = np.concatenate([at, np.repeat(np.arange(len(rows)), k)])
        ids = np.concatenate([ids, self.ids[rows].ravel()])
        scores = np.concatenate([scores, self.scores[rows].ravel()])
        order = np.lexsort((ids, -scores, at))
        starts = np.searchsorted(at[order], np.arange(len(rows)))
        keep = order[starts[:, None] + np.arange(k)]
        self.ids[rows], self.scores[rows] = ids[keep], scores[keep]


def read_cell(files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids, ascending, and directions of the vectors of a cell, part by part."""
    for name in files:
        system, path = file_system(name)
        with system.open_input_file(path) as stream:
            for batch in pq.ParquetFile(stream).iter_batches(CELL_PART, columns=["vec_id", "embedding"], use_threads=False):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                order = np.argsort(ids, kind="stable")
                yield ids[order], _unit(flat.reshape(len(ids), len(flat) // len(ids)))[order]


def search_cells(queries: DataFrame, centroids: np.ndarray, cells: pd.DataFrame, files: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity): the k best of the opened cells for each query, of each share of the cells.

    ``files`` has the files of each cell (cell, file). A task holds QUERY_PART queries and reads the cells that any of them opens: the
    cells around them first, then those whose bound reaches the k-th best that is known by then. Blocks of few queries meet the
    cells in shares, so that there is work for all cores.
    """
    cells = cells.sort_values("cell")
    known = {}
    for row in files.collect():
        known.setdefault(row.cell, []).append(row.file)
    context = queries.sparkSession.sparkContext
    shared = context.broadcast(
        (centroids, cells["cell"].to_numpy(), cells["radius"].to_numpy(), cells["n"].to_numpy(), known)
    )
    n, wanted = queries.count(), TASKS * context.defaultParallelism
    parts = max(-(-n // QUERY_PART), min(wanted, -(-n // LEAST_PART)), 1)
    shares = -(-wanted // parts)
    dealt_out = queries.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dealt_out = dealt_out.repartitionByRange(parts * shares, "share", "cell", "query_id")

    def search(frame: pd.DataFrame, share: int) -> pd.DataFrame:
        centres, cell, radius, n, named = shared.value
        unit, best = _unit(_matrix(frame["embedding"])), Best(len(frame), k)
        own = np.flatnonzero(np.arange(len(cell)) % shares == share)
        if not len(own):
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
        bound, first = bounds(unit, centres, cell[own], radius[own], n[own], k)
        for early in (True, False):
            # Cells that are near to most queries first.
            for c in np.argsort(-bound.sum(axis=0), kind="stable"):
                opened = first[:, c] if early else ~first[:, c] & (bound[:, c] >= best.floors - SLACK)
                rows = np.flatnonzero(opened)
                if len(rows):
                    asked = unit[rows]
                    for ids, directions in read_cell(named[int(cell[own[c]])]):
                        best.meet(rows, ids, asked @ directions.T)
        row, place = np.nonzero(np.isfinite(best.scores))
        return pd.DataFrame(
            {"query_id": frame["query_id"].to_numpy()[row], "vec_id": best.ids[row, place], "similarity": best.scores[row, place]}
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[pd.DataFrame]] = {}
        for frame in frames:
            for share, some in frame.groupby("share"):
                for start in range(0, len(some), QUERY_PART):
                    waiting.setdefault(share, []).append(some.iloc[start : start + QUERY_PART])
                    while sum(map(len, waiting[share])) >= QUERY_PART:
                        block = pd.concat(waiting[share])
                        waiting[share] = [block.iloc[QUERY_PART:]]
                        yield search(block.iloc[:QUERY_PART], share)
        for share, some in waiting.items():
            if sum(map(len, some)):
                yield search(pd.concat(some), share)

    return dealt_out.mapInPandas(run, _PAIRS)


def nearest_in_cells(vectors: DataFrame, queries: DataFrame, k: int, most: int = CENTROIDS) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, similarity, rank) of the ``k`` nearest vectors of every query, exactly, and the opened (query_id, cell).

    ``vectors`` has a unique ``vec_id``, ``queries`` a unique ``query_id``, both an ``embedding``. Ties go to the lower id.
    Vectors that are null or hold a null match nothing; a vector of zeros has similarity 0 to all.
    """
    vectors, queries = clean(vectors, "vec_id"), clean(queries, "query_id")
    centroids = choose_centroids(vectors, most)
    if not len(centroids):
        none = queries.sparkSession.createDataFrame([], _PAIRS + ", rank long")
        return none, none.select("query_id", F.lit(0).alias("cell"))
    spark, folder = vectors.sparkSession, new_folder(vectors.sparkSession, "cells")
    # A cell of many vectors is cut among tasks.
    members = dealt(vectors, centroids).repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    members.write.partitionBy("cell").parquet(folder)
    index = spark.read.schema(members.schema).parquet(folder)
    # One row per cell: at most as many as centroids, and one.
    known = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).toPandas()
    files = index.select("cell", F.col("_metadata.file_path").alias("file")).distinct().orderBy("cell", "file")
    # Queries that lie together are asked together.
    asked = cut(dealt(queries, centroids))
    found = cut(search_cells(asked, centroids, known, files, k))
    kth = first_n(found, ["query_id"], [F.desc("similarity"), "vec_id"], k)
    floors = kth.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("similarity").alias("floor"))
    floors = floors.select("query_id", F.when(F.col("found") == k, F.col("floor")).alias("floor"))
    # The opened cells are found again where they are asked for, and not written: there are as many as queries times cells.
    first = cells_to_open(asked, centroids, known, k, False)
    more = cells_to_open(asked.join(floors, "query_id", "left"), centroids, known, k, True)
    return (
        first_n(found, ["query_id"], [F.desc("similarity"), "vec_id"], k, "rank"),
        first.unionByName(more),
    )
