"""Ordered operators without one task per key.

``first_n`` leans on Spark's partial group limit: every input task keeps its own
n best rows per key, so a hot key sends n rows per task to the shuffle.
``exact_row_number`` numbers *all* rows of every key: rows are range-partitioned
by key and order, and only run lengths (one row per partition and key) are summed
up. ``rows_before`` pairs rows with those before them in the same way, without a number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.plans.cut import cut
from faultline.plans.joins import broadcast_if_small

# A monotonically increasing id holds the partition above bit 33.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def first_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, name: str = "rn"
) -> DataFrame:
    """The first ``n`` rows of every key, numbered from 1."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(name, F.row_number().over(window))
        .filter(F.col(name) <= n)
        .withColumn(name, F.col(name).cast("long"))
    )


def exact_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn"
) -> DataFrame:
    """Number all rows of every key from 1, in the total order ``order``.

    One range shuffle on (keys, order): a key with a third of all rows is cut
    into as many partitions as its size asks for. The ranged rows are
    checkpointed, since their numbers depend on the partition bounds.
    """
    ranged = cut(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    )
    row_id = F.monotonically_increasing_id()
    placed = ranged.withColumn("_part", F.shiftright(row_id, _ROW_BITS)).withColumn(
        "_at", row_id.bitwiseAND(F.lit(_ROW_MASK))
    )
    runs = placed.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_start")
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = runs.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_k_part"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start") + 1).alias("_shift"),
    )
    offsets = broadcast_if_small(shifts)
    same = F.col("_part") == F.col("_k_part")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return placed.join(offsets, same).select(
        *df.columns, (F.col("_at") + F.col("_shift")).alias(name)
    )


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; null equals null."""
    differ = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
    nulls = np.asarray(column.is_null())
    return np.asarray(differ) | (nulls[1:] != nulls[:-1])


def _pair_up(n: int, keys: Sequence[str], columns: Sequence[str], schema: pa.Schema):
    """mapInArrow over a partition in order of key and order: each anchor with the rows before it in the partition.

    The first rows of the partition's first key, and the last of its last, are sent on beside them:
    what an anchor misses stands in the partitions before.
    """

    def rows(table: pa.Table, taken: np.ndarray, before: np.ndarray | None, offset: int, edge: bool, part: int, at: np.ndarray):
        size = len(taken)
        own = table.take(pa.array(taken))
        near = table.take(pa.array(before)) if before is not None else None
        out = list(own.columns)
        out += [near.column(c) if near is not None else pa.nulls(size, table.schema.field(c).type) for c in columns]
        out += [pa.array(np.full(size, offset)), pa.array(np.full(size, edge)), pa.array(np.full(size, part)), pa.array(at)]
        made = pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out], names=schema.names)
        yield from made.cast(schema).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, in_first, carried = TaskContext.get().partitionId(), 0, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            old = 0 if carried is None else carried.num_rows
            table = fresh if carried is None else pa.concat_tables([carried, fresh]).combine_chunks()
            change = np.zeros(table.num_rows, dtype=bool)
            for key in keys:
                column = table.column(key).combine_chunks()
                change[1:] |= _changes(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
            key_run = np.cumsum(change)
            index = np.arange(table.num_rows)
            anchors = index[old:][np.asarray(fresh.column("_anchor"))]
            for d in range(1, n + 1):
                able = anchors[anchors >= d]
                able = able[key_run[able - d] == key_run[able]]
                if len(able):
                    yield from rows(table, able, able - d, -d, False, part, seen + able - old)
            if in_first and seen < n:
                heads = index[old:][(key_run[old:] == 0) & (seen + index[old:] - old < n)]
                if len(heads):
                    yield from rows(table, heads, None, 0, True, part, seen + heads - old)
            in_first = in_first and not key_run[-1]
            seen += fresh.num_rows
            last = index[key_run == key_run[-1]][-n:]
            carried = table.take(pa.array(last)).combine_chunks()
        if carried is not None:
            at = seen - carried.num_rows + np.arange(carried.num_rows)
            # Heads are sent already.
            tails = np.flatnonzero(at >= n) if in_first else np.arange(carried.num_rows)
            if len(tails):
                yield from rows(carried, tails, None, 0, True, part, at[tails])

    return run


def rows_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    anchor: Column,
    n: int,
    columns: Sequence[str],
    prefix: str = "before_",
) -> DataFrame:
    """The anchor rows of ``df``, each once for every row of its key at most ``n`` places before it.

    Adds ``columns`` of the row before under the prefix, and ``offset``, from -1 to -n. One range shuffle on (keys,
    order), which must be total within a key: a hot key is cut into many partitions, and only n rows at each end of a
    partition go on to meet those of others. The pairs are checkpointed, the rows are not.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    flagged = df.withColumn("_anchor", F.coalesce(anchor, F.lit(False)))
    ranged = flagged.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    added = [T.StructField(f"{prefix}{c}", kinds[c]) for c in columns]
    marks = [
        T.StructField(f"{prefix}offset", T.LongType()), T.StructField("_edge", T.BooleanType()),
        T.StructField("_part", T.LongType()), T.StructField("_at", T.LongType()),
    ]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in flagged.schema.fields] + added + marks)
    arrow = to_arrow_schema(schema)
    made = cut(ranged.mapInArrow(_pair_up(n, keys, columns, arrow), schema))
    within = made.filter(~F.col("_edge"))
    edges = made.filter("_edge")
    # Heads and tails of a key follow each other here as in the whole table, as far as n places go.
    in_order = Window.partitionBy(*keys).orderBy("_part", "_at")
    row = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in columns])
    missing = [
        edges.withColumns({"_near": F.lag(row, d).over(in_order), f"{prefix}offset": F.lit(-d).cast("long")}).filter(
            F.col("_anchor") & (F.col("_at") < d) & F.col("_near").isNotNull()
        )
        for d in range(1, n + 1)
    ]
    names = [*df.columns, f"{prefix}offset"]
    out = within.select(*names, *[f"{prefix}{c}" for c in columns])
    for some in missing:
        out = out.unionByName(some.select(*names, *[F.col("_near")[f"{prefix}{c}"].alias(f"{prefix}{c}") for c in columns]))
    return out
