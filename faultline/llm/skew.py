"""Joins and numbering that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from faultline.session import new_folder

# A key with more than 1/HEAVY of all rows is heavy; there are fewer than HEAVY such keys at any size.
HEAVY = 2000
# Rows in a batch that goes to Python, where the session has not set its own: texts are long.
BATCH_ROWS = 2000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
# A held table of at most so many rows and bytes may be sent to every executor.
SENT_ROWS, SENT_BYTES = 500_000, 16 << 20


def held(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files.

    Cuts lineage: a lost executor costs no recomputation of what stands before, and
    later branches read only the columns they need.
    """
    short_batches(df.sparkSession)
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def short_batches(spark: SparkSession) -> None:
    """Lower the batch size from its default, which holds ten thousand whole texts on both sides of the pipe."""
    if spark.conf.get(_BATCHES) == "10000":
        spark.conf.set(_BATCHES, str(BATCH_ROWS))


def numbered(df: DataFrame, label: str, name: str = "_row", compression: str = "snappy") -> DataFrame:
    """``df`` held with a stored number of its own in each row; ids may be missing or repeated.

    A column of the caller with that name waits as ``name~own``.
    """
    if name in df.columns:
        df = df.withColumnRenamed(name, own_name(name))
    return held(df.withColumn(name, F.monotonically_increasing_id()), label, compression)


def lies_in_files(df: DataFrame) -> bool:
    """Whether ``df`` is Parquet files as they lie, each read once, with columns chosen or made at most."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or "_metadata" in df.columns:
        return False
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().toString() != "Parquet":
        return False
    files = list(relation.location().inputFiles())
    return len(set(files)) == len(files)


def numbered_in_place(df: DataFrame, label: str, name: str = "_row", compression: str = "snappy") -> DataFrame:
    """``numbered`` without a copy of rows that lie in Parquet files: their number is the file's and the place in it.

    Files are never overwritten while they are read, and their rows keep their places; other rows are held.
    Only the names of the files reach the driver.
    """
    if not lies_in_files(df):
        return numbered(df, label, name, compression)
    short_batches(df.sparkSession)
    if name in df.columns:
        df = df.withColumnRenamed(name, own_name(name))
    file, start = f"{name}~file", f"{name}~start"
    paths = sorted(r[0] for r in df.select(F.col("_metadata.file_path").alias(file)).distinct().collect())
    starts = df.sparkSession.createDataFrame(
        [(path, n << 33) for n, path in enumerate(paths)], f"`{file}` string, `{start}` long"
    )
    found = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(name))
    return found.join(F.broadcast(starts), file).withColumn(name, F.col(f"`{start}`") + F.col(name)).drop(file, start)


def own_name(name: str) -> str:
    return f"{name}~own"


def unnumbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Without the number, and with the caller's own column of that name."""
    return df.drop(name).withColumnRenamed(own_name(name), name)


def without_rows(rows: DataFrame, gone: DataFrame, label: str, name: str = "_row") -> DataFrame:
    """The rows of ``numbered`` whose number is not in ``gone`` (_gone), without the number."""
    gone = held(gone, label)
    if fits(gone):
        return unnumbered(rows.join(F.broadcast(gone), F.col(name) == F.col("_gone"), "left_anti"), name)
    marked = marked_rows(rows, gone, f"{label}-bits", name)
    if marked is not None:
        return unnumbered(marked.filter(~F.col("_marked")).drop("_marked"), name)
    return unnumbered(rows.join(gone, F.col(name) == F.col("_gone"), "left_anti"), name)


def marked_rows(rows: DataFrame, numbers: DataFrame, label: str, name: str = "_row") -> DataFrame | None:
    """``rows`` with ``_marked``: whether their number is in ``numbers`` (_gone), by a bit per number that every task holds.

    Numbers are never missing. None if the bits are too many to be broadcast.
    """
    bits = held(
        numbers.groupBy(F.bitmap_bucket_number("_gone").alias("_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("_gone")).alias("_bits")
        ),
        label,
    )
    if not fits(bits):
        return None
    place = f"bitmap_bit_position(`{name}`)"
    byte = f"cast(conv(hex(substring(_bits, cast({place} div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.expr(f"shiftright({byte}, cast({place} % 8 as int)) & 1")
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(name) == F.col("_bucket"), "left")
    return found.withColumn("_marked", F.coalesce(bit, F.lit(0)) == 1).drop("_bucket", "_bits")


def fits(kept: DataFrame) -> bool:
    """Whether the counted rows and bytes of a held table allow its broadcast."""
    wide = [F.octet_length(f"`{c}`") for c, kind in kept.dtypes if kind in ("string", "binary")]
    width = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(8 * len(kept.columns)))
    size = kept.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return size.rows <= SENT_ROWS and size.bytes <= SENT_BYTES


def by_size(df: DataFrame, label: str) -> DataFrame:
    """A held table of narrow rows, marked for broadcast if its counted rows and bytes allow it.

    Beyond the bounds it is returned as it is, and a join with it shuffles both sides.
    """
    kept = held(df, label)
    return F.broadcast(kept) if fits(kept) else kept


def attach(
    rows: DataFrame, groups: DataFrame, key: str, row_id: str, columns: Sequence[str], size: str = "group_size"
) -> DataFrame:
    """Left join of ``groups`` (one row per key) to ``rows``, without a hot key in one task.

    ``groups.size`` counts the rows of each key. Keys with more than 1/HEAVY of all rows,
    of which there are fewer than HEAVY, are broadcast; their rows then go through the
    second join under a key of their own (the row id), so they spread evenly. A null key
    finds nothing. ``rows`` is read once; ``groups`` should be held, since it is read twice.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    heavy = groups.filter(F.col(size) * HEAVY > total)
    light = groups.filter(F.col(size) * HEAVY <= total)

    def packed(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(F.col(key).alias(f"{name}_key"), F.struct(*columns).alias(name))

    first = rows.join(F.broadcast(packed(heavy, "_heavy")), rows[key] == F.col("_heavy_key"), "left")
    kind = dict(rows.dtypes)[key]
    if kind == "string":
        own = F.concat(F.lit("~"), F.col(row_id).cast("string"))
    elif kind == "binary":
        own = F.concat(F.lit(b"~"), F.col(row_id).cast("string").cast("binary"))
    else:
        own = None
    if own is None:
        # Numbers: a second column keeps the rows of heavy keys apart.
        apart = F.when(F.col("_heavy_key").isNull() & F.col(key).isNotNull(), F.lit(-1)).otherwise(
            F.pmod(F.xxhash64(row_id), F.lit(1 << 20))
        )
        first = first.withColumn("_apart", apart)
        second = packed(light, "_light").withColumn("_none", F.lit(-1).cast("long"))
        joined = first.join(
            second, (F.col(key) == F.col("_light_key")) & (F.col("_apart") == F.col("_none")), "left"
        ).drop("_apart", "_none")
    else:
        first = first.withColumn(
            "_own", F.when(F.col("_heavy_key").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(own)
        )
        joined = first.join(packed(light, "_light"), F.col("_own") == F.col("_light_key"), "left").drop("_own")
    found = [F.coalesce(F.col(f"_heavy.{c}"), F.col(f"_light.{c}")).alias(c) for c in columns]
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *found)


def placed(
    df: DataFrame, key: str, order: Sequence[str], counts: DataFrame, weight: Column | None = None, name: str = "rank"
) -> DataFrame:
    """Number the rows of every key from 0, gapless; or add up ``weight`` of the rows before.

    ``counts`` (key, ``_rows``) has few keys, by the caller's bound, and is broadcast. Each
    key is cut by hash into as many buckets as the square root of its rows, so no task sees
    more of a key than that; only bucket totals are added up in order. ``order`` must be
    unique within a key. ``df`` is read twice.
    """
    step = F.lit(1).cast("long") if weight is None else weight.cast("long")
    small = F.broadcast(
        counts.select(F.col(key).alias("_key"), F.ceil(F.sqrt(F.col("_rows"))).cast("long").alias("_buckets"))
    )
    spread = (
        df.join(small, F.col(key) == F.col("_key"))
        .withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_buckets")))
        .withColumn("_step", step)
        .drop("_key", "_buckets")
    )
    sums = spread.groupBy(key, "_bucket").agg(F.sum("_step").alias("_sum"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col(key).alias("_key"),
        F.col("_bucket").alias("_start_bucket"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = spread.withColumn("_inside", F.coalesce(F.sum("_step").over(inside), F.lit(0)))
    return (
        ranked.join(starts, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_start_bucket")))
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_key", "_bucket", "_start_bucket", "_start", "_inside", "_step")
    )
