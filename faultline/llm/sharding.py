"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups enter by falling size; each goes to the bin whose remaining capacity is the tightest
that still holds it, found in a balanced order of the remaining capacities. Groups above a
fixed share of a shard are placed one by one (their number is bounded by that share);
smaller ones of a size class are alike, so the whole class is dealt in bulk: as many as fit
to the tightest bin, then on to the next. The driver sees size classes, never the groups.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.skew import attach, held, placed

# Groups above 1/SINGLE of a shard are placed one by one: fewer than SINGLE times the shards.
SINGLE = 256
# Size classes of the others: powers of 2^(1/STEPS), so a few hundred at any size.
STEPS = 16


class Bins:
    """Bins of one capacity, kept in order of what remains; a search takes log(bins)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (remaining, bin), ascending
        self.count = 0

    def tightest(self, size: int) -> tuple[int, int]:
        """Take out the bin with the least room that holds ``size``; a new one if none does."""
        at = bisect.bisect_left(self.order, (size, -1))
        if at < len(self.order):
            return self.order.pop(at)
        self.count += 1
        return self.capacity, self.count - 1

    def put_back(self, room: int, index: int) -> None:
        bisect.insort(self.order, (room, index))


def pack_classes(
    singles: Sequence[tuple[object, int]], classes: Iterable[tuple[int, int, int]], capacity: int
) -> tuple[dict[object, int], list[tuple[int, int, int, int]], int]:
    """Best fit decreasing; returns bins of single groups, byte runs of classes, and the number of bins.

    ``classes`` has (class, groups, bytes). A run (class, from, to, bin) gives the bytes
    of the class, counted in its order, whose groups begin there and go to the bin.
    A group above the capacity gets a bin of its own.
    """
    bins = Bins(capacity)
    single_bins: dict[object, int] = {}
    for key, size in sorted(singles, key=lambda s: (-s[1], str(s[0]))):
        room, index = bins.tightest(size)
        single_bins[key] = index
        bins.put_back(max(room - size, 0), index)
    runs = []
    for kind, groups, total in sorted(classes, reverse=True):
        mean = -(-total // groups)
        start = 0
        while start < total:
            room, index = bins.tightest(min(mean, total - start))
            fit = min(total - start, max(room // mean, 1) * mean)
            runs.append((kind, start, start + fit, index))
            start += fit
            bins.put_back(max(room - fit, 0), index)
    return single_bins, runs, bins.count


def least_capacity(singles, classes, shards: int) -> int:
    """The smallest capacity with which best fit decreasing needs no more than ``shards`` bins."""
    total = sum(s for _, s in singles) + sum(b for _, _, b in classes)
    largest = max([s for _, s in singles], default=1)
    low = max(-(-total // shards), largest, 1)
    high = low
    while pack_classes(singles, classes, high)[2] > shards:
        high = high * 9 // 8 + 1
    while low < high:
        middle = (low + high) // 2
        if pack_classes(singles, classes, middle)[2] > shards:
            low = middle + 1
        else:
            high = middle
    return high


def plan_shards(singles, classes, shards: int):
    """Deal groups to ``shards`` bins of near equal bytes.

    A group larger than an equal share of what is left has a shard to itself; the rest
    is packed into the other shards at the least capacity.
    """
    singles = sorted(singles, key=lambda s: (-s[1], str(s[0])))
    total = sum(s for _, s in singles) + sum(b for _, _, b in classes)
    own: dict[object, int] = {}
    while singles and shards - len(own) > 1 and singles[0][1] * (shards - len(own)) > total:
        key, size = singles.pop(0)
        own[key] = len(own)
        total -= size
    capacity = least_capacity(singles, classes, shards - len(own))
    single_bins, runs, _ = pack_classes(singles, classes, capacity)
    moved = {key: index + len(own) for key, index in single_bins.items()}
    return own | moved, [(kind, a, b, index + len(own)) for kind, a, b, index in runs], capacity


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null: 1), CRC-32, and the key of the group of equal texts."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.sha2(F.coalesce(text, F.lit("")), 256).alias("key"),
    )


def shard_groups(groups: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` to groups (key, ``bytes``); sizes of the shards come out near equal."""
    spark = groups.sparkSession
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    large = F.col("bytes") * (SINGLE * shards) > total
    kind: Column = F.floor(F.log2(F.col("bytes").cast("double")) * STEPS).cast("int")
    singles = [(r.key, r.bytes) for r in groups.filter(large).select("key", "bytes").collect()]
    small = groups.filter(~large).withColumn("class", kind)
    classes = [
        (r["class"], r["n"], r["b"])
        for r in small.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).collect()
    ]
    single_bins, runs, _ = plan_shards(singles, classes, shards)
    fixed = spark.createDataFrame(
        [(k, b) for k, b in single_bins.items()],
        T.StructType([T.StructField("_k", groups.schema["key"].dataType), T.StructField("shard", T.IntegerType())]),
    )
    counts = spark.createDataFrame([(k, n) for k, n, _ in classes], "class int, _rows long")
    table = spark.createDataFrame(runs, "_class int, _from long, _to long, shard int")
    by_single = groups.filter(large).join(F.broadcast(fixed), F.col("key") == F.col("_k")).drop("_k")
    begun = placed(small, "class", ["key"], counts, weight=F.col("bytes"), name="_begin")
    by_class = begun.join(
        F.broadcast(table),
        (F.col("class") == F.col("_class")) & (F.col("_begin") >= F.col("_from")) & (F.col("_begin") < F.col("_to")),
    )
    return by_single.unionByName(by_class.select(*by_single.columns))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Equal texts (null and empty ones too) are one group and stay together; the law is
    ``bytes``. A group above an equal share has a shard to itself. Slots number the
    rows of a shard without gaps, in no order of meaning. Rows that repeat an id are told
    apart by nothing, so ids should be unique; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = held(sized(docs, id_col, text_col), "sized")
    groups = held(
        rows.groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), F.sum("size").alias("bytes")), "text-groups"
    )
    homes = held(shard_groups(groups, shards), "group-shards")
    joined = held(attach(rows, homes, "key", "doc_id", ["shard"]).drop("key"), "sharded")
    filled = [(r.shard, r["count"]) for r in joined.groupBy("shard").count().collect()]
    counts = spark.createDataFrame(filled, "shard int, _rows long")
    return placed(joined, "shard", ["doc_id"], counts, name="slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
