"""Records that go on over lines and blocks, put together from fragments.

A file is read in fragments between the occurrences of one byte, which Spark splits at any block. What a
fragment does to the state of a reader (inside quotes or not, depth) is summed up per block; the summaries
compose, so a running sum over the few blocks gives every block the state it starts in. Tasks then join the
fragments of their blocks to records side by side, and only what reaches over a block's edge moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.plans.cut import cut
from faultline.plans.joins import broadcast_if_small, lookup_join
from faultline.sources.numbering import pin_splits

# Fragments that are turned into Python texts at once.
FEW = 4096
HEAD, WHOLE, TAIL = 0, 1, 2
PLACED = "source_file string, block long, at long, kind int, text string"
# What a batch holds before the texts and the measures of its fragments.
LEADING = 5


def fragments(scan: DataFrame) -> DataFrame:
    """A bare text scan with the file and block of each fragment."""
    pin_splits(scan.sparkSession)
    return scan.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("value").alias("text"),
    )


def runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Parts of a batch that are of one file and block."""
    blocks = batch.column(1).to_numpy()
    files = batch.column(0).dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (files[1:] != files[:-1])) + 1
    for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if end > start:
            yield batch.column(0)[int(start)].as_py(), int(blocks[start]), batch.slice(start, end - start)


Measure = Callable[[pa.Array], list[np.ndarray]]
Ends = Callable[[list[np.ndarray], tuple[int, int]], tuple[np.ndarray, tuple[int, int]]]


def join_fragments(ends: Ends, glue: str, measure: Measure | None = None):
    """mapInArrow over (source_file, block, fragments, state, depth, text, measures...): PLACED.

    ``ends`` tells which fragments end a record, and the state after them, from what ``measure`` finds in the
    texts, if there is one, and from the measures that stand behind the text. A block's first
    record may have begun before it (HEAD), and its last text may go on behind it (TAIL).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, at, seen, due, pending = None, (0, 0), 0, 0, 0, []

        def tail():
            if seen != due:
                raise RuntimeError("file splits changed while records were put together")
            return placed([(*key, at, TAIL, "".join(pending))])

        for whole in batches:
            for start in range(0, whole.num_rows, FEW):
                for file, block, part in runs(whole.slice(start, FEW)):
                    if key != (file, block):
                        if key is not None:
                            yield tail()
                        key, at, seen, pending = (file, block), 0, 0, []
                        due = part.column(2)[0].as_py()
                        state = part.column(3)[0].as_py(), part.column(4)[0].as_py()
                    seen += part.num_rows
                    measures = measure(part.column(LEADING)) if measure else []
                    measures += [c.to_numpy(zero_copy_only=False) for c in part.columns[LEADING + 1 :]]
                    stops, state = ends(measures, state)
                    texts, rows, first = part.column(LEADING).to_pylist(), [], 0
                    for stop in np.flatnonzero(stops):
                        text = "".join(pending) + glue.join(texts[first : stop + 1]) + glue
                        rows.append((file, block, at, WHOLE if at else HEAD, text))
                        at, first, pending = at + 1, int(stop) + 1, []
                    pending += [t + glue for t in texts[first:]]
                    if rows:
                        yield placed(rows)
        if key is not None:
            yield tail()

    return run


def placed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)],
        names=["source_file", "block", "at", "kind", "text"],
    )


def by_block(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Fragments beside the state their block starts in; blocks whose state has no ``wanted`` are left out."""
    known = broadcast_if_small(states.withColumnsRenamed({"source_file": "_file", "block": "_block"}))
    joined = rows.join(known, (F.col("source_file") == F.col("_file")) & (F.col("block") == F.col("_block")), "left")
    lost = F.raise_error(F.lit("file splits changed while records were put together")).cast("boolean")
    return joined.filter(F.coalesce("wanted", lost)).drop("_file", "_block")


def records(rows: DataFrame, ends: Ends, glue: str, measure: Measure | None = None) -> tuple[DataFrame, DataFrame]:
    """(source_file, number, text) of all records from 1, and (source_file, records, text) of what is left of each file.

    ``rows``: what :func:`join_fragments` reads. The records are checkpointed once.
    """
    found = cut(rows.mapInArrow(join_fragments(ends, glue, measure), PLACED))
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = found.groupBy("source_file", "block").agg(F.count_if(F.col("kind") != TAIL).alias("_n"))
    before = cut(counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    inside = found.filter(F.col("kind") == WHOLE).join(
        broadcast_if_small(before.select("source_file", "block", "_before")), ["source_file", "block"]
    )
    wholes = inside.select("source_file", (F.col("_before") + F.col("at") + 1).alias("number"), "text")
    # At most two pieces of a block meet others: a head ends what the tails before it began.
    past = Window.partitionBy("source_file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, -1)
    edges = found.filter(F.col("kind") != WHOLE).withColumn(
        "_group", F.coalesce(F.count_if(F.col("kind") == HEAD).over(past), F.lit(0))
    )
    pieces = F.array_sort(F.collect_list(F.struct("block", "kind", "text")))
    joined = edges.groupBy("source_file", "_group").agg(
        F.bool_or(F.col("kind") == HEAD).alias("_ended"),
        F.max("block").alias("block"),
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
    )
    over = joined.filter("_ended").join(before.select("source_file", "block", "_before"), ["source_file", "block"])
    totals = before.groupBy("source_file").agg(F.sum("_n").alias("records"))
    rests = joined.filter("NOT _ended").join(totals, "source_file").select("source_file", "records", "text")
    return (
        wholes.unionByName(over.select("source_file", (F.col("_before") + 1).alias("number"), "text")),
        rests,
    )


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


# --- JSON: fragments end at closing braces -----------------------------------------------------


def json_measures(texts: pa.Array) -> list[np.ndarray]:
    """What each fragment does, if it starts outside a string (0) or inside one (1).

    Quotes (odd or even), depth0, depth1, and whether a line break stands in a string: broken0, broken1. A
    closing brace counts in no depth; fragments are those between closing braces.
    """
    texts = texts.cast(pa.large_string())
    if pc.any(pc.match_substring(texts, "\\")).as_py():
        texts = pc.replace_substring_regex(texts, r"(?s)\\.", "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    octets = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    starts, ends = ends[:-1] - ends[0], ends[1:] - ends[0]

    def summed(values: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return running[ends] - running[starts]

    quote = octets == ord('"')
    running = np.concatenate([[0], np.cumsum(quote, dtype=np.int64)])
    # Whether each octet stands in a string, if its fragment starts outside one.
    inside = ((running[1:] - np.repeat(running[starts], ends - starts)) % 2).astype(bool)
    deeper = ((octets == ord("{")) | (octets == ord("["))).astype(np.int8) - (octets == ord("]"))
    line_break = (octets == ord("\n")) | (octets == ord("\r"))
    return [
        (running[ends] - running[starts]) % 2,
        summed(np.where(inside, 0, deeper)),
        summed(np.where(inside, deeper, 0)),
        summed(line_break & inside) > 0,
        summed(line_break & ~inside) > 0,
    ]


def json_states(quotes: np.ndarray, depth0: np.ndarray, depth1: np.ndarray, state: tuple[int, int]):
    """Whether each fragment starts in a string, whether its closing brace stands in one, and the depth after it."""
    after = (state[0] + np.cumsum(quotes)) % 2
    before = np.concatenate([[state[0]], after[:-1]])
    change = np.where(before == 0, depth0, depth1) - (after == 0)
    return before, after, state[1] + np.cumsum(change)


def json_ends(measures: list[np.ndarray], state: tuple[int, int]) -> tuple[np.ndarray, tuple[int, int]]:
    """Records end with a brace that closes down to the depth in the last measure."""
    _, after, depth = json_states(*measures[:3], state)
    return (after == 0) & (depth == measures[-1]), (int(after[-1]), int(depth[-1]))


SUMMARY = (
    "source_file string, block long, file_size long, fragments long, bytes long, quotes int, depth0 long, depth1 long, "
    "broken0 boolean, broken1 boolean, closed long, more boolean, first string"
)


def sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (source_file, block, file_size, bytes, first, text): SUMMARY, one row per block of a task.

    ``closed`` counts returns to depth 0 and ``more`` tells of text after the first, both as if the block began a file.
    """
    blocks: dict[tuple[str, int], list] = {}
    for batch in batches:
        for file, block, part in runs(batch):
            size, first = part.column(2)[0].as_py(), part.column(4).to_pylist()
            octets = int(part.column(3).to_numpy().sum())
            quotes, depth0, depth1, broken0, broken1 = json_measures(part.column(5))
            own = blocks.setdefault((file, block), [size, 0, 0, (0, 0), (1, 0), False, False, 0, False, None])
            at_return = own[7]
            for side, (place, flag) in enumerate(((3, 5), (4, 6))):
                before, after, depth = json_states(quotes, depth0, depth1, own[place])
                own[place] = int(after[-1]), int(depth[-1])
                own[flag] |= bool(np.where(before == 0, broken0, broken1).any())
                if side == 0:
                    closes = np.flatnonzero((after == 0) & (depth == 0))
                    own[7] += len(closes)
                    later = 0 if at_return else int(closes[0]) + 1 if len(closes) else len(first)
                    own[8] |= any(first[later:]) or len(closes) > 1 or bool(at_return and len(closes))
            own[1] += part.num_rows
            own[2] += octets
            own[9] = own[9] or next((c for c in first if c), None)
    rows = [
        (f, b, o[0], o[1], o[2], o[3][0], o[3][1], o[4][1], o[5], o[6], o[7], o[8], o[9]) for (f, b), o in blocks.items()
    ]
    whole, flag, text = pa.int64(), pa.bool_(), pa.string()
    kinds = (text, whole, whole, whole, whole, pa.int32(), whole, whole, flag, flag, whole, flag, text)
    names = [part.split()[0] for part in SUMMARY.split(", ")]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names
        )


def json_blocks(rows: DataFrame) -> DataFrame:
    """Per block of every file: the state it starts in, and what is known of the file.

    ``base``: 1 for a file that may be one array, 0 for one that may be one object, null for any other.
    """
    measured = rows.select(
        "source_file", "block", "file_size", (F.octet_length("text") + 1).cast("long").alias("bytes"),
        F.substring(F.ltrim(F.col("text"), F.lit(" \t\n\r")), 1, 1).alias("first"), "text",
    )
    blocks = cut(measured.mapInArrow(sum_blocks, SUMMARY))
    order = Window.partitionBy("source_file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    started = blocks.withColumn("state", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).cast("int"))
    moved = F.when(F.col("state") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    broken = F.when(F.col("state") == 0, F.col("broken0")).otherwise(F.col("broken1"))
    deep = started.withColumns({"_moved": moved, "_broken": broken}).withColumn(
        "depth", F.coalesce(F.sum("_moved").over(earlier), F.lit(0))
    )
    whole = Window.partitionBy("source_file")
    opening = F.first("first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first_block = F.min(F.when(F.col("block") == 0, F.struct("closed", "more"))).over(whole)
    one_object = (first_block["closed"] == 0) | ((first_block["closed"] == 1) & ~first_block["more"])
    return deep.select(
        "source_file", "block", "fragments", "state", "depth",
        F.when(F.bool_or("_broken").over(whole), None)
        .when(opening == "[", 1)
        .when((opening == "{") & one_object, 0)
        .alias("base"),
        # The text source leaves no trace of a last separator; the size of the file does.
        (F.sum("bytes").over(whole) == F.col("file_size")).alias("ends_closed"),
    )


def json_documents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts of the files that may be one JSON document, and (source_file) of all others.

    Parts (source_file, number, text, last, base, ends_closed): the objects of an array, each with what stands before
    it; the last part, numbered after them, is what follows the last object.
    """
    # A line break between a closing and an opening brace stands in no document: such a file has a value per line.
    lined = F.bool_or(F.col("text").rlike(r"^[ \t\r]*\n\s*\{"))
    kinds = cut(rows.groupBy("source_file").agg(lined.alias("lined")))
    by_line = kinds.filter("lined").select("source_file")
    if kinds.filter("NOT lined").isEmpty():
        parts = "source_file string, number long, text string, last boolean, base int, ends_closed boolean"
        return rows.sparkSession.createDataFrame([], parts), by_line
    rows = lookup_join(rows, kinds.filter("NOT lined").select("source_file"), ["source_file"], "left_semi")
    blocks = cut(json_blocks(rows))
    wanted = blocks.withColumn("wanted", F.col("base").isNotNull()).drop("ends_closed")
    asked = by_block(rows.drop("file_size"), wanted).select(
        "source_file", "block", "fragments", "state", "depth", "text", "base"
    )
    found, rests = records(asked, json_ends, "}", json_measures)
    rest = rests.select("source_file", (F.col("records") + 1).alias("number"), "text")
    parts = found.withColumn("last", F.lit(False)).unionByName(rest.withColumn("last", F.lit(True)))
    files = blocks.groupBy("source_file").agg(F.max("base").alias("base"), F.bool_or("ends_closed").alias("ends_closed"))
    # The text after the last brace got one too many, unless the file ends with it.
    text = F.when(F.col("last") & ~F.col("ends_closed"), F.substring("text", F.lit(1), F.length("text") - 1))
    return (
        parts.join(broadcast_if_small(files), "source_file").withColumn("text", F.coalesce(text, "text")),
        files.filter("base IS NULL").select("source_file").unionByName(by_line),
    )


# --- CSV: fragments are lines, and a record ends where its quotes are closed ---------------------


def csv_ends(measures: list[np.ndarray], state: tuple[int, int]) -> tuple[np.ndarray, tuple[int, int]]:
    """Blank lines between records go with the record behind them."""
    quotes, blank = measures
    after = (state[0] + np.cumsum(quotes)) % 2
    return (after == 0) & ~blank, (int(after[-1]), 0)


def csv_records(rows: DataFrame) -> DataFrame:
    """(source_file, number, text) of the records of CSV files, the header being the first; quoted cells may hold line breaks.

    A file whose last quote is never closed has the rest of its text as its last record.
    """
    measured = rows.select(
        "source_file", "block", "text", (count_of(F.col("text"), '"') % 2).alias("quotes"), (F.trim(F.translate("text", "\r\t", "")) == "").alias("blank")
    )
    blocks = cut(measured.groupBy("source_file", "block").agg(F.count(F.lit(1)).alias("fragments"), F.sum("quotes").alias("_quotes")))
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = blocks.select(
        "source_file", "block", "fragments", (F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2).cast("int").alias("state"),
        F.lit(0).alias("depth"), F.lit(True).alias("wanted"),
    )
    asked = by_block(measured, states).select(
        "source_file", "block", "fragments", "state", "depth", "text", "quotes", "blank"
    )
    found, rests = records(asked, csv_ends, "\n")
    open_ones = rests.filter(F.trim(F.translate("text", "\r\n\t", "")) != "").select(
        "source_file", (F.col("records") + 1).alias("number"), "text"
    )
    bare = F.regexp_replace(F.regexp_replace("text", r"^(?:[ \t\r]*\n)+", ""), r"\r?\n$", "")
    return found.unionByName(open_ones).withColumn("text", bare)
