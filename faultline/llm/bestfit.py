"""Best-two-fit packing of token sequences into fixed windows.

Only lengths decide, and there are no more than ``size`` of them, so the plan is made from
the histogram of lengths: fill a window greedily with the longest piece that fits, then take
its smallest piece out again if two unpacked pieces fill the widened gap more tightly. A
window found once is repeated as often as the histogram allows, which makes a few patterns
at most per length. Pieces find their places by their number within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.skew import held, placed
from faultline.llm.words import few_rows, lean

SIZE = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def largest_fit(counts: np.ndarray, gap: int) -> int:
    """The longest remaining piece of at most ``gap`` tokens; 0 if none."""
    left = np.flatnonzero(counts[: gap + 1])
    return int(left[-1]) if len(left) else 0


def best_pair(counts: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two remaining pieces with the largest sum of at most ``gap``."""
    lengths = np.flatnonzero(counts[: gap + 1])
    best, found = 0, None
    low, high = 0, len(lengths) - 1
    while low <= high:
        a, b = int(lengths[low]), int(lengths[high])
        if a + b > gap or (low == high and counts[a] < 2):
            high -= 1
            continue
        if a + b > best:
            best, found = a + b, (b, a)
        low += 1
    return found


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(piece lengths of a window, number of such windows) that use up the histogram."""
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    made = []
    while True:
        top = largest_fit(counts, size)
        if not top:
            return made
        window: list[int] = []
        gap = size
        while gap and (length := largest_fit(counts, gap)):
            window.append(length)
            counts[length] -= 1
            gap -= length
        if gap:
            smallest = window[-1]
            pair = best_pair(counts, gap + smallest)
            if pair and sum(pair) > smallest:
                window.pop()
                counts[smallest] += 1
                for length in pair:
                    window.append(length)
                    counts[length] -= 1
        used = Counter(window)
        more = int(min(counts[length] // n for length, n in used.items()))
        for length, n in used.items():
            counts[length] -= more * n
        made.append((tuple(sorted(window, reverse=True)), more + 1))


def places(made: Iterable[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, copies, sequence, offset): where pieces first..last of a length go.

    Piece number r goes to window sequence + (r - first) // copies, at offset +
    length * ((r - first) % copies).
    """
    seen: Counter[int] = Counter()
    rows, sequence = [], 0
    for window, repeats in made:
        offset = 0
        for length, copies in sorted(Counter(window).items(), reverse=True):
            n = copies * repeats
            rows.append((length, seen[length], seen[length] + n - 1, copies, sequence, offset))
            seen[length] += n
            offset += length * copies
        sequence += repeats
    return rows


def cut_points(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first takes what is left over."""
    first = n % size or size
    return [(0, min(first, n))] + [(s, size) for s in range(first, n, size)]


def token_pieces(encoder, size: int = SIZE):
    """A mapInArrow function from (doc_id, text) to PIECES; ``encoder()`` makes the tokenizer in the task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in few_rows(batches):
            ids, columns = batch.column(0), ([], [], [], [], [])
            for at, text in enumerate(batch.column(1)):
                tokens = encode(text.as_py() or "") + END_ID.to_bytes(4, "little")
                for piece, (start, length) in enumerate(cut_points(len(tokens) // 4, size)):
                    row = (at, piece, start, length, zlib.crc32(tokens[4 * start : 4 * (start + length)]))
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(columns[0], pa.int64())).cast(pa.int64()),
                    pa.array(columns[1], pa.int32()),
                    *[pa.array(c, pa.int64()) for c in columns[2:]],
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...); every piece keeps its row.

    ``pieces`` should be held: it is read for the histogram, the bucket totals and the places.
    """
    spark = pieces.sparkSession
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows = places(patterns(histogram, size))
    table = spark.createDataFrame(
        rows, "_length long, _first long, _last long, _copies long, _sequence long, _offset long"
    )
    counts = spark.createDataFrame(list(histogram.items()), "length long, _rows long")
    numbered = placed(pieces, "length", ["doc_id", "piece"], counts, name="_at")
    here = F.col("_at") - F.col("_first")
    return numbered.join(
        F.broadcast(table),
        (F.col("length") == F.col("_length")) & F.col("_at").between(F.col("_first"), F.col("_last")),
    ).select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(here / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.col("length") * F.pmod(here, F.col("_copies"))).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, encoder, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack whole texts: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end token alone. Only documents above ``size`` tokens
    are cut. Repeated rows are packed as often as they stand in the table; an empty table
    gives no rows.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return pack(held(narrow.mapInArrow(token_pieces(encoder, size), PIECES), "pieces"), size)
