"""Removal of long byte strings that occur more than once, by run-length indexes over candidates.

Every window of ``length`` bytes has an anchor: its smallest k-gram by hash. Equal windows
have equal anchors at equal places, so only the strings around anchors that occur twice can hold a
repeat. A string that is repeated as a whole is settled by its hash. The others are gathered by
anchor, and each gathering is indexed: its suffixes are sorted, the transform (the bytes before
them) is compressed to runs, and only at the ends of runs is the longest match with a neighbour
compared; inside a run the match of a position is that of the position before less one, so
the matching statistics are streamed from the run ends, and windows with a match of ``length``
are marked. Anchors with very many strings are split by the windows themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.skew import HEAVY, held, numbered
from faultline.llm.words import Sums, TextSlice, lean, text_slices

LENGTH, GRAM = 200, 32
SLICE = 2 << 20
# An anchor with more strings is split by windows; a gathering holds about so many bytes.
MOST_STRINGS, GATHERED = 256, 1 << 19
# Windows of a bucket, about.
BUCKET = 200_000
CARRIED = 50_000

COVERED, EDGE, REFERENCE = 0, 1, 2
SENT = "anchor long, run long, row long, lo int, hi int, twice boolean, often int"
MARKS = "row long, lo int, hi int, anchor long, kind int, hot boolean"


def anchored_runs(part: TextSlice, length: int, gram: int, sums: Sums):
    """Runs of windows with one anchor: (row, first start, last start, anchor position), in the slice."""
    n = len(part.data)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none
    bits = np.uint64(int(n).bit_length())
    at = np.arange(n - gram + 1, dtype=np.int64)
    key = (sums.hashes(at, at + gram) >> bits << bits) | at.astype(np.uint64)
    # Minimum over each window's grams by doubling.
    width, least = length - gram + 1, key
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = width - step
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(part.offsets)
    windows = np.maximum(sizes - length + 1, 0)
    row = np.repeat(np.arange(len(sizes)), windows)
    start = np.repeat(part.offsets[:-1], windows) + (
        np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    )
    if not len(row):
        return none, none, none, none
    own = anchor[start]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(row)) - 1
    return row[begin], start[begin], start[end], own[begin]


def counts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each key occurs, and whether it is its first occurrence."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(keys), dtype=bool)
    is_first[first] = True
    return counts[inverse], is_first


def send_runs(length: int, gram: int):
    """mapInArrow: (row, text) to SENT.

    A run that occurs twice within the slice is known to be repeated: it is sent once, with
    ``twice`` set, and its other occurrences are rows without an anchor. ``often`` is the
    number of different runs that its anchor has in the slice.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for part in text_slices(batch.column(1), SLICE):
                if len(part.data) < length:
                    continue
                sums = Sums(part.data)
                row, lo, hi, at = anchored_runs(part, length, gram, sums)
                if not len(row):
                    continue
                anchor = sums.hashes(at, at + gram).view(np.int64)
                whole = sums.hashes(lo, hi + length).view(np.int64)
                times, first = counts_of(whole)
                often, _ = counts_of(anchor[first])
                spread = np.zeros(len(row), dtype=np.int32)
                spread[first] = often
                base = part.offsets[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor, mask=~first),
                        pa.array(whole, mask=~first),
                        pa.array(rows[part.first + row]),
                        pa.array((lo - base).astype(np.int32)),
                        pa.array((hi - base).astype(np.int32)),
                        pa.array(times > 1),
                        pa.array(spread),
                    ],
                    names=["anchor", "run", "row", "lo", "hi", "twice", "often"],
                )

    return run


def classify(group: dict[str, np.ndarray], big: bool) -> pa.RecordBatch:
    """MARKS of whole groups, sorted by key and run.

    Runs found twice are covered; single runs of an anchor that has others are edges, and one
    of each covered run beside them is a reference. ``big``: the groups go on elsewhere.
    """
    key, run = group["key"], group["run"]
    n = len(key)
    new_key = np.ones(n, dtype=bool)
    new_key[1:] = key[1:] != key[:-1]
    new_run = new_key.copy()
    new_run[1:] |= run[1:] != run[:-1]
    key_at, run_at = np.cumsum(new_key) - 1, np.cumsum(new_run) - 1
    rows_of_run = np.bincount(run_at)
    twice = np.bincount(run_at, group["twice"].astype(float)) > 0
    covered = ((rows_of_run > 1) | twice)[run_at]
    runs_of_key = np.bincount(key_at, new_run.astype(float))[key_at]
    rows_of_key = np.bincount(key_at)[key_at]
    others = (runs_of_key > 1) | group["hot"] | big
    hot = group["hot"] | (rows_of_key > MOST_STRINGS) | big
    picked = [np.flatnonzero(covered), np.flatnonzero(~covered & others), np.flatnonzero(covered & new_run & others)]
    at = np.concatenate(picked)
    kind = np.repeat(np.array([COVERED, EDGE, REFERENCE], dtype=np.int32), [len(p) for p in picked])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(group["row"][at]),
            pa.array(group["lo"][at]),
            pa.array(group["hi"][at]),
            pa.array(group["anchor"][at]),
            pa.array(kind),
            pa.array(hot[at]),
        ],
        names=["row", "lo", "hi", "anchor", "kind", "hot"],
    )


FIELDS = ("key", "anchor", "run", "row", "lo", "hi", "twice", "hot")


def collapse(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], pa.RecordBatch]:
    """One row of each run, known to be there twice if it is, and MARKS of the others, which are covered."""
    new = np.ones(len(rows["key"]), dtype=bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["run"][1:] != rows["run"][:-1])
    kept = {f: rows[f][new] for f in FIELDS}
    times = np.diff(np.append(np.flatnonzero(new), len(new)))
    kept["twice"] = kept["twice"] | (times > 1)
    at = np.flatnonzero(~new)
    columns = [pa.array(rows[f][at]) for f in ("row", "lo", "hi", "anchor")]
    columns += [pa.array(np.full(len(at), COVERED, dtype=np.int32)), pa.array(rows["hot"][at])]
    return kept, pa.RecordBatch.from_arrays(columns, names=["row", "lo", "hi", "anchor", "kind", "hot"])


@lean
def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (FIELDS) sorted by key and run: MARKS.

    The last group of a batch waits for the next, with one row of each of its runs if there are many. A
    group with more than CARRIED runs is passed on run by run, to be split by windows.
    """
    carried: dict[str, np.ndarray] | None = None
    big_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {f: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(FIELDS)}
        if carried is not None:
            rows = {f: np.concatenate([carried[f], rows[f]]) for f in FIELDS}
        if big_key is not None:
            until = int(np.searchsorted(rows["key"] != big_key, True))
            if until == len(rows["key"]):
                until = int(np.flatnonzero(rows["run"] == rows["run"][-1])[0])
                last_run = {f: rows[f][until:] for f in FIELDS}
                if until:
                    yield classify({f: rows[f][:until] for f in FIELDS}, True)
                carried, covered = collapse(last_run)
                yield covered
                continue
            yield classify({f: rows[f][:until] for f in FIELDS}, True)
            rows = {f: rows[f][until:] for f in FIELDS}
            big_key = None
        last = int(np.flatnonzero(rows["key"] == rows["key"][-1])[0])
        if last:
            yield classify({f: rows[f][:last] for f in FIELDS}, False)
        carried = {f: rows[f][last:] for f in FIELDS}
        if len(carried["key"]) > CARRIED:
            carried, covered = collapse(carried)
            yield covered
        if len(carried["key"]) > CARRIED:
            big_key = carried["key"][-1]
            until = len(carried["key"]) - 1
            yield classify({f: carried[f][:until] for f in FIELDS}, True)
            carried = {f: carried[f][until:] for f in FIELDS}
    if carried is not None and len(carried["key"]):
        yield classify(carried, big_key is not None)


# --- the index of a gathering ---------------------------------------------------------------


FIRST = 7  # bytes that the first sort compares


def suffix_order(data: np.ndarray, string: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffixes of a set of strings in order; a string's end differs from every other's.

    Sorted by their first bytes, then by doubling, where only groups still tied are sorted again.
    """
    n = len(data)
    at = np.arange(n)
    padded = np.zeros(n + FIRST, dtype=np.int64)
    padded[:n] = data
    room = end - at
    key = np.zeros(n, dtype=np.int64)
    for k in range(FIRST):
        key <<= 9
        key |= np.where(k < room, padded[k : n + k] + 1, 0)
    order = np.argsort(key)
    slots, rank = np.arange(n), np.zeros(n, dtype=np.int64)
    key, sub, depth = key[order], order, FIRST
    while True:
        # A rank is the first slot of a group of suffixes that are equal so far.
        new = np.ones(len(slots) + 1, dtype=bool)
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        first = np.flatnonzero(new[:-1])
        rank[sub] = np.repeat(slots[first], np.diff(np.append(first, len(slots))))
        slots = slots[~(new[:-1] & new[1:])]
        if not len(slots):
            return order
        sub = order[slots]
        beyond = sub + depth
        second = np.where(beyond < end[sub], rank[np.minimum(beyond, n - 1)] + n, string[sub])
        key = rank[sub] * (2 * n) + second
        by = np.argsort(key)
        key, sub = key[by], sub[by]
        order[slots] = sub
        depth *= 2


def common_prefix(data: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b, each within its string; eight bytes a step."""
    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = data
    eight = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        eight |= padded[k : n + k].astype(np.uint64) << np.uint64(8 * k)
    limit = np.minimum(end[a] - a, end[b] - b)
    length = np.zeros(len(a), dtype=np.int64)
    active = np.flatnonzero(limit > 0)
    a, b = a[active], b[active]
    step = 0
    while len(active):
        differ = eight[a] ^ eight[b]
        other = np.flatnonzero(differ)
        # The lowest set bit lies in the first byte that differs.
        lowest = differ[other] & (~differ[other] + np.uint64(1))
        length[active[other]] = step + (np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3)
        step += 8
        same = differ == 0
        on = same & (limit[active] > step)
        length[active[same & ~on]] = step
        active, a, b = active[on], a[on] + 8, b[on] + 8
    return np.minimum(length, limit)


def matching_statistics(strings: list[bytes]) -> np.ndarray:
    """For every byte of the strings, joined: the longest match that starts there and anywhere else.

    Bytes are compared at the ends of runs of the transform only.
    """
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    end = np.repeat(ends, sizes)
    string = np.repeat(np.arange(len(strings)), sizes)
    order = suffix_order(data, string, end)
    # The transform: the byte before each suffix; a string's begin is a byte of its own.
    begins = np.zeros(len(data), dtype=bool)
    begins[ends - sizes] = True
    before = np.where(begins[order], 256 + string[order], data[order - 1].astype(np.int64))
    change = np.ones(len(order) + 1, dtype=bool)
    change[1:-1] = before[1:] != before[:-1]
    run_end = change[:-1] | change[1:]
    # Neighbours in order of which one is a run's end, each pair compared once.
    upper = np.flatnonzero(run_end[1:] | run_end[:-1])
    shared = common_prefix(data, end, order[upper], order[upper + 1])
    found = np.zeros(len(data), dtype=np.int64)
    found[order[upper]] = shared
    found[order[upper + 1]] = np.maximum(found[order[upper + 1]], shared)
    # Streaming: a match of m at one position is a match of m - 1 at the next, within the string.
    at = np.arange(len(data))
    reach = np.maximum.accumulate(found + at)
    return np.maximum(np.minimum(reach, end) - at, 0)


def marked_starts(length: int):
    """applyInArrow over the strings of a gathering: (row, lo, hi) of repeated windows of its edges."""

    def run(table: pa.Table) -> pa.Table:
        strings = table.column("string").to_pylist()
        row, lo = table.column("row").to_numpy(), table.column("lo").to_numpy()
        edge = table.column("kind").to_numpy() == EDGE
        stats = matching_statistics(strings)
        cut = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        out = [], [], []
        for i in np.flatnonzero(edge):
            hits = stats[cut[i] : cut[i + 1]] >= length
            if hits.any():
                for a, b in intervals(hits):
                    out[0].append(row[i])
                    out[1].append(lo[i] + a)
                    out[2].append(lo[i] + b)
        return pa.table(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())],
            names=["row", "lo", "hi"],
        )

    return run


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values, ends included."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


# --- strings and windows --------------------------------------------------------------------

STRINGS = "row long, lo int, kind int, hot boolean, anchor long, string binary"


def cut_strings(length: int):
    """mapInArrow: touched documents to the strings of their edges and references."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            for own, text, marks in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                data = (text or "").encode()
                for m in marks:
                    if m["kind"] != COVERED:
                        row = (own, m["lo"], m["kind"], m["hot"], m["anchor"], data[m["lo"] : m["hi"] + length])
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["row", "lo", "kind", "hot", "anchor", "string"],
            )

    return run


PACKED = "bucket long, entries binary"
_ENTRY = np.dtype([("window", "<i8"), ("row", "<i8"), ("lo", "<i4"), ("state", "<i4")])
# States of an entry: a window to judge, one that only counts, one that is there twice, one already judged.
ASKED, SEEN, TWICE, FOUND = 0, 1, 2, 3


def send_windows(length: int, buckets: int):
    """mapInArrow: strings to the hashes of their windows, packed by bucket of the hash.

    A window found twice in the batch is judged at once, and sent on once for the other
    batches; what is judged already goes to a bucket of its text.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            strings = batch.column(5).to_pylist()
            sizes = np.array([len(s) for s in strings], dtype=np.int64)
            data = np.frombuffer(b"".join(strings), dtype=np.uint8)
            counts = sizes - length + 1
            owner = np.repeat(np.arange(len(sizes)), counts)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = np.repeat(np.cumsum(sizes) - sizes, counts) + inside
            window = Sums(data).hashes(start, start + length)
            times, first = counts_of(window)
            edge = (batch.column(2).to_numpy() == EDGE)[owner]
            found = np.flatnonzero(edge & (times > 1))
            at = np.concatenate([found, np.flatnonzero(first)])
            entries = np.zeros(len(at), dtype=_ENTRY)
            entries["window"] = window[at].view(np.int64)
            entries["row"] = batch.column(0).to_numpy()[owner[at]]
            entries["lo"] = batch.column(1).to_numpy()[owner[at]] + inside[at]
            state = np.where(times > 1, TWICE, np.where(edge, ASKED, SEEN))[at]
            state[: len(found)] = FOUND
            entries["state"] = state
            bucket = (window[at] % np.uint64(buckets)).astype(np.int64)
            bucket[: len(found)] = entries["row"][: len(found)] % buckets
            order = np.argsort(bucket)
            bucket, entries = bucket[order], entries[order]
            own, cut = np.unique(bucket, return_index=True)
            parts = [p.tobytes() for p in np.split(entries, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array(parts, pa.binary())], names=["bucket", "entries"]
            )

    return run


def repeated_windows(table: pa.Table) -> pa.Table:
    """applyInArrow over PACKED of a bucket: (row, lo, hi) of windows that are there twice."""
    entries = np.frombuffer(b"".join(table.column("entries").to_pylist()), dtype=_ENTRY)
    open_ones = entries[entries["state"] != FOUND]
    _, at, counts = np.unique(open_ones["window"], return_inverse=True, return_counts=True)
    twice = (counts > 1) | (np.bincount(at, open_ones["state"] == TWICE, len(counts)) > 0)
    hit = open_ones[(open_ones["state"] == ASKED) & twice[at]] if len(open_ones) else open_ones
    found = np.concatenate([entries[entries["state"] == FOUND], hit])
    # Neighbouring starts of a text become one interval.
    found = np.unique(found[["row", "lo"]])
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found["row"][1:] != found["row"][:-1]) | (found["lo"][1:] != found["lo"][:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(found)) - 1 if len(found) else first
    return pa.table(
        [pa.array(found["row"][first]), pa.array(found["lo"][first]), pa.array(found["lo"][last])],
        names=["row", "lo", "hi"],
    )


def cut_texts(length: int):
    """mapInArrow: (row, text, starts) to what is removed and the hash of what stays."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests = [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                kept, at, gone, runs = [], 0, 0, 0
                for lo, hi in sorted((s["lo"], s["hi"]) for s in starts):
                    end = hi + length
                    if lo > at or not runs:
                        kept.append(data[at:lo])
                        runs += 1
                        gone += end - lo
                    else:
                        gone += max(0, end - at)
                    at = max(at, end)
                kept.append(data[at:])
                removed.append(gone)
                spans.append(runs)
                digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                names=["row", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def repeated_starts(texts: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(touched texts by row, (row, lo, hi) of all starts of repeated windows)."""
    sent = held(texts.mapInArrow(send_runs(length, gram), SENT), "anchored-runs")
    known = sent.filter(F.col("anchor").isNull())
    asked = sent.filter(F.col("anchor").isNotNull())
    total = asked.count()
    # Anchors with more than 1/HEAVY of all runs: fewer than HEAVY. Their rows are dealt by run.
    hot = (
        asked.filter("often > 2")
        .groupBy(F.col("anchor").alias("_hot"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") * HEAVY > total)
        .select("_hot")
    )
    keyed = asked.join(F.broadcast(hot), F.col("anchor") == F.col("_hot"), "left").select(
        F.when(F.col("_hot").isNotNull(), F.col("run")).otherwise(F.col("anchor")).alias("key"),
        "anchor",
        "run",
        "row",
        "lo",
        "hi",
        "twice",
        F.col("_hot").isNotNull().alias("hot"),
    )
    settled = keyed.repartition("key").sortWithinPartitions("key", "run").mapInArrow(settle, MARKS)
    marks = held(
        settled.unionByName(
            known.select(
                "row", "lo", "hi", F.lit(0).cast("long").alias("anchor"),
                F.lit(COVERED).alias("kind"), F.lit(False).alias("hot"),
            )
        ),
        "repeat-marks",
    )
    per_doc = marks.groupBy(F.col("row").alias("_id")).agg(
        F.collect_list(F.struct("lo", "hi", "anchor", "kind", "hot")).alias("marks")
    )
    touched = held(
        texts.join(per_doc, F.col("row") == F.col("_id")).select("row", "text", "marks"), "touched", "zstd"
    )
    windows_of = F.col("hi") - F.col("lo") + 1
    open_marks = marks.filter(F.col("kind") != COVERED)
    size = open_marks.agg(
        F.coalesce(F.sum(F.when(~F.col("hot"), windows_of + length)), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(F.col("hot"), windows_of)), F.lit(0)).alias("windows"),
    ).first()
    strings = touched.mapInArrow(cut_strings(length), STRINGS)
    gatherings, buckets = int(size.bytes // GATHERED + 1), int(size.windows // BUCKET + 1)
    result = "row long, lo int, hi int"
    cold = (
        strings.filter(~F.col("hot"))
        .groupBy(F.pmod("anchor", F.lit(gatherings)).alias("gathering"))
        .applyInArrow(marked_starts(length), result)
    )
    split = (
        strings.filter("hot")
        .mapInArrow(send_windows(length, buckets), PACKED)
        .groupBy("bucket")
        .applyInArrow(repeated_windows, result)
    )
    covered = marks.filter(F.col("kind") == COVERED).select("row", "lo", "hi")
    return touched, covered.unionByName(cold).unionByName(split)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is every byte covered by a string of ``length`` bytes that also starts elsewhere, in the
    same text or another, overlaps included. Null counts as empty. Rows are told apart by a stored
    number of their own, so rows that repeat an id or have none are judged like any other. Strings
    are compared by 64-bit hashes and by bytes in the indexes. An empty table gives no rows.
    """
    texts = numbered(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "repeat-texts", "row", "zstd"
    )
    touched, starts = repeated_starts(texts.select("row", "text"), length, gram)
    per_doc = starts.groupBy(F.col("row").alias("_id")).agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    cut = (
        touched.join(per_doc, F.col("row") == F.col("_id"))
        .select("row", "text", "starts")
        .mapInArrow(cut_texts(length), "row long, n_removed long, n_spans long, kept_sha256 string")
        .withColumnRenamed("row", "_id")
    )
    whole = F.coalesce("text", F.lit(""))
    base = texts.select(
        "row", "doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("whole_sha256")
    )
    return base.join(cut, F.col("row") == F.col("_id"), "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )
