"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from whole texts in a few numpy passes per batch. The trees are fitted on a
bounded sample of labelled rows, by histograms, with a monotonic direction for features whose
effect is known, and flattened into arrays of nodes that score a whole batch level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.skew import held
from faultline.llm.toxicity import held_out
from faultline.llm.words import Sums, TextSlice, find_words, grams, lean, mix, text_slices

# Fixed: what counts as a symbol, the words of a window, and the base rule's limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20

# The trees are fitted on at most so many labelled rows, those of the smallest id hashes.
SAMPLE_ROWS = 40_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 80, 3, 0.15, 48, 20
KEEP = 0.5

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_upper", "n_lower", "n_digits", "n_ends", "n_capitals",
)
# Features, and the direction in which each may move the verdict (0: either).
FEATURES = (
    ("log_words", 0),
    ("word_length", 0),
    ("symbols_per_word", -1),
    ("dup_line_share", -1),
    ("repeat_share", -1),
    ("words_per_line", 0),
    ("distinct_share", 0),
    ("upper_share", -1),
    ("digit_share", 0),
    ("ends_per_word", 0),
    ("capital_share", 0),
    ("log_chars", 0),
)


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _END = _flags(SYMBOLS), _flags(".!?")
_UPPER, _LOWER, _DIGIT = (np.arange(256) >= a for a in (65, 97, 48))
_UPPER, _LOWER, _DIGIT = (
    m & (np.arange(256) <= z) for m, z in ((_UPPER, 90), (_LOWER, 122), (_DIGIT, 57))
)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each row has."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key is there twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Whether each key was there before."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] = keys[order][1:] == keys[order][:-1]
    return out


def statistics(part: TextSlice) -> np.ndarray:
    """COUNTS of every text of a slice, as int64 of shape (rows, counts).

    Windows, lines and words are compared by 64-bit hashes within their own text.
    """
    rows = len(part.offsets) - 1
    data, words = part.data, find_words(part)
    sums = Sums(data)
    own = mix(np.arange(1, rows + 1, dtype=np.uint64))
    hashes = sums.hashes(words.starts, words.ends)

    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    word_points = points[words.ends] - points[words.starts]
    word_chars = np.zeros(rows, dtype=np.int64)
    np.add.at(word_chars, words.rows, word_points)

    windows = grams(hashes, WINDOW)
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    if len(windows):
        inside = words.rows[: len(windows)] == words.rows[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        twice = at[repeated(windows[at] ^ own[words.rows[at]])]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    repeat = per_row(np.cumsum(covered)[:-1] > 0, words.bounds)

    # Lines: between line feeds and the ends of texts; only those with a word count.
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([part.offsets[:-1], feeds + 1]))
    line_rows = np.concatenate([np.arange(rows), np.searchsorted(part.offsets, feeds, side="right") - 1])
    order = np.argsort(np.concatenate([part.offsets[:-1], feeds + 1]), kind="stable")
    line_rows = line_rows[order]
    ends = np.append(starts[1:], len(data))
    last = np.append(line_rows[1:] != line_rows[:-1], True)
    ends = np.where(last, part.offsets[line_rows + 1], ends - 1)
    # A line's first word begins at or after its start and before its end.
    first_word = np.searchsorted(words.starts, starts)
    worded = first_word < len(words.starts)
    worded[worded] = words.starts[first_word[worded]] < ends[worded]
    line_rows, starts, ends = line_rows[worded], starts[worded], ends[worded]
    line_keys = sums.hashes(starts, ends) ^ own[line_rows]
    dup = np.bincount(line_rows[later(line_keys)], minlength=rows)

    distinct = np.bincount(words.rows[~later(hashes ^ own[words.rows])], minlength=rows)
    capital = _UPPER[data[words.starts]] if len(words.starts) else np.zeros(0, bool)
    return np.column_stack(
        [
            np.diff(words.bounds),
            word_chars,
            per_row(_SYMBOL[data], part.offsets),
            dup,
            repeat,
            np.bincount(line_rows, minlength=rows),
            distinct,
            per_row(_UPPER[data], part.offsets),
            per_row(_LOWER[data], part.offsets),
            per_row(_DIGIT[data], part.offsets),
            per_row(_END[data], part.offsets),
            per_row(capital, words.bounds),
        ]
    ).astype(np.int64)


@lean
def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_id, text) to doc_id and COUNTS."""
    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        for part in text_slices(batch.column(1)):
            found = statistics(part)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(part.first, len(found)), *[pa.array(c) for c in found.T]], names=["doc_id", *COUNTS]
            )


MEASURED = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def features(counts: np.ndarray) -> np.ndarray:
    """FEATURES from COUNTS."""
    (words, chars, symbols, dup, repeat, lines, distinct, upper, lower, digits, ends, capitals) = (
        counts.T.astype(float)
    )
    some = np.maximum(words, 1)
    letters = np.maximum(upper + lower, 1)
    return np.column_stack(
        [
            np.log1p(words),
            chars / some,
            symbols / some,
            dup / np.maximum(lines, 1),
            repeat / some,
            words / np.maximum(lines, 1),
            distinct / some,
            upper / letters,
            digits / np.maximum(chars, 1),
            ends / some,
            capitals / some,
            np.log1p(chars),
        ]
    )


@dataclass
class Trees:
    """Complete trees as flat arrays: node i has its children at 2i + 1 and 2i + 2."""

    start: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); greater goes right
    value: np.ndarray  # (trees, leaves)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def best_split(codes, slope, bend, edges, low, high, directions):
    """(gain, feature, bin) of the best split of a node that keeps the directions; None if none gains."""
    total_s, total_b = slope.sum(), bend.sum()
    best = None
    for f, direction in enumerate(directions):
        if not len(edges[f]):
            continue
        n = len(edges[f]) + 1
        s = np.bincount(codes[:, f], slope, n).cumsum()[:-1]
        b = np.bincount(codes[:, f], bend, n).cumsum()[:-1]
        c = np.bincount(codes[:, f], minlength=n).cumsum()[:-1]
        left, right = -s / (b + 1), -(total_s - s) / (total_b - b + 1)
        left, right = np.clip(left, low, high), np.clip(right, low, high)
        gain = s**2 / (b + 1) + (total_s - s) ** 2 / (total_b - b + 1) - total_s**2 / (total_b + 1)
        fine = (c >= LEAST_ROWS) & (len(codes) - c >= LEAST_ROWS)
        if direction:
            fine &= (right - left) * direction >= 0
        gain = np.where(fine, gain, -1)
        at = int(gain.argmax())
        if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
            best = (float(gain[at]), f, at, float(left[at]), float(right[at]))
    return best


def fit_trees(x: np.ndarray, y: np.ndarray, directions=tuple(d for _, d in FEATURES)) -> Trees:
    """Boosted trees for the log loss. A direction holds for the whole tree: bounds pass down from each split."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    inner = (1 << DEPTH) - 1
    all_features, all_thresholds, all_values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = p - y, p * (1 - p)
        feature = np.zeros(inner, dtype=np.int64)
        threshold = np.full(inner, np.inf)
        bounds = {0: (-np.inf, np.inf)}
        node = np.zeros(len(y), dtype=np.int64)
        for at in range(inner):
            low, high = bounds[at]
            here = np.flatnonzero(node == at)
            split = None
            if len(here) >= 2 * LEAST_ROWS:
                split = best_split(codes[here], slope[here], bend[here], edges, low, high, directions)
            bounds[2 * at + 1] = bounds[2 * at + 2] = (low, high)
            right = np.zeros(len(here), dtype=bool)
            if split:
                _, f, bin_at, left_value, right_value = split
                feature[at], threshold[at] = f, edges[f][bin_at]
                right = codes[here, f] > bin_at
                if directions[f]:
                    middle = (left_value + right_value) / 2
                    pair = (low, middle), (middle, high)
                    bounds[2 * at + 1], bounds[2 * at + 2] = pair if directions[f] > 0 else (
                        (middle, high), (low, middle)
                    )
            node[here] = 2 * at + 1 + right
        leaf = node - inner
        s = np.bincount(leaf, slope, inner + 1)
        b = np.bincount(leaf, bend, inner + 1)
        limits = np.array([bounds[inner + k] for k in range(inner + 1)])
        value = RATE * np.clip(-s / (b + 1), limits[:, 0], limits[:, 1])
        margin += value[leaf]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_values.append(value)
    return Trees(start, np.array(all_features), np.array(all_thresholds), np.array(all_values))


def fit(measured: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees | None:
    """Trees from at most ``rows`` labelled documents; None if the labels show only one class.

    Rows with a remainder of 2 (see ``held_out``) are left out, for tests of accuracy.
    """
    picked = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    sample = measured.join(F.broadcast(picked), "doc_id").toPandas().sort_values(["doc_id", *COUNTS], kind="stable")
    good = (sample["quality"].to_numpy() > 0).astype(float) if len(sample) else np.zeros(0)
    if not len(good) or good.min() == good.max():
        return None
    return fit_trees(features(sample[list(COUNTS)].to_numpy()), good)


def judge_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, score; whole texts.

    A null or empty text has no words, so it fails the base rule. With labels of one class
    or none, the base rule alone decides. Repeated rows each get theirs; extra columns
    are not looked at.
    """
    measured = held(docs.select("doc_id", "text").mapInArrow(measure, MEASURED), "statistics")
    trees = fit(measured, labels, rows)

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS])
            found = trees.probability(features(counts)) if trees is not None and len(counts) else np.ones(len(counts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"]
            )

    scored = measured.mapInArrow(score, MEASURED + ", score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.select(
        "doc_id",
        *COUNTS[:5],
        failed.alias("base_failed"),
        (~failed & (F.col("score") >= keep)).alias("kept"),
        "score",
    )
