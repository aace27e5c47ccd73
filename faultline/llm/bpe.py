"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is in the vocabulary as a whole is found by a minimal perfect hash: one
displacement per bucket sends every vocabulary entry to a slot of its own, and the slot's bytes
are compared. All others are merged from bytes that are linked to their neighbours, the next
merge being taken from a heap, so a pre-token of n bytes costs n log n however long it is.

Texts are cut at single spaces between other characters, where a pre-token begins in any
case; a piece that was met before in the task is not looked up again. What is
remembered is bounded.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.vocab import read_ranks
from faultline.llm.words import Sums, lean, mix

# Pieces and merged pre-tokens remembered per worker, and the longest that is.
REMEMBERED, LONGEST = 1_000_000, 48
# White space as the pre-token pattern means it.
WHITE = "\\p{White_Space}"

_APART = re.compile(r"\s | \s|^\s|\s$")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class PerfectHash:
    """A minimal perfect hash of byte strings: as many slots as keys, one look each."""

    LOAD = 3  # keys per bucket
    DIRECT = 1 << 62  # marks a displacement that names a slot itself

    def __init__(self, keys: list[bytes]):
        if len(set(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        self.size = len(keys)
        self.buckets = max(1, self.size // self.LOAD)
        self.shift = np.zeros(self.buckets, dtype=np.uint64)
        hashes = self.hashes(keys)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        counts = np.diff(cut)
        taken = np.zeros(self.size, dtype=bool)
        self.order = np.zeros(self.size, dtype=np.int64)  # slot to key
        free = None
        for b in np.argsort(-counts, kind="stable"):
            members = order[cut[b] : cut[b + 1]]
            if not len(members):
                break
            if len(members) == 1:
                if free is None:
                    free = iter(np.flatnonzero(~taken).tolist())
                slot = next(free)
                self.shift[b] = np.uint64(self.DIRECT + slot)
                self.order[slot] = members[0]
                continue
            start = 0
            while True:
                tries = np.arange(start, start + 64, dtype=np.uint64)
                slots = self._slots(hashes[members][None, :], tries[:, None])
                fine = ~taken[slots].any(axis=1)
                ordered = np.sort(slots, axis=1)
                fine &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if fine.any():
                    at = int(fine.argmax())
                    self.shift[b] = tries[at]
                    taken[slots[at]] = True
                    self.order[slots[at]] = members
                    break
                start += 64

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
        data = np.frombuffer(b"".join(keys), dtype=np.uint8)
        return Sums(data).hashes(np.concatenate([[0], ends[:-1]]), ends)

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        spread = mix(hashes + shift * np.uint64(0x9E3779B97F4A7C15))
        return (spread % np.uint64(self.size)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The only key number that each string could have; the caller compares."""
        hashes = self.hashes(keys)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        direct = shift >= np.uint64(self.DIRECT)
        slots = self._slots(hashes, shift)
        slots[direct] = (shift[direct] - np.uint64(self.DIRECT)).astype(np.int64)
        return self.order[slots]


def merge_rows(ranks: dict[bytes, int]) -> list[dict[int, int]]:
    """By left token id: right token ids whose bytes appended make a token, and that token's id."""
    rows: list[dict[int, int]] = [{} for _ in range(max(ranks.values()) + 1)]
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                rows[left][right] = rank
    return rows


def merge_linked(ids: list[int], heap: list[int], rows: list[dict[int, int]]) -> list[int]:
    """Merge linked bytes: the lowest rank first, the leftmost of equals.

    ``ids`` has a token id per byte, ``heap`` the first merges as (merged id << 32 | position);
    a rank is the id of the merged token. Positions whose token went into its left neighbour are -1.
    """
    n = len(ids)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heapify(heap)
    while heap:
        entry = heappop(heap)
        at = entry & 0xFFFFFFFF
        left = ids[at]
        if left < 0:
            continue
        right_at = after[at]
        merged = entry >> 32
        if right_at >= n or rows[left].get(ids[right_at]) != merged:
            continue
        ids[at] = merged
        ids[right_at] = -1
        right_at = after[right_at]
        after[at] = right_at
        if right_at < n:
            before[right_at] = at
            new = rows[merged].get(ids[right_at])
            if new is not None:
                heappush(heap, new << 32 | at)
        left_at = before[at]
        if left_at >= 0:
            new = rows[ids[left_at]].get(merged)
            if new is not None:
                heappush(heap, new << 32 | left_at)
    return [i for i in ids if i >= 0]


class Coder:
    """Encodes and decodes by one vocabulary; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, perfect: PerfectHash):
        import regex

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are packed as little-endian 32-bit integers")
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.packed = [ranks[t].to_bytes(4, "little") for t in self.tokens]
        self.perfect = perfect
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.rows = merge_rows(ranks)
        # The merge of every pair of bytes; -1 if they make no token.
        self.pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], dtype=np.int64)
        self.bytes_of = {i: t for t, i in ranks.items()}
        inside = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", WHITE).replace(r"\S", WHITE.replace("p", "P"))
        self.split = regex.compile(inside).findall
        self.pieces: dict[str, bytes] = {}
        self.merged: dict[bytes, bytes] = {}

    def merge(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of byte strings by merging; the bytes and first pairs of all are looked up at once."""
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        ids = self.single[data].tolist()
        pair = self.pairs[(data[:-1].astype(np.int64) << 8) + data[1:]]
        position = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
        pair[ends[:-1] - 1] = -1
        at = np.flatnonzero(pair >= 0)
        entries = ((pair[at] << 32) + position[at]).tolist()
        cuts = np.searchsorted(at, ends).tolist()
        out, start, first = [], 0, 0
        for end, cut in zip(ends.tolist(), cuts, strict=True):
            out.append(array("I", merge_linked(ids[start:end], entries[first:cut], self.rows)).tobytes())
            start, first = end, cut
        return out

    def encode_tokens(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of distinct pre-tokens: the perfect hash first, the heap for those it does not hold."""
        if not tokens:
            return []
        merged, names = self.merged, self.tokens
        found = [
            self.packed[at] if names[at] == token else merged.get(token)
            for token, at in zip(tokens, self.perfect.find(tokens).tolist(), strict=True)
        ]
        missing = [i for i, packed in enumerate(found) if packed is None]
        if missing:
            for i, packed in zip(missing, self.merge([tokens[i] for i in missing]), strict=True):
                found[i] = packed
                if len(tokens[i]) <= LONGEST:
                    merged[tokens[i]] = packed
        return found

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of text, each split into pre-tokens by itself."""
        split = [self.split(p) for p in pieces]
        number: dict[str, int] = {}
        for tokens in split:
            for token in tokens:
                number.setdefault(token, len(number))
        packed = self.encode_tokens([t.encode() for t in number])
        return [b"".join([packed[number[t]] for t in tokens]) for tokens in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        if len(self.pieces) > REMEMBERED // 2:
            self.pieces.clear()
        if len(self.merged) > REMEMBERED:
            self.merged.clear()
        known = self.pieces
        parts = []
        fresh: dict[str, None] = {}
        for text in texts:
            cut = _BETWEEN.split(text) if _APART.search(text) else text.split(" ")
            # Every piece but a text's first has a space before it.
            parts.append(cut)
            for piece in cut[1:]:
                if piece not in known:
                    fresh[piece] = None
        if fresh:
            known.update(zip(fresh, self.encode_pieces([" " + p for p in fresh]), strict=True))
        first = self.encode_pieces([cut[0] for cut in parts])
        out = [
            b"".join([begin, *[known[p] for p in cut[1:]]]) for begin, cut in zip(first, parts, strict=True)
        ]
        for piece in [p for p in fresh if len(p) > LONGEST]:
            del known[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def perfect_hash(rank_file: str) -> PerfectHash:
    ranks = read_ranks(rank_file)
    return PerfectHash(sorted(ranks, key=ranks.__getitem__))


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(rank_file: str, pattern: str, perfect: PerfectHash) -> Coder:
    """The coder of this worker process; what it remembers serves the tasks after this one."""
    key = rank_file, pattern
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(read_ranks(rank_file), pattern, perfect)
    return _CODERS[key]


# Texts coded at once: a bound on memory beside the batch itself.
AT_ONCE = 2 << 20


def in_runs(texts: list[str], limit: int = AT_ONCE) -> Iterator[list[str]]:
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def round_trip(rank_file: str, pattern: str, perfect: PerfectHash):
    """mapInArrow: (doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(rank_file, pattern, perfect)
        for batch in batches:
            counts, ids_digests, decoded_digests = [], [], []
            for texts in in_runs([t or "" for t in batch.column(1).to_pylist()]):
                for ids in own.encode(texts):
                    counts.append(len(ids) // 4)
                    ids_digests.append(hashlib.sha256(ids).hexdigest())
                    decoded_digests.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(ids_digests, pa.string()),
                    pa.array(decoded_digests, pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_column(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of whole texts as arrays of integers; null counts as empty."""
    perfect = perfect_hash(rank_file)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(rank_file, pattern, perfect)
        for batch in batches:
            packed = [i for texts in in_runs([t or "" for t in batch.column(1).to_pylist()]) for i in own.encode(texts)]
            ids = [np.frombuffer(p, dtype="<u4").astype(np.int32) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, decoded): the bytes of (doc_id, ids); null ids count as none. Unknown ids raise."""
    perfect = perfect_hash(rank_file)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(rank_file, pattern, perfect)
        for batch in batches:
            texts = [own.decode(np.array(i or [], dtype="<u4").tobytes()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "decoded"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def check_round_trip(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 of the whole text.

    The text is encoded and the ids decoded again. Null and empty texts have no tokens.
    Repeated rows each get theirs; an empty table gives no rows; further columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(
        round_trip(rank_file, pattern, perfect_hash(rank_file)),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
