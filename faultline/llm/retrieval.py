"""Packing by lexical retrieval: windows are filled with a document's nearest neighbours by BM25.

Pieces of documents are ordered by their rarest shared tokens and dealt out in that order, so related
ones stand together and a hot token is cut like any other. A task reads its share as a
stream of shards of bounded size. Each shard gets an inverted index: postings by token, weighted
with the document frequencies of the whole table. A seed asks the index with its weightiest tokens
and takes the unused neighbours in order of score until its window is full; what is cut
off is the next seed. The last tokens of a task go to windows whose lengths are powers of two, so
nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.skew import held
from faultline.llm.words import few_rows, lean

SIZE = 4096
END_ID = 2
# Ids of the vocabulary; they are kept in 16 bits.
VOCABULARY = 49_408
# Tokens of an index shard, tokens a seed asks with, and the usual constants of BM25.
SHARD_TOKENS, ASKED = 1 << 20, 32
K1, B = 1.2, 0.75

ENCODED = "_row long, doc_id long, doc_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def tokens_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2")


def encode_texts(encoder):
    """mapInArrow from (_row, doc_id, text) to ENCODED; the end id is the last of every document.

    The last row of a task, numbered -1, holds for each token how many of the task's documents have it.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        documents, last = np.zeros(VOCABULARY, dtype="<i8"), np.zeros(VOCABULARY, dtype=np.int64)
        for batch in few_rows(batches):
            ids = [encode(t.as_py() or "") + END_ID.to_bytes(2, "little") for t in batch.column(2)]
            for data in ids:
                tokens = tokens_of(data)
                at = np.arange(len(tokens))
                last[tokens] = at
                documents[tokens[last[tokens] == at]] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(i) // 2 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["_row", "doc_id", "doc_tokens", "ids"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([documents.tobytes()])],
            names=["_row", "doc_id", "doc_tokens", "ids"],
        )

    return run


@lean
def token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (ids) of rows -1: (token, documents)."""
    found = np.zeros(VOCABULARY, dtype=np.int64)
    for batch in batches:
        for data in batch.column(0):
            found += np.frombuffer(data.as_buffer(), dtype="<i8")
    there = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(found[there])], names=["token", "documents"])


@dataclass
class Statistics:
    """Counts over all documents: how rare each token is, and the mean length."""

    idf: np.ndarray
    shared: np.ndarray
    mean_tokens: float


def statistics(encoded: DataFrame) -> Statistics:
    """At most one row per token of the vocabulary comes to the driver."""
    counted = encoded.filter("_row < 0").select("ids").mapInArrow(token_counts, "token long, documents long")
    rows = counted.groupBy("token").agg(F.sum("documents").alias("documents")).collect()
    total = encoded.agg(F.count("doc_tokens").alias("n"), F.sum("doc_tokens").alias("tokens")).first()
    documents = np.zeros(VOCABULARY)
    for r in rows:
        documents[r.token] = r.documents
    idf = np.log1p((total.n - documents + 0.5) / (documents + 0.5)).astype(np.float32)
    return Statistics(idf, documents > 1, (total.tokens or 0) / max(total.n, 1))


def order_keys(stats: Statistics):
    """mapInArrow: ENCODED with the two rarest tokens that another document has, as one number."""
    rarity = np.where(stats.shared, stats.idf, np.float32(0))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, dtype=np.int64)
            for i, data in enumerate(batch.column(3)):
                tokens = tokens_of(data.as_buffer())
                rare = rarity[tokens]
                first = int(tokens[rare.argmax()])
                rare[tokens == first] = -1
                keys[i] = first << 16 | int(tokens[rare.argmax()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys)], names=["_row", "doc_id", "doc_tokens", "ids", "_key"]
            )

    return run


@dataclass
class Piece:
    """What is left of a document: its tokens from ``start`` on."""

    doc_id: int | None
    doc_tokens: int
    start: int
    tokens: np.ndarray


class Index:
    """Inverted index of a shard: postings by token, each with its BM25 weight."""

    def __init__(self, pieces: list[Piece], stats: Statistics):
        self.stats, self.n = stats, len(pieces)
        sizes = np.array([len(p.tokens) for p in pieces])
        owner = np.repeat(np.arange(self.n, dtype=np.int64), sizes)
        codes, times = np.unique(owner << 16 | np.concatenate([p.tokens for p in pieces]), return_counts=True)
        self.owner, self.token = codes >> 16, (codes & 0xFFFF).astype(np.int64)
        self.begins = np.searchsorted(self.owner, np.arange(self.n + 1))
        scale = K1 * (1 - B + B * sizes / max(stats.mean_tokens, 1e-9))
        weight = stats.idf[self.token] * times * (K1 + 1) / (times + scale[self.owner])
        order = np.argsort(self.token, kind="stable")
        self.postings, self.weights = self.owner[order], weight[order].astype(np.float32)
        self.lists = np.searchsorted(self.token[order], np.arange(VOCABULARY + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused pieces that share a weighty token with the seed, best first."""
        tokens = self.token[self.begins[seed] : self.begins[seed + 1]]
        if len(tokens) > ASKED:
            tokens = tokens[np.argpartition(-self.stats.idf[tokens], ASKED)[:ASKED]]
        scores = np.zeros(self.n, dtype=np.float32)
        for t in np.sort(tokens):
            a, b = self.lists[t], self.lists[t + 1]
            scores[self.postings[a:b]] += self.weights[a:b]
        scores[~unused] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


class Windows:
    """Numbered windows of a task, and the pieces placed in them."""

    def __init__(self, first: int):
        self.sequence, self.offset = first, 0
        self.rows: tuple[list, ...] = ([], [], [], [], [], [], [])

    def place(self, piece: Piece, n: int) -> None:
        """The next ``n`` tokens of a piece go to the open window."""
        ids = piece.tokens[:n].astype("<u4").tobytes()
        row = (piece.doc_id, piece.start, n, zlib.crc32(ids), piece.doc_tokens, self.sequence, self.offset)
        for column, value in zip(self.rows, row, strict=True):
            column.append(value)
        piece.start, piece.tokens = piece.start + n, piece.tokens[n:]
        self.offset += n

    def close(self) -> None:
        self.sequence, self.offset = self.sequence + 1, 0

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in self.rows], names=[f.split()[0] for f in PIECES.split(", ")]
        )
        self.rows = tuple([] for _ in self.rows)
        return out


def fill(pieces: list[Piece], stats: Statistics, windows: Windows, size: int = SIZE) -> list[Piece]:
    """Fill windows while tokens last; what doesn't fill one is returned, in the order it would stand in."""
    if not pieces:
        return []
    index = Index(pieces, stats)
    unused = np.ones(len(pieces), dtype=bool)
    left = sum(len(p.tokens) for p in pieces)
    seed = at = 0
    while left >= size:
        if not unused[seed]:
            while not unused[at]:
                at += 1
            seed = at
        gap, first = size, seed
        candidates, asked, beside = [first], False, at
        while gap:
            if not candidates:
                if not asked:
                    candidates, asked = index.neighbours(first, unused).tolist()[::-1], True
                    continue
                # Nothing in common with what is left: the next ones in order.
                while not unused[beside]:
                    beside += 1
                candidates = [beside]
            i = candidates.pop()
            piece = pieces[i]
            n = min(gap, len(piece.tokens))
            windows.place(piece, n)
            gap -= n
            unused[i] = len(piece.tokens) > 0
            seed = i
        windows.close()
        left -= size
    return [p for i, p in enumerate(pieces) if unused[i] and len(p.tokens)]


def finish(pieces: list[Piece], windows: Windows) -> None:
    """The last tokens, fewer than a window: windows as long as the powers of two in their number."""
    left, rest = sum(len(p.tokens) for p in pieces), list(pieces)
    while left:
        gap = 1 << (left.bit_length() - 1)
        left -= gap
        while gap:
            n = min(gap, len(rest[0].tokens))
            windows.place(rest[0], n)
            gap -= n
            if not len(rest[0].tokens):
                rest.pop(0)
        windows.close()


def pack_shards(stats: Statistics, size: int, shard_tokens: int):
    """mapInArrow over ENCODED, in order of the keys: PIECES.

    Whole windows of a long document are cut off first; only the rest of it is indexed.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(TaskContext.get().partitionId() << 33)
        shard: list[Piece] = []
        tokens = 0
        for batch in few_rows(batches):
            for doc_id, n, data in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                piece = Piece(doc_id.as_py(), n.as_py(), 0, tokens_of(data.as_py()))
                while len(piece.tokens) >= size:
                    windows.place(piece, size)
                    windows.close()
                if len(piece.tokens):
                    shard.append(Piece(piece.doc_id, piece.doc_tokens, piece.start, piece.tokens.copy()))
                    tokens += len(piece.tokens)
                if tokens >= shard_tokens:
                    shard = fill(shard, stats, windows, size)
                    tokens = sum(len(p.tokens) for p in shard)
            yield windows.batch()
        finish(fill(shard, stats, windows, size), windows)
        yield windows.batch()

    return run


def pack_by_retrieval(
    docs: DataFrame,
    encoder,
    size: int = SIZE,
    shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """PIECES of all documents in windows of ``size`` tokens, a power of two.

    A null or empty text is its end id alone. Rows are told apart by a number of their own, so
    missing and repeated ids are packed like any other. Every token lies in one piece. An
    empty table gives no rows.
    """
    numbered = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
    )
    encoded = held(numbered.mapInArrow(encode_texts(encoder), ENCODED), "encoded")
    stats = statistics(encoded)
    keyed = encoded.filter("_row >= 0").mapInArrow(order_keys(stats), f"{ENCODED}, _key long")
    return (
        keyed.repartitionByRange("_key", "_row")
        .sortWithinPartitions("_key", "_row")
        .drop("_key")
        .mapInArrow(pack_shards(stats, size, shard_tokens), PIECES)
    )
