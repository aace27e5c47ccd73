"""Merkle manifest of a table: one tree per source, witnesses grown while leaves are appended.

Leaves are appended in order to open subtrees of sixteen. A node that arrives gets a partial
witness, the siblings to its left; every sibling that is completed later extends the witnesses of
those before it. Blocks of 4,096 leaves are aligned to whole subtrees, so each is appended to in
a task of its own, and the roots of the blocks are further appends to the levels above, round by
round, until every source has one root. The roots of the sources are the leaves of the last tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.skew import by_size, held
from faultline.llm.words import few_rows
from faultline.plans.ranking import exact_row_number

WIDTH = 16
# Levels within a block; its leaves are a power of WIDTH, so that blocks are whole subtrees.
BLOCK_LEVELS = 3
# Documents with a crc32 that this divides are tampered with.
TAMPERED = 5

STEPS = "array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(n: int, most: int = BLOCK_LEVELS) -> int:
    """Levels to climb in one block of a tree of ``n`` nodes: to the root, or to the block's top."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // WIDTH), levels + 1
    return levels


class Block:
    """Append to the open subtrees of one aligned block.

    ``steps[level][i]`` is the witness of node i of a level: [siblings before it, siblings after it].
    """

    def __init__(self, levels: int):
        self.levels, self.root = levels, ""
        self.steps: list[list[list[str]]] = [[] for _ in range(levels)]
        self.open: list[list[list[str]]] = [[] for _ in range(levels)]
        self.text = [""] * levels

    def append(self, node: str, level: int = 0) -> None:
        if level == self.levels:
            self.root = node
            return
        for witness in self.open[level]:
            witness[1] += node
        partial = [self.text[level], ""]
        self.open[level].append(partial)
        self.steps[level].append(partial)
        self.text[level] += node
        if len(self.open[level]) == WIDTH:
            self.complete(level)

    def complete(self, level: int) -> None:
        node = digest(self.text[level])
        self.open[level], self.text[level] = [], ""
        self.append(node, level + 1)

    def finish(self) -> str:
        """Complete what is still open, lowest level first, and return the top of the block."""
        for level in range(self.levels):
            if self.open[level]:
                self.complete(level)
        return self.root

    def witness(self, i: int) -> list[list[str]]:
        """Witness steps of leaf i, from the leaf to the top of the block."""
        out = []
        for steps in self.steps:
            out.append(steps[i])
            i //= WIDTH
        return out


@dataclass
class Record:
    """One appended node, or (pos -1) what stands above its block."""

    tree: str
    block: int
    pos: int
    n: int
    rest: tuple


def stream_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Record | None, list[Record]]]:
    """Blocks of a stream sorted by (tree, block, pos): what stands above, and the block's nodes."""
    above, nodes, key = None, [], None
    for batch in few_rows(batches, 2048):
        for tree, block, pos, n, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != (tree, block):
                if nodes:
                    yield above, nodes
                above, nodes, key = None, [], (tree, block)
            record = Record(tree, block, pos, n, tuple(rest))
            if pos < 0:
                above = record
            else:
                nodes.append(record)
    if nodes:
        yield above, nodes


def grown(nodes: list[Record], most: int) -> Block:
    block = Block(levels_of(nodes[0].n, most))
    for r in nodes:
        block.append(r.rest[0])
    block.finish()
    return block


def block_tops(most: int):
    """mapInArrow over (tree, block, pos, n, hash): the top of every block and the blocks of its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [])
        for _, nodes in stream_blocks(batches):
            first = nodes[0]
            row = (first.tree, first.block, -(-first.n // WIDTH**most), grown(nodes, most).root)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["tree", "pos", "n", "hash"]
        )

    return run


def upper_steps(above: Record | None) -> list[tuple[str, str]]:
    return [(s["left"], s["right"]) for s in above.rest[1] or []] if above else []


def node_witnesses(most: int):
    """mapInArrow over (tree, block, pos, n, hash, steps): each node's witness up to the end of the tree above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for above, nodes in stream_blocks(batches):
            block, upper = grown(nodes, most), upper_steps(above)
            steps = [[{"left": a, "right": b} for a, b in [*block.witness(i), *upper]] for i in range(len(nodes))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r.tree for r in nodes], pa.string()),
                    pa.array([r.pos for r in nodes], pa.int64()),
                    pa.array(steps, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))),
                ],
                names=["tree", "pos", "steps"],
            )

    return run


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def fold(start: str, steps: Sequence[Sequence[str]]) -> str:
    """The root that a leaf and its witness lead to."""
    for left, right in steps:
        start = digest(left + start + right)
    return start


def leaf_proofs(most: int):
    """mapInArrow over (tree, block, pos, n, hash, steps, doc_id, shown, subroot, root): PROOFS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for above, nodes in stream_blocks(batches):
            block, upper = grown(nodes, most), upper_steps(above)
            proofs, folded = [], []
            for i, r in enumerate(nodes):
                steps = [*block.witness(i), *upper]
                proofs.append(digest("".join(part for step in steps for part in step)))
                folded.append(fold(r.rest[3], steps))
            columns = (
                [r.rest[2] for r in nodes],
                [r.rest[0] for r in nodes],
                [above.rest[4]] * len(nodes),
                [above.rest[5]] * len(nodes),
                proofs,
                folded,
            )
            kinds = [pa.int64()] + [pa.string()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"],
            )

    return run


def in_blocks(df: DataFrame) -> DataFrame:
    """Whole blocks to one task each, in the order of the appends; a block is of bounded size."""
    return df.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def blocked(nodes: DataFrame, most: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", 4 * most))


def climb(nodes: DataFrame, label: str, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Append round by round: the nodes of every round, and the roots (tree, root).

    ``nodes``: (tree, pos, n, hash), ``pos`` from 0 in order and ``n`` the nodes of the tree; held.
    A round has a 4,096th of the nodes of the one before, so there are few rounds.
    """
    rounds, finished = [nodes], []
    while True:
        tops = held(
            in_blocks(blocked(rounds[-1], most).select("tree", "block", "pos", "n", "hash")).mapInArrow(
                block_tops(most), "tree string, pos long, n long, hash string"
            ),
            f"{label}-tops",
        )
        finished.append(tops.filter("n = 1").select("tree", F.col("hash").alias("root"), F.lit(len(rounds)).alias("round")))
        if tops.filter("n > 1").isEmpty():
            roots = finished[0]
            for more in finished[1:]:
                roots = roots.unionByName(more)
            return rounds, roots
        rounds.append(tops.filter("n > 1"))


def above_blocks(upper: DataFrame | None, ended: DataFrame | None) -> DataFrame | None:
    """(tree, block, steps): witnesses of the nodes that blocks are in the next round, or of trees that end here."""
    parts = []
    if upper is not None:
        parts.append(upper.select("tree", F.col("pos").alias("block"), "steps"))
    if ended is not None:
        parts.append(ended.select("tree", F.lit(0).cast("long").alias("block"), "steps"))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def descend(rounds: list[DataFrame], ends: DataFrame | None, label: str, most: int) -> DataFrame | None:
    """Witnesses above the blocks of the first round, from the highest round downwards.

    ``ends``: (tree, round, steps), the witness of each tree's own root; None for the last tree.
    """

    def ended(at: int) -> DataFrame | None:
        return None if ends is None else ends.filter(F.col("round") == at + 1)

    upper = None
    for at in range(len(rounds) - 1, 0, -1):
        upper = held(witnessed(rounds[at], above_blocks(upper, ended(at)), most), f"{label}-witnesses")
    return above_blocks(upper, ended(0))


def witnessed(nodes: DataFrame, above: DataFrame | None, most: int) -> DataFrame:
    """(tree, pos, steps) of all nodes of a round."""
    rows = blocked(nodes, most).select("tree", "block", "pos", "n", "hash", F.lit(None).cast(STEPS).alias("steps"))
    if above is not None:
        rows = rows.unionByName(
            above.select("tree", "block", F.lit(-1).cast("long").alias("pos"), "steps"), allowMissingColumns=True
        )
    return in_blocks(rows.select("tree", "block", "pos", "n", "hash", "steps")).mapInArrow(
        node_witnesses(most), f"tree string, pos long, steps {STEPS}"
    )


def field(value: Column) -> Column:
    """A value with its length in bytes before it; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, shown): the leaf of every row, and what a verifier is shown of it."""
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]

    def leaf(text: Column) -> Column:
        return F.sha2(F.concat(*[field(c) for c in [*before, text]]), 256)

    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(F.col("text")).alias("leaf"),
        F.when(touched, leaf(F.translate("text", UPPER, LOWER))).alias("touched"),
    ).select("tree", "doc_id", "leaf", F.coalesce("touched", "leaf").alias("shown"))


def manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; one row per row of ``docs``.

    Leaves of a source ascend by doc_id, rows without one first, repeated ids by leaf (equal rows
    are equal leaves, each with a place of its own). Null values are dashes and empty ones
    have length 0. Rows without a source are a tree of their own, the first. A row without an id is
    never tampered with. Other columns are not looked at; an empty table gives no rows.
    """
    made = held(leaves(docs), "leaves")
    numbers = exact_row_number(made, ["tree"], ["doc_id", "leaf"])
    sizes = by_size(made.groupBy(F.col("tree").alias("_tree")).agg(F.count(F.lit(1)).alias("n")), "tree-sizes")
    nodes = held(
        numbers.join(sizes, F.col("tree") == F.col("_tree")).select(
            "tree", (F.col("rn") - 1).alias("pos"), "n", F.col("leaf").alias("hash"), "doc_id", "shown"
        ),
        "appended-leaves",
    )
    rounds, subroots = climb(nodes, "source", block_levels)
    subroots = held(subroots, "subroots")
    # The trees' roots in the order of their sources: a dash (no source) stands before the equals sign.
    total = subroots.count()
    tops = held(
        exact_row_number(subroots.withColumn("all", F.lit("root")), ["all"], ["tree"]).select(
            F.col("all").alias("tree"), (F.col("rn") - 1).alias("pos"), F.lit(total).cast("long").alias("n"),
            F.col("root").alias("hash"), F.col("tree").alias("of"), "round",
        ),
        "top-leaves",
    )
    top_rounds, root = climb(tops, "top", block_levels)
    witness = witnessed(tops, descend(top_rounds, None, "top", block_levels), block_levels)
    ends = held(
        tops.join(witness.select("pos", "steps"), "pos")
        .join(root.select(F.col("tree").alias("_tree"), "root"), F.col("tree") == F.col("_tree"))
        .select(F.col("of").alias("tree"), "round", "steps", F.col("hash").alias("subroot"), "root"),
        "source-witnesses",
    )
    above = descend(rounds, ends, "source", block_levels)
    roots = ends.select(F.col("tree").alias("_tree"), "subroot", "root")
    above = above.join(roots, F.col("tree") == F.col("_tree")).select(
        "tree", "block", F.lit(-1).cast("long").alias("pos"), "steps", "subroot", "root"
    )
    rows = blocked(nodes, block_levels).unionByName(above, allowMissingColumns=True)
    proofs = in_blocks(
        rows.select("tree", "block", "pos", "n", "hash", "steps", "doc_id", "shown", "subroot", "root")
    ).mapInArrow(leaf_proofs(block_levels), PROOFS)
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))
