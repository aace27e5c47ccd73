"""Repair of conversation structure by the auction algorithm for shortest paths.

Rows of a conversation and the states of the wanted role pattern span a lattice; edits are its arcs,
with whole costs. A path grows from its origin: its last node is extended by the arc with the
least cost plus price, or, if that is more than the node's own price, the price is raised and the
path contracted. A path that reaches the end makes the prices along it exact. The prices then expose
the tight arcs, and the repair is traced along them by the least letter, each step confirmed by
an auction of its own.

Long conversations are cut into segments of bounded length. A segment is first summed up by the costs
between its states, then given prices at its end and a state at its start, and traced on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.skew import attach, by_size, held
from faultline.llm.words import few_rows
from faultline.plans.ranking import exact_row_number

SEGMENT = 64
WHITE = " \t\n\x0b\x0c\r"
# Costs of the edits; an undeleted truncated row costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a. Nothing and after a may end it.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
# The role an insertion or a new role takes in each state.
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}

Row = tuple[str, bool, bool]  # role initial, must go, truncated


class Lattice:
    """Nodes 4 * row + state and one end; ``prices`` never exceed the distance to the end.

    ``ends``: the cost from each state after the last row, None where there is no way on. Without
    ``ends`` the conversation ends here: insertions may follow the last row.
    """

    def __init__(self, rows: Sequence[Row], ends: Sequence[int | None] | None = None):
        self.size, self.end = len(rows), 4 * len(rows) + 4
        arcs: list[list[tuple[str, int, int]]] = []
        for i in range(len(rows) + 1):
            for state in range(4):
                here: list[tuple[str, int, int]] = []
                insert = ("I", INSERT, 4 * i + STEP[WANTED[state]][state])
                if i < len(rows):
                    initial, gone, truncated = rows[i]
                    extra = TRUNCATED if truncated else 0
                    here += [("D", DELETE, 4 * (i + 1) + state), insert]
                    if not gone:
                        kept = STEP.get(initial, {}).get(state)
                        if kept is not None:
                            here.append(("K", extra, 4 * (i + 1) + kept))
                        here.append(("R", REROLE + extra, 4 * (i + 1) + STEP[WANTED[state]][state]))
                elif ends is None:
                    if state in (START, ASSISTANT):
                        here.append(("", 0, self.end))
                    here.append(insert)
                elif ends[state] is not None:
                    here.append(("", ends[state], self.end))
                arcs.append(here)
        self.arcs = self.leading_on(arcs)
        self.prices = [0] * (self.end + 1)
        self.exact = {self.end}

    def leading_on(self, arcs: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """Only arcs from which the end can be reached; an auction needs that."""
        back: list[list[int]] = [[] for _ in range(self.end + 1)]
        for node, here in enumerate(arcs):
            for _, _, to in here:
                back[to].append(node)
        leads, todo = {self.end}, [self.end]
        while todo:
            for node in back[todo.pop()]:
                if node not in leads:
                    leads.add(node)
                    todo.append(node)
        return [[a for a in here if a[2] in leads] for here in arcs]

    def distance(self, origin: int) -> int | None:
        """The cost from a node to the end, by auction; the prices along the found path are exact from then on."""
        if origin != self.end and not self.arcs[origin]:
            return None
        prices, path = self.prices, [origin]
        while path[-1] not in self.exact:
            node = path[-1]
            least, to = min((cost + prices[to], to) for _, cost, to in self.arcs[node])
            if prices[node] < least:
                prices[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        self.exact.update(path)
        return prices[origin]

    def trace(self, state: int) -> tuple[list[str], int]:
        """The letters of each row on the least cheapest path from a state, and the state after the last row.

        Letters of insertions stand before their row's own; those after the last row follow it.
        """
        self.distance(state)
        node, letters, edits = state, "", []
        while node != self.end:
            last = node
            for letter, cost, to in sorted(self.arcs[node]):
                if self.prices[node] == cost + self.prices[to]:
                    self.distance(to)
                    if self.prices[node] == cost + self.prices[to]:
                        break
            letters += letter
            if letter in ("D", "K", "R"):
                edits.append(letters)
                letters = ""
            node = to
        if letters and edits:
            edits[-1] += letters
        return edits, last % 4


def exits(rows: Sequence[Row]) -> list[int | None]:
    """Costs from each state before the rows (major) to each state after them."""
    out: list[list[int | None]] = []
    for goal in range(4):
        lattice = Lattice(rows, [0 if s == goal else None for s in range(4)])
        out.append([lattice.distance(s) for s in range(4)])
    return [out[goal][start] for start in range(4) for goal in range(4)]


# Costs of ending a conversation after its last row: insertions only.
FINAL = [Lattice([]).distance(s) for s in range(4)]


def columns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in few_rows(batches, 1024):
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def grouped(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first ``width`` values; used on runs of bounded length."""
    key, held_rows = None, []
    for row in rows:
        if row[:width] != key:
            if held_rows:
                yield key, held_rows
            key, held_rows = row[:width], []
        held_rows.append(row[width:])
    if held_rows:
        yield key, held_rows


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def arrow(**fields: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field(name, kind) for name, kind in fields.items()])


TEXT, WHOLE, COSTS = pa.string(), pa.int64(), pa.list_(pa.int64())


def segment_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (conv, seg, rn, initial, gone, truncated): the costs between the states of each segment."""

    def rows():
        for (conv, seg), own in grouped(columns_of(batches), 2):
            yield conv, seg, exits([r[1:] for r in own])

    yield from batches_of(rows(), arrow(conv=TEXT, seg=WHOLE, costs=COSTS))


def end_prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (conv, seg, costs), last segment first: the prices at the end of each segment.

    The last one's are null: its conversation ends there. Streams; four prices are kept.
    """

    def rows():
        last, prices = None, None
        for conv, seg, costs in columns_of(batches):
            if conv != last:
                last, prices = conv, None
            yield conv, seg, prices
            after = FINAL if prices is None else prices
            prices = []
            for start in range(4):
                ways = [c + p for c, p in zip(costs[4 * start : 4 * start + 4], after) if c is not None and p is not None]
                prices.append(min(ways) if ways else None)

    yield from batches_of(rows(), arrow(conv=TEXT, seg=WHOLE, ends=COSTS))


def segment_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (conv, seg, rn, initial, gone, truncated, ends): where each start of a segment leads."""

    def rows():
        for (conv, seg), own in grouped(columns_of(batches), 2):
            ends, states = own[0][4], [r[1:4] for r in own[1:]]
            lattice = Lattice(states, ends)
            leads = [lattice.trace(s)[1] if lattice.distance(s) is not None else None for s in range(4)]
            yield conv, seg, ends, leads, own[1][1], own[-1][1]

    yield from batches_of(
        rows(), arrow(conv=TEXT, seg=WHOLE, ends=COSTS, leads=COSTS, first=TEXT, last=TEXT)
    )


def start_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (conv, seg, ends, leads, first, last), in order: the state before each segment.

    ``before`` is the role initial of the row before the segment. Streams; one state is kept.
    """

    def rows():
        here, state, before = None, START, None
        for conv, seg, ends, leads, _, last in columns_of(batches):
            if conv != here:
                here, state, before = conv, START, None
            yield conv, seg, ends, state, before
            state, before = leads[state], last

    yield from batches_of(
        rows(), arrow(conv=TEXT, seg=WHOLE, ends=COSTS, state=WHOLE, before=TEXT)
    )


LEGAL = ("su", "ua", "au")


def segment_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (conv, seg, rn, initial, gone, truncated, ends, state, before, *rest): each row's letters.

    Row number -1 is a segment's header; a conversation of one segment has none.
    ``illegal``: the row doesn't follow lawfully on the one before it.
    """

    def rows():
        for (conv, _), own in grouped(columns_of(batches), 2):
            ends, state, before = own[0][4:7] if own[0][0] < 0 else (None, START, None)
            own = [r for r in own if r[0] >= 0]
            edits, _ = Lattice([r[1:4] for r in own], ends).trace(state)
            for r, edit in zip(own, edits, strict=True):
                yield conv, edit, before is not None and before + r[1] not in LEGAL, r[3], *r[7:]
                before = r[1]

    flag = pa.bool_()
    yield from batches_of(
        rows(),
        arrow(conv=TEXT, edit=TEXT, illegal=flag, truncated=flag, turn=WHOLE, role=TEXT, text_sha256=TEXT,
              _row=WHOLE, copy=pa.int32(), blank=flag, duplicate=flag),
    )


EDITS = (
    "conv string, edit string, illegal boolean, truncated boolean, turn long, role string, text_sha256 string, "
    "_row long, copy int, blank boolean, duplicate boolean"
)


class Repaired:
    """One conversation on its way through: running hash, cost, letters and state."""

    def __init__(self, conv: str):
        self.conv, self.cost, self.state = conv, 0, START
        self.letters: list[str] = []
        self.digest, self.empty = hashlib.sha256(), True

    def say(self, initial: str, role: str, text: str) -> None:
        self.state = STEP[initial][self.state]
        line = f"{role}:{text}"
        self.digest.update((line if self.empty else "\n" + line).encode())
        self.empty = False

    def apply(self, edit: str, truncated: bool, role: str, text: str) -> None:
        self.letters.append(edit)
        for letter in edit:
            wanted = WANTED[self.state]
            if letter == "D":
                self.cost += DELETE
            elif letter == "I":
                self.cost += INSERT
                self.say(wanted, NAMES[wanted], "")
            else:
                self.cost += (REROLE if letter == "R" else 0) + (TRUNCATED if truncated else 0)
                if letter == "R":
                    self.say(wanted, NAMES[wanted], text)
                else:
                    self.say(role[:1], role, text)

    def row(self) -> tuple[str, str, int, str]:
        return self.conv, "".join(self.letters), self.cost, self.digest.hexdigest()


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (conv, role, text, truncated, edit) in order, each row's letters before its text.

    Conversations stream through a running hash; of a conversation only the letters are kept.
    """

    def rows():
        now, letters = None, ("", False)
        for conv, role, text, truncated, edit in columns_of(batches):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now.row()
                now = Repaired(conv)
            if edit is not None:
                letters = edit, truncated
            else:
                now.apply(*letters, role, text)
        if now is not None:
            yield now.row()

    yield from batches_of(rows(), arrow(conv=TEXT, audit=TEXT, cost=WHOLE, repaired_sha256=TEXT))


def conversation_key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: _row, copy, conv, turn, role, text, and what is wrong with each alone."""
    known = conversations.select(
        F.monotonically_increasing_id().alias("_row"),
        conversation_key(F.col("conv_id")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    place = F.concat_ws(":", "conv", F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place.cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    changed = known.filter(kind != 0).select(
        "_row", F.explode(copies).alias("copy"), "conv", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
    )
    bare: Column = F.rtrim(F.col("text"), F.lit(WHITE))
    return changed.withColumns(
        {
            "blank": bare == "",
            "cut_off": ~F.substring(bare, -1, 1).isin(".", "!", "?"),
            "text_sha256": F.sha2("text", 256),
        }
    )


ORDER = ["turn", "role", "text_sha256", "_row", "copy"]


def segment_headers(rows: DataFrame, segment: int) -> DataFrame | None:
    """For conversations of several segments: (conv, seg, ends, state, before) of each segment."""
    long_ones = rows.groupBy("conv").agg(F.max("rn").alias("_n")).filter(F.col("_n") > segment)
    long_ones = by_size(long_ones.select(F.col("conv").alias("_conv")), "long-conversations")
    if long_ones.isEmpty():
        return None
    inside = held(rows.join(long_ones, F.col("conv") == F.col("_conv"), "left_semi"), "long-rows")
    by_segment = inside.repartition("conv", "seg").sortWithinPartitions("conv", "seg", "rn")
    costs = by_segment.mapInArrow(segment_costs, "conv string, seg long, costs array<long>")
    ends = held(
        costs.repartition("conv")
        .sortWithinPartitions("conv", F.desc("seg"))
        .mapInArrow(end_prices, "conv string, seg long, ends array<long>"),
        "end-prices",
    )
    marked = with_headers(inside, ends)
    leads = marked.mapInArrow(
        segment_exits, "conv string, seg long, ends array<long>, leads array<long>, first string, last string"
    )
    return held(
        leads.repartition("conv")
        .sortWithinPartitions("conv", "seg")
        .mapInArrow(start_states, "conv string, seg long, ends array<long>, state long, before string"),
        "segment-starts",
    )


def with_headers(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows of each segment in order, its header before them."""
    marked = rows.unionByName(headers.withColumn("rn", F.lit(-1).cast("long")), allowMissingColumns=True)
    return marked.repartition("conv", "seg").sortWithinPartitions("conv", "seg", "rn")


def repair_conversations(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conv_id of the table: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first, then counted and repaired in the order of turns, those without one first;
    rows of one turn stand by role, then by the SHA-256 of their text. Null texts and
    roles are one space; rows without a conv_id are one conversation. A conversation with no row left
    has zeros, no audit and the hash of nothing. Other columns are not looked at; an empty table gives
    no rows. A SHA-256 can't be put together from parts, so the texts of one conversation stream
    through one task; all else is dealt out by segment.
    """
    rows = held(damaged(conversations), "damaged")
    numbered = exact_row_number(rows.drop("text"), ["conv"], ORDER)
    key = F.sha2(F.concat_ws("|", "conv", F.octet_length("role").cast("string"), "role", "text_sha256"), 256)
    keyed = held(numbered.withColumn("said", key).withColumn("place", F.concat_ws(":", "_row", "copy")), "places")
    firsts = held(keyed.groupBy("said").agg(F.min("rn").alias("first_rn"), F.count(F.lit(1)).alias("group_size")), "first-said")
    judged = held(
        attach(keyed, firsts, "said", "place", ["first_rn"]).select(
            "conv", *ORDER, "rn",
            F.floor((F.col("rn") - 1) / segment).cast("long").alias("seg"),
            F.substring("role", 1, 1).alias("initial"),
            "blank",
            (~F.col("blank") & (F.col("rn") > F.col("first_rn"))).alias("duplicate"),
            (~F.col("blank") & (F.col("rn") == F.col("first_rn")) & F.col("cut_off")).alias("truncated"),
        ),
        "judged",
    )
    lean = judged.select(
        "conv", "seg", "rn", "initial", (F.col("blank") | F.col("duplicate")).alias("gone"), "truncated"
    )
    headers = segment_headers(lean, segment)
    if headers is None:
        headers = lean.sparkSession.createDataFrame([], "conv string, seg long, ends array<long>, state long, before string")
    asked = judged.withColumn("gone", F.col("blank") | F.col("duplicate"))
    edits = held(
        with_headers(asked, headers)
        .select("conv", "seg", "rn", "initial", "gone", "truncated", "ends", "state", "before", *ORDER, "blank", "duplicate")
        .mapInArrow(segment_edits, EDITS),
        "edits",
    )
    return summed(conversations, rows, edits)


def summed(conversations: DataFrame, rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Counts of the judged rows, and the repaired conversations, beside every conv_id of the table."""
    counts = edits.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
    )
    letters = edits.select("conv", *ORDER, F.lit(0).alias("kind"), "truncated", "edit")
    texts = rows.select("conv", *ORDER, F.lit(1).alias("kind"), "text")
    made = (
        texts.unionByName(letters, allowMissingColumns=True)
        .repartition("conv")
        .sortWithinPartitions("conv", *ORDER, "kind")
        .select("conv", "role", "text", "truncated", "edit")
        .mapInArrow(repaired, "conv string, audit string, cost long, repaired_sha256 string")
    )
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    whole = ids.withColumn("conv", conversation_key(F.col("conv_id")))
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (
        whole.join(counts, "conv", "left")
        .join(made, "conv", "left")
        .select(
            "conv_id",
            *zeros,
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )
