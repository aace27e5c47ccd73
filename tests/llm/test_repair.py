import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from faultline.llm import repair

PATTERN = re.compile("(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def judged(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, lines) by plain dynamic programming from the front over whole prefixes."""
    best = {"": (0, "", [])}  # keyed by the role initials so far, reduced to what matters

    def reduce(roles):
        return roles if roles in ("", "s") else roles[-1]

    def better(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way

    def nexts(state):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[state]

    def inserted(table):
        for _ in range(4):
            for state, (cost, audit, lines) in list(table.items()):
                for symbol in nexts(state).replace("s", ""):
                    name = {"u": "user", "a": "assistant"}[symbol]
                    better(table, reduce(symbol), (cost + 2, audit + "I", [*lines, f"{name}:"]))
        return table

    for role, text, fault in rows:
        table = {}
        for state, (cost, audit, lines) in inserted(best).items():
            better(table, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 1 if fault == "truncated" else 0
            if role[:1] and role[:1] in nexts(state):
                better(table, role[:1], (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
            for symbol in nexts(state).replace("s", ""):
                name = {"u": "user", "a": "assistant"}[symbol]
                better(table, symbol, (cost + 2 + extra, audit + "R", [*lines, f"{name}:{text}"]))
        best = table
    return min(way for state, way in inserted(best).items() if state in ("", "a"))


def exhaustive(rows):
    """(cost, audit) over all edits, for a few rows."""
    found = []

    def go(i, roles, cost, audit, inserts):
        if i == len(rows) and PATTERN.fullmatch(roles):
            found.append((cost, audit))
        if inserts < 3:
            for symbol in "ua":
                go(i, roles + symbol, cost + 2, audit + "I", inserts + 1)
        if i < len(rows):
            role, _, fault = rows[i]
            go(i + 1, roles, cost + 3, audit + "D", inserts)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                go(i + 1, roles + (role[:1] or "-"), cost + extra, audit + "K", inserts)
                for symbol in "ua":
                    go(i + 1, roles + symbol, cost + 2 + extra, audit + "R", inserts)

    go(0, "", 0, "", 0)
    return min(found)


def brute(rows):
    groups = defaultdict(list)
    for r in damage(rows):
        groups[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(
            groups[conv],
            key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()),
        )
        faults = judged([r[2:] for r in mine])
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[0][:1] for r in faults]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest(faults)
        counts = [sum(f == kind for _, _, f in faults) for kind in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def some_rows(rng, conversations, turns):
    texts = ["Yes.", "No", " \t", "", "Why? ", "It is so!\n", "and then", None, "你好。", "ok."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    return [
        (c, rng.choice([t, t, t, None]) if c % 5 == 0 else t, rng.choice(roles[:5] if c % 2 else roles), rng.choice(texts))
        for c in range(conversations)
        for t in range(rng.randint(1, turns))
    ]


def frame(spark, rows):
    more = [(*r, "x", 1, 0, 2) for r in rows]
    kinds = "conv_id long, turn long, role string, text string, conv string, rn int, _row int, copy int"
    return spark.createDataFrame(more, kinds).repartition(3)


def compare(spark, rows, **how):
    found = repair.repair_conversations(frame(spark, rows), **how).collect()
    expected = brute(rows)
    assert len(found) == len(expected)
    for r in found:
        assert tuple(r)[1:] == expected[r.conv_id], r.conv_id


@pytest.mark.parametrize("seed", range(6))
def test_lattice_finds_the_least_cheapest_edits(seed):
    rng = random.Random(seed)
    for _ in range(60):
        rows = [
            (rng.choice(["system", "user", "assistant", "tool", ""]), str(i), rng.choice(["", "", "truncated", "blank"]))
            for i in range(rng.randint(1, 4))
        ]
        cost, audit = exhaustive(rows)
        assert cheapest(rows)[:2] == (cost, audit)
        lattice = repair.Lattice([(r[:1], f == "blank", f == "truncated") for r, _, f in rows])
        edits, _ = lattice.trace(repair.START)
        assert ("".join(edits), lattice.distance(repair.START)) == (audit, cost)


def test_prices_are_distances_on_the_path_and_never_above():
    rng = random.Random(1)
    rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(60)]
    lattice = repair.Lattice(rows)
    total = lattice.distance(repair.START)
    whole = repair.Lattice(rows)
    for node in range(whole.end):
        d = whole.distance(node)
        assert d is None or (lattice.prices[node] <= d and (node not in lattice.exact or lattice.prices[node] == d))
    assert total == whole.prices[repair.START] and total <= 3 * len(rows)


def test_small_conversations(spark):
    compare(spark, some_rows(random.Random(4), 60, 9))


def test_long_conversations_in_segments(spark):
    rng = random.Random(8)
    rows = some_rows(rng, 6, 12) + [(100 + c, t, rng.choice(["user", "assistant", "system"]), f"{rng.randint(0, 60)}{rng.choice('.,')}") for c in range(3) for t in range(90)]
    compare(spark, rows, segment=4)
    compare(spark, rows, segment=1)


def test_null_ids_repeated_rows_and_none(spark):
    rows = [(None, None, "user", "A."), (None, 1, "assistant", "B."), (7, 0, None, None)] + [(3, 1, "user", "Same.")] * 5
    compare(spark, rows)
    assert repair.repair_conversations(frame(spark, [])).count() == 0


def test_no_row_left(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = repair.repair_conversations(frame(spark, [(conv, 0, "user", "Hello.")])).collect()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_whole_table(spark, tables):
    rows = spark.read.parquet(f"{tables}/conversations.parquet")
    compare(spark, [tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
