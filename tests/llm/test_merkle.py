import hashlib
import zlib
from collections import defaultdict

import pytest

from faultline.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    text = None if value is None else str(value)
    return "-" if text is None else f"{len(text.encode())}:{text}"


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def leaf(row, text):
    return h(*map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(nodes):
    """(root, per leaf the list of (left, right)) by plain levels over whole lists."""
    level, paths, at = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for i in range(len(nodes)):
            run, k = runs[at[i] // 16], at[i] % 16
            paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            at[i] //= 16
        level = [h(*run) for run in runs]
    return level[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    parts = {}
    for name in names:
        mine = sorted(
            groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))
        )
        parts[name] = mine, *tree([leaf(r, r["text"]) for r in mine])
    root, tops = tree([parts[n][1] for n in names])
    out = []
    for name, top in zip(names, tops, strict=True):
        mine, subroot, paths = parts[name]
        for r, path in zip(mine, paths, strict=True):
            steps = path + top
            own = leaf(r, r["text"])
            touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            fold = leaf(r, lower(r["text"])) if touched else own
            for a, b in steps:
                fold = h(a, fold, b)
            proof = h(*[x for s in steps for x in s])
            out.append((r["doc_id"], own, subroot, root, proof, fold, fold == root))
    return out


def compare(df, **how):
    found = [tuple(r) for r in merkle.manifest(df, **how).collect()]
    expected = brute([r.asDict() for r in df.collect()])
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(expected, key=key)
    return found


def test_odd_rows(make_docs, odd_texts):
    found = compare(make_docs(odd_texts + ["Copy"] * 40 + [f"Text {i}" for i in range(300)]))
    assert {r[6] for r in found} == {True, False}


def test_null_and_repeated_ids(make_docs):
    compare(make_docs(["A", "b", "C", "C", None, "C"], [None, None, 10, 10, 10, -7]))


def test_no_rows_and_one_row(make_docs):
    assert merkle.manifest(make_docs([])).count() == 0
    (row,) = compare(make_docs(["only"]))
    assert row[1] == row[2] == row[3]


def test_many_rounds(spark):
    """Blocks of 16 leaves: 1,100 rows of a source need three rounds, and the sources more than one."""
    rows = [(i, f"s{i % 40}" if i % 3 else "hot", "en", i, f"Text {i}", 1) for i in range(3300)]
    kinds = "doc_id long, source string, lang string, n_chars long, text string, pos int"
    compare(spark.createDataFrame(rows, kinds), block_levels=1)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4096])
def test_block_is_the_plain_tree(n):
    nodes = [h(str(i)) for i in range(n)]
    block = merkle.grown([merkle.Record("t", 0, i, n, (h,)) for i, h in enumerate(nodes)], 3)
    root, paths = tree(nodes)
    assert block.root == root
    assert [[tuple(s) for s in block.witness(i)] for i in range(n)] == paths


def test_a_partial_witness_grows_with_later_siblings():
    block = merkle.Block(1)
    block.append("a")
    block.append("b")
    assert block.witness(0) == [["", "b"]] and block.witness(1) == [["a", ""]]
    block.append("c")
    assert block.witness(0) == [["", "bc"]] and block.witness(1) == [["a", "c"]]
