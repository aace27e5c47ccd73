import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import exact_dedup, graph, jaccard, repeats
from faultline.llm.words import text_slices


def normal(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def test_exact_groups(make_docs, odd_texts):
    texts = odd_texts + ["hot text"] * 300
    found = exact_dedup.exact_groups(make_docs(texts)).collect()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[normal(t)].append(i)
    assert len(found) == len(texts)
    for r in found:
        own = groups[normal(texts[r.doc_id])]
        keep = min(own, key=lambda i: (-len(texts[i] or ""), i))
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(own), keep == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(normal(texts[r.doc_id]).encode()).hexdigest()


def test_chunks_give_the_text_back(spark, odd_texts):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(t or "",) for t in odd_texts], "t string")
    for r in frame.select("t", exact_dedup.chunks(F.col("t"), 16, 64).alias("c")).collect():
        assert "".join(r.c) == r.t
        assert all(len(c) <= 64 for c in r.c)


def test_an_insertion_changes_few_chunks_in_any_script(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    alphabets = {
        "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOP", "digits": "0123456789", "french": "éàèçabcdeiou",
        "chinese": [chr(c) for c in range(0x4E00, 0x9000, 7)], "russian": [chr(c) for c in range(0x410, 0x450)],
        "korean": [chr(c) for c in range(0xAC00, 0xD000, 11)], "emoji": [chr(c) for c in range(0x1F600, 0x1F640)],
    }
    rows = []
    for name, letters in alphabets.items():
        text = "".join(rng.choice(letters) for _ in range(40_000))
        rows += [(name, 0, text), (name, 1, letters[0] + text), (name, 2, text[:20_000] + letters[1] * 3 + text[20_000:])]
    frame = spark.createDataFrame(rows, "name string, n int, t string")
    found = {(r.name, r.n): r.c for r in frame.select("name", "n", exact_dedup.chunks(F.col("t")).alias("c")).collect()}
    for name in alphabets:
        whole = found[name, 0]
        assert 20 <= len(whole) <= 40
        for n in (1, 2):
            assert len(set(whole) & set(found[name, n])) >= 0.7 * len(whole), (name, n)


def test_exact_dedup_of_repeated_rows_null_ids_and_none(make_docs):
    rows = exact_dedup.exact_groups(make_docs(["a b", "a b", "ab", "c"], [1, 1, None, 2])).collect()
    assert len(rows) == 4
    assert {(r.doc_id, r.keep_id, r.kept) for r in rows} == {(1, 1, True), (None, 1, False), (2, 2, True)}
    assert exact_dedup.exact_groups(make_docs([])).count() == 0
    docs = make_docs(["a b", "ab", "c", None, ""])
    stay = exact_dedup.without_copies(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == [0, 2, 3]


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 202)]
    random.Random(2).shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.root for r in graph.components(frame).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in (200, 201, 202)}
    assert found == want
    assert graph.components(frame.limit(0)).count() == 0


def shingles(text, n):
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    words = (text or "").encode().translate(low).split()
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*[words[k:] for k in range(n)], strict=False))


def brute(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in range(len(texts))}


def variants(seed, families=12, copies=25):
    rng = random.Random(seed)
    texts = []
    for _ in range(families):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice((3, 7, 9, 12, 40, 150, 400)))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                at = rng.randrange(len(words))
                kind = rng.random()
                if kind < 0.4:
                    words[at] = f"w{rng.randint(0, 5000)}"
                elif kind < 0.7:
                    words.insert(at, "new")
                elif len(words) > 1:
                    del words[at]
            texts.append(" ".join(words))
    return texts


def test_no_link_is_lost(make_docs, odd_texts):
    texts = odd_texts + variants(3) + ["hot hot text of nine words that all have it"] * 50
    for n, percent in ((4, 85), (5, 80)):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(make_docs(texts), n, percent).collect()}
        assert found == brute(texts, n, percent)


def test_large_families_are_split(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    monkeypatch.setattr(jaccard, "GROUP", 4)
    texts = variants(11, families=4, copies=60)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(make_docs(texts), 4, 85).collect()}
    assert found == brute(texts, 4, 85)


def test_similar_pairs_share_a_signature():
    import pyarrow as pa

    rule = jaccard.Rule(85)
    texts = variants(7, families=40, copies=6)
    part = next(text_slices(pa.array(texts)))
    token, bounds = jaccard.shingle_sets(part, 4)
    frequent = np.unique(token)[::3]  # whatever is taken for frequent
    signature, row = jaccard.signatures(token, bounds, rule, frequent)
    own = defaultdict(set)
    for s, r in zip(signature.tolist(), row.tolist(), strict=True):
        own[r].add(s)
    sets = [shingles(t, 4) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            if a != sets[j] and a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                assert own[i] & own[j]


def test_near_copies_keep_one_of_each(make_docs, odd_texts):
    docs = make_docs(odd_texts + ["x y z"], [*range(len(odd_texts)), None])
    stay = jaccard.without_near_copies(docs)
    assert stay.columns == docs.columns
    ids = {r.doc_id for r in stay.collect()}
    assert {0, 1, 2, 6, None} <= ids and not ids & {7, 8, 9, 10, 11}
    assert jaccard.similar_groups(make_docs([])).count() == 0


def repeated(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for b in data:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] += 1
    out = []
    for b in data:
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts(odd_texts):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdef ") for _ in range(150))
    texts = [t for t in odd_texts if t is None or len(t) < 20_000]
    for i in range(60):
        cut = rng.randint(0, 60)
        texts.append(f"{i} own words {rng.random()} " + passage[cut : rng.randint(90, 150)] + f" more {rng.random()}")
    return texts


def rows_of(found):
    return sorted(((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found))


def test_repeats(make_docs, odd_texts):
    texts = repeat_texts(odd_texts)
    found = repeats.remove_repeats(make_docs(texts), length=50, gram=16).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == dict(enumerate(repeated(texts, 50)))
    assert repeats.remove_repeats(make_docs([])).count() == 0


@pytest.mark.parametrize(("length", "gram"), [(200, 32), (32, 16)])
def test_repeats_with_null_and_repeated_ids(make_docs, length, gram):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = [f"{i} {rng.random()} {passage} {rng.random()}" for i in range(3)] + ["short and its own", passage[:31], None, passage[:240]]
    for ids in ([None, None, 1, 1, 1, 1, 1], [None] * 7, [5, 5, 5, 6, None, 6, 5]):
        found = repeats.remove_repeats(make_docs(texts, ids), length, gram).collect()
        want = [(i or -1, *r) for i, r in zip(ids, repeated(texts, length), strict=True)]
        assert rows_of(found) == sorted(want)


def test_many_strings_around_one_anchor(make_docs):
    """More strings than an index takes, so windows decide; and one passage in every text."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    texts = [f"{rng.random()}{passage[: rng.randint(60, 90)]}{rng.random()}" for _ in range(700)] + [passage] * 50
    found = repeats.remove_repeats(make_docs(texts), length=50, gram=16).collect()
    assert rows_of(found) == sorted((i or -1, *r) for i, r in enumerate(repeated(texts, 50)))


def settled(rows, size):
    """What ``settle`` says of sorted rows in batches of a size: covered, and the open ones by anchor."""
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows[i : i + size]), kinds, strict=True)], names=list(repeats.FIELDS)
        )
        for i in range(0, len(rows), size)
    ]
    out = [r for b in repeats.settle(iter(batches)) for r in b.to_pylist()]
    covered = sorted((r["row"], r["lo"]) for r in out if r["kind"] == repeats.COVERED)
    edges = sorted((r["row"], r["lo"]) for r in out if r["kind"] == repeats.EDGE)
    references = sorted(r["anchor"] for r in out if r["kind"] == repeats.REFERENCE)
    return covered, edges, references


@pytest.mark.parametrize("carried", [1, 3, 20])
def test_long_groups_are_settled_run_by_run(monkeypatch, carried):
    rng = random.Random(carried)
    rows = []
    for n in range(400):
        key = rng.choice([1, 1, 1, 2, 3, *range(4, 40)])
        rows.append((key, key, key * 1000 + int(rng.random() ** 3 * 30), n, n % 7, n % 7, rng.random() < 0.05, False))
    rows.sort()
    plain = settled(rows, 1000)
    monkeypatch.setattr(repeats, "CARRIED", carried)
    for size in (1, 5, 64):
        covered, edges, references = settled(rows, size)
        assert covered == plain[0]
        # A group passed on run by run may hand on a lonely run, which finds no partner there.
        assert set(plain[1]) <= set(edges) and set(plain[2]) <= set(references)
        assert not set(covered) & set(edges)


def test_matching_statistics_come_from_run_ends():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(30)] + [b"abab" * 10] * 3
    stats = repeats.matching_statistics(strings)
    at = 0
    for n, s in enumerate(strings):
        for i in range(len(s)):
            best = 0
            for m, t in enumerate(strings):
                for j in range(len(t)):
                    if (m, j) != (n, i):
                        k = 0
                        while i + k < len(s) and j + k < len(t) and s[i + k] == t[j + k]:
                            k += 1
                        best = max(best, k)
            assert stats[at] == best
            at += 1
    assert at == len(stats)
