import zlib
from collections import Counter, defaultdict

from tokenizers import Tokenizer

from faultline.llm import bestfit, sharding, vocab
from faultline.llm.queries import byte_bpe_encoder


def test_patterns_use_up_the_histogram():
    histogram = {1000: 3, 700: 5, 324: 2, 300: 9, 24: 4, 13: 7, 1: 2, 1024: 2}
    made = bestfit.patterns(histogram)
    used = Counter()
    for window, repeats in made:
        assert sum(window) <= 1024
        for length in window:
            used[length] += repeats
    assert used == Counter(histogram)


def test_two_pieces_replace_the_smallest_one():
    # Greedy takes 600 and 400 and leaves 24; 210 and 214 fill the gap of 424 with nothing left.
    made = bestfit.patterns({600: 1, 400: 1, 210: 1, 214: 1})
    assert tuple(sorted((600, 210, 214), reverse=True)) in [w for w, _ in made]


def test_windows_are_gapless_and_few(make_docs, odd_texts):
    texts = odd_texts + ["a <|endoftext|> b", "<|endoftext|>" * 1500] + ["short text"] * 200
    docs = make_docs(texts)
    rows = bestfit.pack_documents(docs, byte_bpe_encoder()).collect()
    tokenizer = Tokenizer.from_file(vocab.public_path(vocab.BYTE_BPE))
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    total = 0
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        at = 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            packed = b"".join(k.to_bytes(4, "little") for k in ids[at : at + r.length])
            assert r.ids_crc32 == zlib.crc32(packed)
            assert n == 0 or r.length == 1024
            at += r.length
        assert at == len(ids)
        assert len(ids) > 1024 or len(by_doc[i]) == 1
    for window in by_window.values():
        at = 0
        for r in sorted(window, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_window) <= -(-total // 1024) + 1


def test_nothing_to_pack(make_docs):
    assert bestfit.pack_documents(make_docs([]), byte_bpe_encoder()).count() == 0


def test_rank_ids_are_those_of_the_tokenizer(odd_texts):
    tokenizer = Tokenizer.from_file(vocab.public_path(vocab.BYTE_BPE))
    encode = byte_bpe_encoder()()
    assert encode("a <|endoftext|> b") == b"".join(i.to_bytes(4, "little") for i in [64, 220, 50256, 275])
    for text in [*odd_texts, "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext", "  <|endoftext|>\n\n's ", "\x1c\x85  ", " " * 500, "ſK 1²٣"]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert encode(text or "") == b"".join(i.to_bytes(4, "little") for i in ids)


def test_bins_take_the_tightest_room():
    bins, runs, count = sharding.pack_classes([("a", 6), ("b", 5), ("c", 4), ("d", 5)], [], 10)
    assert count == 2 and runs == []
    assert bins["a"] == bins["c"] and bins["b"] == bins["d"]


def test_classes_are_dealt_like_single_groups():
    singles = [(f"g{i}", 7) for i in range(30)]
    _, _, alone = sharding.pack_classes(singles, [], 50)
    _, runs, dealt = sharding.pack_classes([], [(1, 30, 210)], 50)
    assert alone == dealt
    assert sum(b - a for _, a, b, _ in runs) == 210


def test_shards(make_docs, odd_texts):
    texts = odd_texts + ["copy of a text"] * 60 + [f"text {i} " * (i % 50 + 1) for i in range(600)]
    rows = sharding.shard_documents(make_docs(texts), 8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    slots, sizes, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        homes[data].add(r.shard)
    assert set(slots) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    # One text is larger than an equal share; the other shards are near equal.
    rest = sorted(sizes.values())[:-1]
    assert max(rest) <= 1.1 * min(rest)


def test_small_groups_go_by_class(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "SINGLE", 4)
    texts = [f"text {i} " * (i % 9 + 1) for i in range(900)]
    rows = sharding.shard_documents(make_docs(texts), 8).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert sorted(r.doc_id for r in rows) == list(range(900))
    assert max(sizes.values()) <= 1.05 * min(sizes.values())


def test_no_documents_to_shard(make_docs):
    assert sharding.shard_documents(make_docs([]), 8).count() == 0
