import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from faultline.llm import retrieval, vocab

ENCODER = vocab.word_encoder(vocab.public_path(vocab.WORD_BPE))


def plain_ids(texts):
    tokenizer = Tokenizer.from_file(vocab.public_path(vocab.WORD_BPE))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def check_windows(rows, texts, size, ids=None):
    """Each id of each row lies in one piece; windows are gapless and padded by nothing."""
    expected = [i + [2] for i in plain_ids(texts)]
    if ids is None:
        by_doc = defaultdict(list)
        for r in rows:
            by_doc[r.doc_id].append(r)
        assert sorted(by_doc) == list(range(len(texts)))
        for doc, own in by_doc.items():
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(expected[doc]))
                piece = b"".join(i.to_bytes(4, "little") for i in expected[doc][at : at + r.length])
                assert r.ids_crc32 == zlib.crc32(piece)
                at += r.length
            assert at == len(expected[doc])
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size and at & (at - 1) == 0
    assert sum(r.length for r in rows) == sum(map(len, expected))


def test_odd_texts(make_docs, odd_texts):
    texts = odd_texts + ["short text"] * 300 + [f"Number {i} of topic{i % 7}" for i in range(500)]
    docs = make_docs(texts)
    check_windows(retrieval.pack_by_retrieval(docs, ENCODER).collect(), texts, 4096)
    check_windows(retrieval.pack_by_retrieval(docs, ENCODER, size=64, shard_tokens=500).collect(), texts, 64)


def test_null_and_repeated_ids(make_docs):
    texts = ["a b c", "d", None, "d", "e f g h"]
    rows = retrieval.pack_by_retrieval(make_docs(texts, [None, 5, 5, 5, None]), ENCODER, size=8).collect()
    check_windows(rows, texts, 8, ids=True)
    assert Counter(r.doc_id for r in rows if r.start == 0) == {None: 2, 5: 3}


def test_nothing_to_pack(make_docs):
    assert retrieval.pack_by_retrieval(make_docs([]), ENCODER).count() == 0


def test_ids_are_those_of_the_tokenizer(odd_texts):
    encode = ENCODER()
    texts = [
        *odd_texts, "a <|endoftext|> b", "x<|startoftext|>y <|nothing|>", "it's WE'LL I'd 's 'S a'sb", "ÀÉ İstanbul ΣΑΣ ſ K",
        "é ́x äb", "x y\u0085z w \x1c \x1f", "1²½ ٣४ 12,345.67!?", "a\tb\rc\x0bd\x0ce\n\nf", "¡ª µ ­soft", "日本語 한국어 가", "<|", "", "  ", "don't—stop…", "\x00 \x7f",
    ]
    for text, ids in zip(texts, plain_ids(texts), strict=True):
        for _ in range(2):
            assert np.frombuffer(encode(text or ""), dtype="<u2").tolist() == ids, text


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(vocab, "REMEMBERED", 3)
    pieces = vocab.WordPieces(vocab.public_path(vocab.WORD_BPE))
    words = "one two three four five one two six seven one".split()
    assert np.frombuffer(b"".join(pieces[w] for w in words), dtype="<u2").tolist() == plain_ids([" ".join(words)])[0]
    assert len(pieces) <= 3 and len(pieces.old) <= 3


def pieces_of(lists):
    return [retrieval.Piece(i, len(t), 0, np.array(t, dtype="<u2")) for i, t in enumerate(lists)]


def stats_of(lists):
    n = len(lists)
    documents = np.zeros(retrieval.VOCABULARY)
    for tokens in lists:
        documents[list(set(tokens))] += 1
    idf = np.log1p((n - documents + 0.5) / (documents + 0.5)).astype(np.float32)
    return retrieval.Statistics(idf, documents > 1, sum(map(len, lists)) / n)


def test_neighbours_are_those_of_plain_bm25():
    rng = np.random.default_rng(3)
    lists = [rng.integers(10, 60, rng.integers(3, 30)).tolist() for _ in range(80)]
    stats = stats_of(lists)
    index = retrieval.Index(pieces_of(lists), stats)
    unused = rng.random(80) < 0.7
    for seed in range(80):
        scores = {}
        for i, tokens in enumerate(lists):
            counts, score = Counter(tokens), 0.0
            for t in set(lists[seed]):
                if counts[t]:
                    length = 1 - retrieval.B + retrieval.B * len(tokens) / stats.mean_tokens
                    score += float(stats.idf[t]) * counts[t] * (retrieval.K1 + 1) / (counts[t] + retrieval.K1 * length)
            if score and unused[i]:
                scores[i] = score
        found = index.neighbours(seed, unused)
        assert set(found) == set(scores)
        assert all(scores[a] >= scores[b] or math.isclose(scores[a], scores[b], rel_tol=1e-4) for a, b in zip(found, found[1:]))


def test_a_window_holds_the_nearest_neighbours():
    topics = [[100 + 10 * (i % 4) + k for k in range(8)] for i in range(32)]
    windows = retrieval.Windows(0)
    assert retrieval.fill(pieces_of(topics), stats_of(topics), windows, size=64) == []
    homes = defaultdict(set)
    for doc, sequence in zip(windows.rows[0], windows.rows[5], strict=True):
        homes[sequence].add(doc % 4)
    assert len(homes) == 4 and all(len(h) == 1 for h in homes.values())


def test_whole_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    check_windows(retrieval.pack_by_retrieval(docs, ENCODER).collect(), texts, 4096)
