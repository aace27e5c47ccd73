import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import bpe, vocab

FILE, PATTERN = vocab.public_path(vocab.MULTI), vocab.public_pattern()


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(vocab.read_ranks(FILE), PATTERN, bpe.perfect_hash(FILE))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=PATTERN, mergeable_ranks=vocab.read_ranks(FILE), special_tokens={}
    )


def numbers(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def test_the_hash_is_minimal_and_perfect():
    keys = [f"k{i}".encode() for i in range(1000)]
    found = bpe.PerfectHash(keys)
    assert sorted(found.order.tolist()) == list(range(1000))
    assert found.find(keys).tolist() == list(range(1000))
    assert bpe.PerfectHash([b"a"]).find([b"a", b"b"]).tolist() == [0, 0]


def test_ids_are_those_of_the_library(coder, library, odd_texts):
    rng = random.Random(1)
    marks = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "the", "'s", "'LL", "1", "٣", "²", "é", "你", "😀", "\x00", "\r\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [t or "" for t in odd_texts] + [" " * 3000, "\n" * 700 + "a"]
    for text, packed in zip(texts, coder.encode(texts), strict=True):
        assert numbers(packed) == library.encode_ordinary(text)
        assert coder.decode(packed) == text.encode()


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_round_trip_of_any_text(coder, library, text):
    packed = coder.encode([text])[0]
    assert numbers(packed) == library.encode_ordinary(text)
    assert coder.decode(packed) == text.encode()


def test_documents(spark, make_docs, odd_texts, library):
    found = {r.doc_id: r for r in bpe.check_round_trip(make_docs(odd_texts), FILE, PATTERN).collect()}
    for i, text in enumerate(odd_texts):
        ids = library.encode_ordinary(text or "")
        packed = b"".join(n.to_bytes(4, "little") for n in ids)
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.check_round_trip(make_docs([]), FILE, PATTERN).count() == 0


def test_encode_and_decode_columns(make_docs, odd_texts):
    ids = bpe.encode_column(make_docs(odd_texts), FILE, PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode_column(ids, FILE, PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(odd_texts)}
