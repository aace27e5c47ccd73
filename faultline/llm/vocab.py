"""Public tokenizer files, read in the task that needs them; their folder is a parameter."""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import lru_cache

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
MULTI = "byte_bpe_multi_50k.tiktoken"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def added_tokens(tokenizer_file: str) -> dict[str, int]:
    """Strings that the tokenizer takes as one token wherever they stand."""
    with open(tokenizer_file, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


@lru_cache(maxsize=2)
def rank_encoding(rank_file: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(rank_file), special_tokens={})


def rank_encoder(rank_file: str, tokenizer_file: str, pattern: str):
    """A maker of text-to-ids functions (little-endian unsigned 32-bit), for use inside tasks.

    The rank file holds the tokenizer file's vocabulary, so both give the same ids; the
    ranks are encoded several times faster. Strings of the file's added tokens are
    cut out first and are their ids, as the tokenizer has it. Texts on which the pattern's engine gives up
    (runs of white space near a million characters) go to the tokenizer itself.
    """

    def make():
        import numpy as np

        fast = rank_encoding(rank_file, pattern)
        added = added_tokens(tokenizer_file)
        cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")").split
        marks = list(added)
        slow = []

        def encode_plain(text: str) -> bytes:
            try:
                ids = fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
            except BaseException as error:  # the engine's panic is no Exception
                if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
                if not slow:
                    from tokenizers import Tokenizer

                    slow.append(Tokenizer.from_file(tokenizer_file))
                ids = np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")
            return ids.astype("<u4", copy=False).tobytes()

        def encode(text: str) -> bytes:
            if not any(m in text for m in marks):
                return encode_plain(text)
            return b"".join(
                added[part].to_bytes(4, "little") if part in added else encode_plain(part) for part in cut(text) if part
            )

        return encode

    return make


# Pieces between spaces that a worker remembers, twice over: those of the current and of the last generation.
REMEMBERED, LONGEST_PIECE = 300_000, 64
# Printable characters below U+0250 are their own composed form and hold no white space.
PLAIN = r"[!-~\u00a1-\u00ac\u00ae-\u024f]+"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def byte_of_symbol() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def word_ranks(tokenizer_file: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary whose words have an end mark; the mark is the byte FF, which no text has."""
    with open(tokenizer_file, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    symbols, ranks = byte_of_symbol(), {}
    for token, rank in vocabulary.items():
        core = token.removesuffix("</w>")
        ranks[bytes(symbols[c] for c in core) + (b"\xff" if core != token else b"")] = rank
    return ranks


class WordPieces(dict):
    """Ids of pieces without spaces, for a tokenizer that drops white space; the last ones asked for are remembered.

    Plain pieces are split into words and merged by ranks, which are the vocabulary's ids;
    others, and strings of added tokens, go to the tokenizer itself.
    """

    def __init__(self, tokenizer_file: str):
        import regex
        import tiktoken

        super().__init__()
        self.file, self.tokenizer, self.old = tokenizer_file, None, {}
        ranks = tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=word_ranks(tokenizer_file), special_tokens={})
        self.merge = ranks._core_bpe.encode_single_piece
        self.plain, self.words = regex.compile(PLAIN).fullmatch, regex.compile(WORDS).findall

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            low = piece.lower()
            if low.isalpha() and (piece.isascii() or max(piece) < "\u0250"):
                found = self.merge(low.encode() + b"\xff")
            else:
                found = self.fresh(piece)
            ids = array("H", found).tobytes()
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def fresh(self, piece: str) -> list[int]:
        if not piece:
            return []
        if self.plain(piece) and "<|" not in piece:
            return [i for word in self.words(piece.lower()) for i in self.merge(word.encode() + b"\xff")]
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.file)
        return self.tokenizer.encode(piece, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def word_pieces(tokenizer_file: str) -> WordPieces:
    return WordPieces(tokenizer_file)


def word_encoder(tokenizer_file: str):
    """A maker of text-to-ids functions (unsigned 16-bit) for a tokenizer that drops white space.

    No token reaches over a space, so pieces between spaces are encoded one by one.
    """

    def make():
        ids_of = word_pieces(tokenizer_file).__getitem__

        def encode(text: str) -> bytes:
            return b"".join(map(ids_of, text.replace("\n", " ").split(" ")))

        return encode

    return make
