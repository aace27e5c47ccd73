"""Secret scans with corpus-wide ownership.

Base patterns find assigned values, access keys and long hex strings. Further candidates are
high-entropy tokens outside these. Every candidate's hash is counted over the whole corpus by
distinct repositories and owners: a value that many owners hold is an example or a
test vector that was copied around; one that stays with an owner or two looks live and is
added to the spans. Base spans stay in any case, with the same verdict beside them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.skew import attach, by_size, held, numbered, own_name
from faultline.llm.words import few_rows, lean

# Fixed patterns: kind, pattern, group that holds the value, least length of that group.
BASE = (
    (
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
# Further candidates: tokens of key characters with a digit and a letter.
TOKEN = r"[A-Za-z0-9+/_=-]+"
LEAST_TOKEN = 20
LEAST_ENTROPY = 3.5  # bits per character
# A value of at most so many owners looks live; beyond, it is a copied example.
MOST_OWNERS = 2
KINDS = ("assign", "access", "hex", "token")

_BASE = {kind: (re.compile(pattern, re.ASCII), group, least) for kind, pattern, group, least in BASE}
_TOKEN = re.compile(TOKEN)
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
# A text without any of these has no assignment.
_NAMES = ("passw", "secret", "token", "key")


def entropy(value: str) -> float:
    """Bits per character by the value's own character counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def long_words(text: str) -> list[str]:
    """Runs without white space that are long enough to hold a hex string or a token."""
    return [w for w in text.split() if len(w) >= LEAST_TOKEN]


def base_spans(text: str, words: list[str] | None = None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind; ends are exclusive, in code points.

    A pattern runs over the whole text, unless the text shows at once that it can't match.
    """
    words = long_words(text) if words is None else words
    lower = text.lower()
    wanted = {
        "assign": any(name in lower for name in _NAMES),
        "access": "AKIA" in text,
        "hex": any(len(w) >= 32 for w in words),
    }
    found = []
    for kind, (pattern, group, least) in _BASE.items():
        if wanted[kind]:
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    found.append((kind, m.start(), m.end(), m.group(group)))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def further_spans(
    text: str, base: list[tuple[str, int, int, str]], words: list[str] | None = None
) -> list[tuple[str, int, int, str]]:
    """High-entropy tokens that touch no base span."""
    words = long_words(text) if words is None else words
    found, at = [], 0
    if not any(_DIGIT.search(w) for w in words):
        return found
    for m in _TOKEN.finditer(text):
        value = m.group()
        if len(value) < LEAST_TOKEN or not _DIGIT.search(value) or not _LETTER.search(value):
            continue
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        if any(s[1] < m.end() and s[2] > m.start() for s in base[at:]):
            continue
        if entropy(value) >= LEAST_ENTROPY:
            found.append(("token", m.start(), m.end(), value))
    return found


def digest(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, *_ in spans)


FOUND = (
    "doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "candidates array<struct<kind:string,start:long,end:long,value_hash:binary>>"
)


@lean
def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_id, owner, repository, text) to FOUND, over whole texts."""
    spans = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_hash", pa.binary())])
    )
    for batch in few_rows(batches):
        counts, digests, candidates = [], [], []
        for text in batch.column(3):
            text = text.as_py() or ""
            words = long_words(text)
            base = base_spans(text, words)
            kinds = Counter(s[0] for s in base)
            counts.append((kinds["assign"], kinds["access"], kinds["hex"]))
            digests.append(hashlib.sha256(digest(base).encode()).hexdigest())
            candidates.append(
                [
                    {"kind": k, "start": a, "end": b, "value_hash": hashlib.sha256(v.encode()).digest()}
                    for k, a, b, v in base + further_spans(text, base, words)
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                batch.column(1).cast(pa.string()),
                batch.column(2).cast(pa.string()),
                *[pa.array([c[k] for c in counts], pa.int64()) for k in range(3)],
                pa.array(digests, pa.string()),
                pa.array(candidates, spans),
            ],
            names=["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "candidates"],
        )


def find_candidates(
    docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document with all its candidates; values are kept as hashes only."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(scan, FOUND)


def ownership(candidates: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """Per candidate hash: documents, distinct repositories and owners, and whether it looks live.

    Counted in two steps, by (hash, owner, repository) and by hash, each combined on the
    map side, so a value in a third of all documents is a few rows per task. Documents
    without an owner count as one owner more.
    """
    per_place = candidates.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    per_owner = per_place.groupBy("value_hash", "owner").agg(
        F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n")
    )
    return per_owner.groupBy("value_hash").agg(
        F.sum("n").alias("group_size"),
        F.count(F.lit(1)).alias("n_owners"),
        F.sum("repositories").alias("n_repositories"),
    ).withColumn("live", F.col("n_owners") <= most_owners)


def scan_secrets(
    docs: DataFrame,
    owner: Column | None = None,
    repository: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_owners: int = MOST_OWNERS,
) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples.

    ``spans`` joins kind:start:end of the base spans and of the further tokens that look
    live, by start, then kind. Null and empty texts have no spans; rows that repeat an id or
    have none each get a row with the spans of their own text. The default owner is ``source``, the
    default repository ``source`` and ``lang``; a missing value of these is an owner like
    any other.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    found = numbered(find_candidates(docs, owner, repository, id_col, text_col), "secrets")
    spread = found.select(
        "_row", "owner", "repository", F.posexplode("candidates").alias("at", "c")
    )
    flat = spread.select(
        "_row", "at", "owner", "repository", "c.kind", F.col("c.start"), F.col("c.end"), "c.value_hash"
    )
    verdicts = held(ownership(flat, most_owners), "ownership")
    judged = attach(flat, verdicts, "value_hash", "_row", ["live", "n_owners", "n_repositories"])
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    piece = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    wanted = F.col("live") | (F.col("kind") != "token")
    per_doc = judged.groupBy(F.col("_row").alias("_id")).agg(
        F.array_sort(
            F.collect_set(F.when(wanted, F.struct(F.col("start"), order.alias("order"), piece.alias("text"))))
        ).alias("found"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_examples"),
    )
    return found.join(per_doc, F.col("_row") == F.col("_id"), "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce(F.array_join(F.transform("found", lambda s: s["text"]), ","), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"),
    )


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """A text with every span of ``spans`` (kind:start:end, comma-joined) replaced by ``mark``.

    Overlapping spans give one mark. Expressions only: spans are folded from the left.
    """
    parts = F.when(F.coalesce(spans, F.lit("")) == "", F.expr("array()").cast("array<array<string>>")).otherwise(
        F.transform(F.split(spans, ","), lambda s: F.split(s, ":"))
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("int").alias("at"))

    def step(done: Column, span: Column) -> Column:
        begin, end = span[1].cast("int"), span[2].cast("int")
        inside = begin < done["at"]
        gap = F.substring(text, done["at"] + 1, F.greatest(begin - done["at"], F.lit(0)))
        return F.struct(
            F.when(inside, done["out"]).otherwise(F.concat(done["out"], gap, F.lit(mark))).alias("out"),
            F.greatest(done["at"], end).alias("at"),
        )

    return F.aggregate(
        parts, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))
    )


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` (columns of documents) with every found span masked; other texts are left as they are."""
    rows = numbered(docs, "secret-input", compression="zstd")
    kinds = dict(docs.dtypes)
    found = scan_secrets(rows, id_col="_row").filter(F.col("spans") != "")
    spans = by_size(found.select(F.col("doc_id").alias("found_id"), F.col("spans").alias("found_spans")), "secret-spans")
    joined = rows.join(spans, rows["_row"] == spans["found_id"], "left")
    hit = spans["found_spans"].isNotNull()
    text = F.when(hit, masked(rows["text"], spans["found_spans"])).otherwise(rows["text"])

    def column(name: str) -> Column:
        if name == "text":
            return text.alias(name)
        if name == "n_chars":
            return F.when(hit, F.char_length(text).cast(kinds[name])).otherwise(rows[name]).alias(name)
        return rows[f"`{own_name(name) if name == '_row' else name}`"].alias(name)

    return joined.select(*[column(c) for c in docs.columns])
