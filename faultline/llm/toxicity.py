"""Toxicity by weak supervision.

Lexicons (whole words, and word beginnings of several lengths, which catch inflected forms)
are mined from labelled rows; each is dealt to several voters, and text patterns vote too. A
generative label model estimates how well every voter separates the hidden classes and how
far voters repeat each other, by expectation maximisation; the given label is one more noisy voter.
A linear classifier is then trained on the posterior labels and scores every whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.skew import held, numbered_in_place, without_rows
from faultline.llm.words import few_rows, lean

# The classifier is fitted on at most so many labelled rows, those of the smallest id hashes.
SAMPLE_ROWS = 16_000
# Entries of the mined lexicon, and the lower confidence bound of their share of toxic texts.
LEXICON = 512
LEAST_SHARE = 0.55
LEAST_TEXTS = 4
PREFIXES = (4, 5, 6, 7, 8)
# A word beginning counts where two words that have it are less than so many words apart.
WINDOW = 160
VOTERS_PER_KIND = 3
THRESHOLD = 0.3
# So many of the smallest word hashes make the mark of a family of near copies.
FAMILY_WORDS = 4
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&+=~`-_/\\"


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def plain_words(pieces: list[str]) -> dict[str, str]:
    """Pieces of a text in lower case, and the words in them without punctuation around."""
    return {piece: word for piece in set(pieces) if (word := piece.strip(PUNCTUATION))}


def dense(places: list[tuple[int, str]], n: int) -> set[str]:
    """Beginnings of ``n`` letters that two words of (place, word) close to each other have, whatever else the text holds."""
    last: dict[str, int] = {}
    found = set()
    for at, word in places:
        if len(word) > n:
            start = word[:n]
            if at - last.get(start, -WINDOW) < WINDOW:
                found.add(start)
            last[start] = at
    return found


def terms(text: str) -> set[str]:
    """Words ("w:") of a whole text, and the beginnings ("4:" to "8:") that are dense in it."""
    pieces = text.lower().split()
    words = plain_words(pieces)
    found = {f"w:{w}" for w in words.values()}
    places = [(at, words[p]) for at, p in enumerate(pieces) if p in words]
    for n in PREFIXES:
        found.update(f"{n}:{b}" for b in dense(places, n))
    return found


UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))


def cased(text: str) -> tuple[int, int]:
    """Letters and capitals of a whole text."""
    if not text.isascii():
        return sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    data = text.encode()
    return len(data) - len(data.translate(None, LETTERS)), len(data) - len(data.translate(None, UPPER))


def patterns(text: str) -> tuple[bool, ...]:
    """Votes of the text itself: shouting, rows of marks, one word over and over."""
    letters, upper = cased(text)
    words = text.split()
    return (
        letters > 20 and upper > 0.6 * letters,
        text.count("!!") * 10 > len(words) > 5,
        len(words) > 20 and len(set(words)) * 4 < len(words),
    )


N_PATTERNS = 3


@dataclass
class Lexicon:
    """Mined terms with their numbers; looks up a text's terms without building the others."""

    entries: list[str]
    by_kind: dict[str, dict[str, int]] = field(default_factory=dict)
    heads: set[str] = field(default_factory=set)

    def __post_init__(self):
        for number, entry in enumerate(self.entries):
            kind, _, term = entry.partition(":")
            self.by_kind.setdefault(kind, {})[term] = number
        # What the beginnings themselves begin with: most words are told off by this alone.
        self.heads = {e.partition(":")[2][: PREFIXES[0]] for e in self.entries if not e.startswith("w:")}

    def hits(self, text: str) -> list[int]:
        pieces = text.lower().split()
        words = plain_words(pieces)
        there = set(words.values())
        found = [number for word, number in self.by_kind.get("w", {}).items() if word in there]
        likely = {p: w for p, w in words.items() if w[: PREFIXES[0]] in self.heads}
        places = [(at, likely[p]) for at, p in enumerate(pieces) if p in likely] if likely else []
        for n in PREFIXES if places else ():
            table = self.by_kind.get(str(n), {})
            found += [table[b] for b in dense(places, n) if b in table]
        return sorted(found)


@lean
def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (text, toxic) to (term, toxic, texts), summed up within a batch."""
    for batch in batches:
        hits, texts = Counter(), Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = terms(text or "")
            texts.update(found)
            if toxic:
                hits.update(found)
        names = list(texts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([hits[n] for n in names], pa.int64()),
                pa.array([texts[n] for n in names], pa.int64()),
            ],
            names=["term", "toxic", "texts"],
        )


def family(text: str) -> int:
    """A hash of the smallest hashes of a text's words: near copies mostly share it."""
    import xxhash

    least = sorted(xxhash.xxh64_intdigest(w) for w in set(text.lower().split()))[:FAMILY_WORDS]
    return xxhash.xxh64_intdigest(repr(least)) - (1 << 63)


@lean
def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [family(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(marks, pa.int64())], names=["doc_id", "text", "toxic", "family"]
        )


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``rows`` labelled rows that may be learned from, one per family."""
    picked = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    marked = held(
        texts.mapInArrow(families, "doc_id long, text string, toxic int, family long"), "toxicity-sample"
    )
    first = marked.groupBy("family").agg(F.min("doc_id").alias("doc_id"))
    return marked.join(F.broadcast(first.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text", "toxic")


def mine_lexicon(sample: DataFrame, entries: int = LEXICON) -> Lexicon:
    """The terms that most surely mark toxic texts; at most ``entries`` reach the driver."""
    sums = (
        sample.select("text", "toxic")
        .mapInArrow(count_terms, "term string, toxic long, texts long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"))
        .filter(F.col("toxic") >= LEAST_TEXTS)
    )
    share, n, z = F.col("toxic") / F.col("texts"), F.col("texts"), 1.96
    bound = (
        share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    ) / (1 + z * z / n)
    best = (
        sums.withColumn("bound", bound)
        .filter(F.col("bound") >= LEAST_SHARE)
        .orderBy(F.desc("toxic"), F.desc("bound"), "term")
        .limit(entries)
    )
    return Lexicon([r.term for r in best.collect()])


def votes(hits: list[list[int]], marks: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Votes of shape (texts, voters): 1 toxic, 0 none, by lexicon voters and pattern voters."""
    kinds = sorted(lexicon.by_kind)
    voter = {
        number: kinds.index(e.partition(":")[0]) * VOTERS_PER_KIND + number % VOTERS_PER_KIND
        for number, e in enumerate(lexicon.entries)
    }
    out = np.zeros((len(hits), len(kinds) * VOTERS_PER_KIND + marks.shape[1]), dtype=np.float64)
    for row, found in enumerate(hits):
        for number in found:
            out[row, voter[number]] = 1
    out[:, len(kinds) * VOTERS_PER_KIND :] = marks
    return out


def label_model(cast: np.ndarray, given: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of the hidden label per text, by EM over voters and the given label.

    Every voter has a rate of firing in either class. Voters that fire together within a
    class beyond chance are counted as so much less than one voice each.
    """
    voices = np.column_stack([cast, given])
    hidden = np.clip(given.astype(float), 0.05, 0.95)
    for _ in range(rounds):
        mass = np.array([(1 - hidden).sum(), hidden.sum()])
        fire = np.stack(
            [((1 - hidden) @ voices + 0.5) / (mass[0] + 1), (hidden @ voices + 0.5) / (mass[1] + 1)]
        )
        # A voter is taken for one only as far as it fires more often in the toxic class.
        fire[1] = np.maximum(fire[1], fire[0])
        rest = voices - np.where(hidden[:, None] > 0.5, fire[1], fire[0])
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        related = (rest.T @ rest) / len(rest) / np.outer(scale, scale)
        weight = 1 / np.clip(related, 0, 1).sum(axis=1)
        prior = math.log((mass[1] + 1) / (mass[0] + 1))
        on = np.log(fire[1] / fire[0])
        off = np.log((1 - fire[1]) / (1 - fire[0]))
        hidden = 1 / (1 + np.exp(-np.clip(prior + voices @ (weight * on) + (1 - voices) @ (weight * off), -30, 30)))
    return hidden


def features(hits: list[list[int]], marks: np.ndarray, size: int) -> np.ndarray:
    """Presence of each term, the pattern votes, and the capped log count of hits."""
    out = np.zeros((len(hits), size + marks.shape[1] + 1), dtype=np.float32)
    for row, found in enumerate(hits):
        out[row, found] = 1
        out[row, -1] = math.log1p(len(found))
    out[:, size:-1] = marks
    return out


def fit_linear(x: np.ndarray, target: np.ndarray, steps: int = 400, rate: float = 0.5, decay: float = 1e-4):
    """Logistic regression on soft labels by accelerated gradient steps."""
    weights, bias = np.zeros(x.shape[1]), math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    speed, pace = np.zeros(x.shape[1] + 1), 0.9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
        error = p - target
        slope = np.append(x.T @ error / len(x) + decay * weights, error.mean())
        speed = pace * speed - rate * slope
        weights, bias = weights + speed[:-1], bias + speed[-1]
    return weights, float(bias)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        hits = [self.lexicon.hits(t) for t in texts]
        marks = np.array([patterns(t) for t in texts], dtype=float).reshape(-1, N_PATTERNS)
        x = features(hits, marks, len(self.lexicon.entries))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """The model, from labels of rows that are not held out; None if they show only one class."""
    sample = held(labelled_sample(docs, labels, rows), "toxicity-rows")
    seen = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len([k for k in seen if k]) == 0 or not seen.get(0):
        return None
    lexicon = mine_lexicon(sample)

    @lean
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([lexicon.hits(t) for t in texts], pa.list_(pa.int32())),
                    pa.array([list(patterns(t)) for t in texts], pa.list_(pa.bool_())),
                ],
                names=["doc_id", "toxic", "hits", "marks"],
            )

    seen_rows = sample.mapInArrow(look, "doc_id long, toxic int, hits array<int>, marks array<boolean>").toPandas()
    seen_rows = seen_rows.sort_values("doc_id", kind="stable")
    hits = [list(h) for h in seen_rows["hits"]]
    marks = np.array([list(m) for m in seen_rows["marks"]], dtype=float).reshape(-1, N_PATTERNS)
    given = (seen_rows["toxic"].to_numpy() > 0).astype(float)
    posterior = label_model(votes(hits, marks, lexicon), given)
    weights, bias = fit_linear(features(hits, marks, len(lexicon.entries)), posterior)
    return Model(lexicon, weights, bias)


def score_rows(model: Model | None):
    """mapInArrow: (id, text) to (doc_id, score)."""

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = model.scores(texts) if model is not None and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(found, pa.float64())], names=["doc_id", "score"]
            )

    return score


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; whole texts.

    Labels, language, source and id are no inputs of a score. Null counts as empty, and
    an empty text has the score of a text without any sign. Where the labels hold one
    class only, every score is 0. Repeated rows each get theirs; extra columns are not looked at.
    """
    model = fit(docs, labels, rows)
    scored = docs.select("doc_id", "text").mapInArrow(score_rows(model), "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, whole rows, in the columns of ``docs``; each row by its own text.

    Texts go to Python to be scored, and only row numbers and scores come back.
    """
    model = fit(docs, labels)
    rows = numbered_in_place(docs, "toxicity-input", compression="zstd")
    scored = rows.select("_row", "text").mapInArrow(score_rows(model), "doc_id long, score double")
    gone = scored.filter(F.col("score") >= THRESHOLD).select(F.col("doc_id").alias("_gone"))
    return without_rows(rows, gone, "toxic-rows")
