"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text without its white space is cut where its own content says so: a chunk ends at the
first boundary mark after a minimum length, so equal texts have equal chunks wherever they
stand, and an insertion changes the chunks around it alone. Each distinct chunk travels once,
to the task that verifies its identifier; from then on documents are compared by their
ordered lists of identifiers, and no long text moves again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.skew import attach, held, numbered_in_place, without_rows

# What is deleted before texts are compared.
WHITE = " \t\n\x0b\x0c\r"
# Chunk lengths in code points, and the marks that may end a chunk.
SHORTEST, LONGEST = 1024, 8192
LATIN = range(0x21, 0x250)


def characters(codes: Iterable[int]) -> str:
    return "[" + "".join(f"\\u{c:04X}" for c in codes) + "]"


# A mark is fixed by two neighbouring characters, whatever their case, or by one of a script beyond Latin: an eighth of
# its code points, in short runs for alphabets and signs and longer ones for the rest.
MARKS = (
    characters(c for c in LATIN if c % 8 == 4)
    + characters(c for c in LATIN if c % 4 == 1)
    + r"|(?=[\u0250-\uFFFF])["
    + "".join(f"\\u{c:04X}-\\u{c + 3:04X}" for c in range(0x260, 0x2000, 32))
    + "".join(f"\\u{c:04X}-\\u{c + 15:04X}" for c in range(0x2000, 0xD800, 128))
    + r"\uE000-\uFFFF]|(?=[\x{10000}-\x{10FFFF}])["
    + "".join(f"\\x{{{c:X}}}-\\x{{{c + 3:X}}}" for c in range(0x1F000, 0x20000, 32))
    + "".join(f"\\x{{{c:X}}}-\\x{{{c + 15:X}}}" for c in range(0x20000, 0x30000, 128))
    + "]"
)


def normalised(text: Column) -> Column:
    """A text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The chunks of a text in order; joined they give the text back. Empty text: none."""
    pattern = rf"(?s).{{{shortest},{longest}}}?(?={MARKS})|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, length in code points, SHA-256 of the normalised text, and its recipe."""
    cut = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_points"),
        normalised(F.col(text_col)).alias("normal"),
    ).withColumn("chunks", chunks(F.col("normal")))
    return cut.select(
        "doc_id",
        "n_points",
        F.sha2("normal", 256).alias("text_sha256"),
        "chunks",
        F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("recipe"),
    )


def conflicts(cut: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk; none, unless SHA-256 is broken.

    Equal chunks meet on the map side first; every distinct chunk moves once.
    """
    parts = cut.select(F.explode(F.arrays_zip("recipe", "chunks")).alias("part")).select(
        F.col("part.recipe").alias("id"), F.col("part.chunks").alias("chunk")
    )
    seen = parts.groupBy("id").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return seen.filter(F.col("low") != F.col("high")).select("id")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (space and U+0009 to U+000D). Of
    equal texts the one with the most code points stays, then the smallest id. Null and
    empty texts, and texts of white space alone, are one group. Rows that repeat a
    document, id included, count as copies, give a row each and share its fate; a null id is an id, the smallest. Further columns are not
    looked at; an empty table gives no rows.
    """
    cut = recipes(docs, id_col, text_col)
    verified = conflicts(cut).isEmpty()
    # Verified identifiers stand for their chunks; if ever they did not, the chunks stand for themselves.
    recipe = F.col("recipe") if verified else F.transform("chunks", lambda c: c.cast("binary"))
    narrow = held(cut.select("doc_id", "n_points", "text_sha256", recipe.alias("recipe")), "recipes")
    groups = held(
        narrow.groupBy("recipe").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min(F.struct(-F.col("n_points"), F.col("doc_id"))).getField("doc_id").alias("keep_id"),
        ),
        "recipe-groups",
    )
    # An array is no join key of attach(); its flat form with a fixed width per entry is as exact.
    flat = F.array_join(F.transform("recipe", lambda c: F.hex(c)), ",")
    rows = narrow.select("doc_id", "text_sha256", flat.alias("key"))
    heads = groups.select(flat.alias("key"), "group_size", "keep_id")
    return attach(rows, heads, "key", "doc_id", ["keep_id", "group_size"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, whole rows, in the columns of ``docs``; one row of each group, ids missing or repeated."""
    rows = numbered_in_place(docs, "exact-input", compression="zstd")
    found = exact_groups(rows.select(F.struct("doc_id", "_row").alias("key"), "text"), id_col="key")
    gone = found.filter(~F.col("kept")).select(F.col("doc_id._row").alias("_gone"))
    return without_rows(rows, gone, "copies")
