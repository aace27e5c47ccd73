"""Level words in free text, and the rank of a level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.schema import LEVEL_RANK, LEVEL_WORDS

_ANY_LEVEL = r"(?iU)\b(" + "|".join(LEVEL_WORDS) + r")\b"


def level_by_priority(text: Column) -> Column:
    """The most important level word anywhere in the text; null without one.

    A plain search in the upper-cased text rules most words out before their
    regular expression is tried.
    """
    upper = F.upper(text)

    def holds(word: str) -> Column:
        return upper.contains(word) & text.rlike(rf"(?iU)\b{word}\b")

    return F.coalesce(*[F.when(holds(word), F.lit(word)) for word in LEVEL_WORDS])


def level_by_position(text: Column) -> Column:
    """The level word that stands first in the text; null without one."""
    return F.upper(F.nullif(F.regexp_extract(text, _ANY_LEVEL, 1), F.lit("")))


def level_rank(level: Column) -> Column:
    """Severity rank of a level; null where the level is not known."""
    ranks = F.create_map(*[F.lit(v) for pair in LEVEL_RANK.items() for v in pair])
    return F.try_element_at(ranks, F.upper(level))
