"""Redaction of personal data and secrets with native regular expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and placeholders, in the order in which they apply.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?U)\b(?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b"
CARD = r"(?U)\b(?:\d[ \-]?){13,16}\b"
SECRET = r"(?iU)\b(?:api[_\-]?key|secret|token|password)\s*[=:]\s*\S+"
BEARER = r"(?iU)Bearer\s+[A-Za-z0-9\-._~+/]+=*"

# Strict mode: any prefix on the key, a scheme word after it, and no phone or
# card inside a longer run of digits that reads as an epoch.
SECRET_STRICT = (
    r"(?iU)\b[\w\-]*(?:api[_\-]?key|secret|token|password)\s*[=:]\s*(?:Bearer\s+)?\S+"
)
EPOCH = r"(?U)\b1[0-9]{9}(?:[0-9]{3})?\b"

# Cheap tests that hold wherever a pattern can match: digits grouped as in a phone
# number; a digit and twelve more digits or separators.
_PHONE_LIKE = r"(?U)\d{3}\D{0,2}\d{3}\D?\d{4}"
_CARD_LIKE = r"[0-9][0-9 \-]{12}"
_SECRET_WORDS = ["API", "SECRET", "TOKEN", "PASSWORD", "BEARER"]


def _has_card(text: Column) -> Column:
    # Digits beyond ASCII count as digits too; texts that may hold some all pass.
    return text.rlike(_CARD_LIKE) | (F.octet_length(text) != F.length(text))


def _has_secret_word(text: Column) -> Column:
    # The Kelvin sign and the long s are a k and an s to a pattern without case.
    upper = F.upper(text)
    words = reduce(lambda a, b: a | b, [upper.contains(word) for word in _SECRET_WORDS])
    return words | text.contains("\u212a") | text.contains("\u017f")


def _swap(*pairs: tuple[str, str]) -> Callable[[Column], Column]:
    def replace(value: Column) -> Column:
        for pattern, mark in pairs:
            value = F.regexp_replace(value, pattern, mark)
        return value

    return replace


def _steps(text: Column, strict: bool) -> list[tuple[Column, Callable[[Column], Column]]]:
    """Guard on the original text, and the replacements it guards, in order."""
    mail = (text.contains("@"), _swap((EMAIL, "[EMAIL]")))
    secret = SECRET_STRICT if strict else SECRET
    secrets = (_has_secret_word(text), _swap((secret, "[REDACTED]"), (BEARER, "[REDACTED]")))
    if not strict:
        return [
            mail,
            (text.rlike(_PHONE_LIKE), _swap((PHONE, "[PHONE]"))),
            (_has_card(text), _swap((CARD, "[CARD]"))),
            secrets,
        ]
    # Ten and thirteen digit epochs are fenced off, then given back.
    numbers = _swap(
        (EPOCH, "\u0001$0\u0002"),
        ("(?<!\u0001)" + PHONE + "(?!\u0002)", "[PHONE]"),
        ("(?<!\u0001)" + CARD + "(?!\u0002)", "[CARD]"),
        ("[\u0001\u0002]", ""),
    )
    return [mail, secrets, (text.rlike(_PHONE_LIKE) | _has_card(text), numbers)]


def redact(text: Column, strict: bool = False) -> Column:
    """Replace personal data by placeholders, as one expression."""
    made = text
    for _, replace in _steps(text, strict):
        made = replace(made)
    return made


def with_redacted(df: DataFrame, source: str, target: str, strict: bool = False) -> DataFrame:
    """Add the redacted text of a column.

    Each pattern is a step of its own and runs only on rows where its guard says
    that it can match; the replacements make no new material for later patterns.
    """
    if source == target:
        raise ValueError("the guards need the original text next to the redacted one")
    staged = df.withColumn(target, F.col(source))
    for guard, replace in _steps(F.col(source), strict):
        staged = staged.withColumn(
            target, F.when(guard, replace(F.col(target))).otherwise(F.col(target))
        )
    return staged


def redact_metadata(metadata: Column, strict: bool = False) -> Column:
    """The same over every value of a string map."""
    return F.transform_values(metadata, lambda _, value: redact(value, strict))


def found_kinds(text: Column) -> dict[str, Column]:
    """One flag per kind of personal data, each on the unredacted text."""
    return {
        "email": text.contains("@") & text.rlike(EMAIL),
        "phone": text.rlike(_PHONE_LIKE) & text.rlike(PHONE),
        "card": _has_card(text) & text.rlike(CARD),
        "secret": _has_secret_word(text) & text.rlike(SECRET),
        "bearer": _has_secret_word(text) & text.rlike(BEARER),
    }
