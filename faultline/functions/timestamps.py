"""Timestamps from text and numbers. The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted formats. Single letters take padded and unpadded digits.
DATE_TIME = "yyyy-M-d H:m:s"
ISO = "yyyy-M-d'T'H:m:s"
ISO_ZULU = "yyyy-M-d'T'H:m:s'Z'"
ISO_FRACTION = "yyyy-M-d'T'H:m:s.SSSSSS"
ISO_FRACTION_ZULU = "yyyy-M-d'T'H:m:s.SSSSSS'Z'"
DAY_FIRST = "d/M/yyyy H:m:s"
MONTH_FIRST = "M/d/yyyy H:m:s"
DATE = "yyyy-M-d"

# Where a timestamp may stand in a line, in order of preference.
IN_TEXT = [
    r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})",
    r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})",
    r"(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2})",
]

_SECONDS = r"^-?[0-9]{1,11}(?:\.[0-9]+)?(?:[eE][+]?[0-9]+)?$"
_MAX_SECONDS = 253402300799.0  # end of the year 9999
_MIN_SECONDS = -62135596800.0  # start of the year 1


# The padded forms among the formats, which a cast reads as well.
_PADDED = (
    r"^\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}:\d{2}|T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z?)\z"
)


def _cast(text: Column) -> Column:
    """A padded timestamp by cast, far cheaper than by format. There is no year 0."""
    ad = F.lit("0001-01-01").cast("timestamp")
    read = F.nullif(text, F.lit("")).try_cast("timestamp")
    return F.when(read >= ad, read)


def parse_timestamp(text: Column) -> Column:
    """The first format that fits; the letters in the text tell which can.

    ``T``, ``Z``, ``/`` and the blank are literals of the formats, so each text
    is tried against one format (two for slashes) instead of all eight.
    """

    def read(pattern: str) -> Column:
        return F.try_to_timestamp(text, F.lit(pattern))

    zulu = text.endswith("Z")
    fraction = text.contains(".")
    return (
        F.when(text.rlike(_PADDED), _cast(text))
        .when(
            text.contains("T"),
            F.when(zulu & fraction, read(ISO_FRACTION_ZULU))
            .when(zulu, read(ISO_ZULU))
            .when(fraction, read(ISO_FRACTION))
            .otherwise(read(ISO)),
        )
        .when(text.contains("/"), F.coalesce(read(DAY_FIRST), read(MONTH_FIRST)))
        .when(text.contains(" "), read(DATE_TIME))
        .otherwise(read(DATE))
    )


def from_seconds(seconds: Column) -> Column:
    """Epoch seconds; null outside the calendar."""
    return F.when(
        seconds.between(_MIN_SECONDS, _MAX_SECONDS), F.timestamp_seconds(seconds)
    )


def parse_seconds(text: Column) -> Column:
    """Epoch seconds written as a number; null for any other text."""
    return F.when(text.rlike(_SECONDS), from_seconds(text.try_cast("double")))


def find_timestamp(line: Column) -> Column:
    """The timestamp inside a line, to whole seconds."""
    blank, iso, slashes = [F.regexp_extract(line, pattern, 1) for pattern in IN_TEXT]
    return F.coalesce(
        _cast(blank),
        _cast(iso),
        F.try_to_timestamp(slashes, F.lit(DAY_FIRST)),
        F.try_to_timestamp(slashes, F.lit(MONTH_FIRST)),
    )


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
