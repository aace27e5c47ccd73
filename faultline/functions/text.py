"""Trimming, cutting, joining and percentage text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space in Unicode, not just the blank.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

LINE_BREAK = r"\r\n|\r|\n"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def cut_text(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def escape_pipe(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def before_tag(text: Column) -> Column:
    """The text ahead of a trailing ``[TAG]``."""
    return strip(F.split_part(text, F.lit("["), F.lit(1)))


def bullet_list(items: Column, mark: str) -> Column:
    return F.array_join(F.transform(items, lambda item: F.concat(F.lit(mark), item)), "\n")


def numbered_list(items: Column) -> Column:
    return F.array_join(
        F.transform(
            items, lambda item, i: F.concat((i + 1).cast("string"), F.lit(". "), item)
        ),
        "\n",
    )


def percent_text(rate: Column, decimals: int = 0) -> Column:
    """``rate`` as a percentage, rounded half-even on its exact binary value.

    The scaled value is held as the sum of two doubles, each free of rounding
    error, so a value just below a half is never taken for a half.
    """
    scale = 10**decimals
    percent = F.abs(rate) * 100
    high = percent.cast("float").cast("double")
    low = (percent - high) * scale
    high = high * scale
    whole = F.floor(high)
    beyond_half = (high - (whole + F.lit(0.5))) + low
    units = (
        F.when(beyond_half > 0, whole + 1)
        .when(beyond_half < 0, whole)
        .otherwise(whole + F.pmod(whole, F.lit(2)))
    ).cast("long")
    sign = F.when((rate < 0), "-").otherwise("")
    if decimals == 0:
        return F.concat(sign, units.cast("string"), F.lit("%"))
    return F.concat(
        sign,
        F.floor(units / scale).cast("string"),
        F.lit("."),
        F.lpad((units % scale).cast("string"), decimals, "0"),
        F.lit("%"),
    )


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK, -1)
