"""JSON objects inside free text, such as the replies of a completion service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import cut_text, strip
from faultline.schema import ANALYSIS, PREDICTION, RAW_ANALYSIS_CHARS

_FENCED = r"(?is)```(?:json)?\s*(\{.*?\})\s*```"
_OUTER = r"(?s)(\{.*\})"
_TWO_LEVELS = r"(?s)(\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})"


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value, with nothing after it.

    The JSON functions stop at the end of the first value, so the text is set
    inside an array and inside an object; trailing matter breaks one of them.
    """
    in_array = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce(
        (in_array == 1) & in_object.isNotNull() & (F.size(in_object) == 1), F.lit(False)
    )


def is_json_object(text: Column) -> Column:
    return strip(text).startswith("{") & is_json(text)


def outer_object(text: Column) -> Column:
    """From the first opening to the last closing brace."""
    return _found(text, _OUTER)


def holds_valid_json(text: Column) -> Column:
    return F.coalesce(is_json(outer_object(text)), F.lit(False))


def json_block(text: Column) -> Column:
    """The object in a reply, cheaply; line breaks are flattened if it is invalid."""
    first = F.locate("{", text)
    last = F.length(text) - F.locate("}", F.reverse(text)) + 1
    block = F.substring(text, first, last - first + 1)
    return (
        F.when(text.isNull() | (text == ""), "{}")
        .when(text.startswith("{") & text.endswith("}"), text)
        .when(
            (first > 0) & text.contains("}") & (first < last),
            F.when(is_json(block), block).otherwise(F.translate(block, "\n\r", "  ")),
        )
        .otherwise(text)
    )


def balanced_object(text: Column) -> Column:
    """The first top-level group of balanced braces; null without one."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)([^{}]*[{}])"), F.lit(1))

    def step(state: Column, piece: Column) -> Column:
        opens = piece.endswith("{")
        after = state["at"] + F.length(piece)
        depth = state["depth"] + F.when(opens, 1).otherwise(-1)
        start = F.when(opens & (state["depth"] == 0), after).otherwise(state["start"])
        closes = ~opens & (depth == 0) & (start > 0) & (state["stop"] == 0)
        return F.when(
            state["stop"] > 0,
            state,
        ).otherwise(
            F.struct(
                after.alias("at"),
                depth.alias("depth"),
                start.alias("start"),
                F.when(closes, after).otherwise(0).alias("stop"),
            )
        )

    begin = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("start"), F.lit(0).alias("stop")
    )
    last = F.aggregate(pieces, begin, step)
    return F.when(
        last["stop"] > 0,
        F.substring(text, last["start"], last["stop"] - last["start"] + 1),
    )


def extract_json(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the JSON object of a reply, found by four strategies, or an error object.

    A fenced block, balanced braces, braces two levels deep, the whole text. Each
    is a step of its own, tried only on the rows that the steps before it left.
    """
    reply = F.col(text)
    steps = [
        _found(reply, _FENCED),
        balanced_object(reply),
        _found(reply, _TWO_LEVELS),
        strip(reply),
    ]
    found, tried = F.col("_found"), F.col("_tried")
    staged = df.withColumn("_found", F.lit(None).cast("string"))
    for step in steps:
        staged = staged.withColumn("_tried", F.when(found.isNull(), step)).withColumn(
            "_found", F.when(is_json(tried), tried).otherwise(found)
        )
    failed = F.to_json(
        F.struct(
            F.lit("no JSON object found in the reply").alias("error"),
            F.when(
                F.length(reply) > RAW_ANALYSIS_CHARS,
                F.concat(cut_text(reply, RAW_ANALYSIS_CHARS), F.lit("...")),
            )
            .otherwise(reply)
            .alias("raw_response"),
        )
    )
    return staged.withColumn(name, F.coalesce(found, failed)).drop("_found", "_tried")


def with_analysis(df: DataFrame, text: str = "analysis", name: str = "_a") -> DataFrame:
    """Add an analysis reply as a struct; text that is no JSON becomes the summary.

    ``{name}_ok`` tells whether the reply held valid JSON.
    """
    plain = F.struct(
        *[
            (cut_text(F.col(text), RAW_ANALYSIS_CHARS) if field.name == "summary" else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in ANALYSIS.fields
        ]
    )
    staged = df.withColumn("_object", outer_object(F.col(text))).withColumn(
        f"{name}_ok", is_json(F.col("_object"))
    )
    parsed = F.when(F.col(f"{name}_ok"), F.from_json("_object", ANALYSIS)).otherwise(plain)
    return staged.withColumn(name, parsed).drop("_object")


def with_prediction(df: DataFrame, text: str = "reply", name: str = "prediction") -> DataFrame:
    """Add a prediction reply as a struct; null where it holds no valid JSON."""
    staged = df.withColumn("_object", outer_object(F.col(text)))
    parsed = F.when(is_json(F.col("_object")), F.from_json("_object", PREDICTION))
    return staged.withColumn(name, parsed).drop("_object")


def strip_fences(text: Column) -> Column:
    """A reply without code fences and without runs of blank lines."""
    without_open = F.regexp_replace(text, r"```[a-zA-Z]*\n?", "")
    without_close = F.regexp_replace(without_open, r"\n?```", "")
    return strip(F.regexp_replace(without_close, r"(?U)\n\s*\n", "\n\n"))
