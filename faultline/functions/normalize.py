"""From a raw field map to the columns of the event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.timestamps import from_seconds, parse_timestamp
from faultline.schema import LEVEL_KEYS, MESSAGE_KEYS, SERVICE_KEYS, TIMESTAMP_KEYS

KNOWN_KEYS = TIMESTAMP_KEYS + LEVEL_KEYS + SERVICE_KEYS + MESSAGE_KEYS


def first_present(fields: Column, keys: Sequence[str]) -> Column:
    """The value of the first key the map holds, be it null or empty."""
    chain = F
    for key in keys:
        chain = chain.when(F.map_contains_key(fields, key), F.try_element_at(fields, F.lit(key)))
    return chain.otherwise(F.lit(None).cast("string"))


def with_event_time(df: DataFrame, name: str, fields: str = "fields", seconds: str = "seconds") -> DataFrame:
    """Add the first timestamp alias that can be read, of a field map.

    The map ``seconds`` holds values that were numbers in the source; those are
    epochs, while the same digits inside quotes are not a timestamp. The aliases
    are looked up once, ahead of the tries.
    """
    texts = {f"_time_{i}": F.try_element_at(fields, F.lit(k)) for i, k in enumerate(TIMESTAMP_KEYS)}
    tried = []
    for column, key in zip(texts, TIMESTAMP_KEYS):
        tried.append(from_seconds(F.try_element_at(seconds, F.lit(key))))
        tried.append(parse_timestamp(F.col(column)))
    return df.withColumns(texts).withColumn(name, F.coalesce(*tried)).drop(*texts)


def event_level(fields: Column) -> Column:
    return F.upper(F.coalesce(first_present(fields, LEVEL_KEYS), F.lit("INFO")))


def event_service(fields: Column) -> Column:
    return F.coalesce(first_present(fields, SERVICE_KEYS), F.lit("unknown"))


def event_message(fields: Column) -> Column:
    """The message; an event without one is shown whole, as JSON."""
    return F.coalesce(
        F.nullif(first_present(fields, MESSAGE_KEYS), F.lit("")), F.to_json(fields)
    )


def event_metadata(fields: Column) -> Column:
    return F.map_filter(fields, lambda key, _: ~key.isin(KNOWN_KEYS))
