"""Analyses: the rule-based one, replies of a completion function, and the choice."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.json_text import holds_valid_json
from faultline.functions.tiers import valid_confidence
from faultline.schema import ANALYSIS_SUMMARY

# Fixed values of the rule-based analysis.
FALLBACK_COMPONENTS = ["auth-service", "database"]
FALLBACK_CONFIDENCE = 0.85

FALLBACK_CAUSE = "%d of %d events are errors; no single cause is named by rule."

# Error codes worth another attempt.
TRANSIENT = ("ThrottlingException", "ServiceUnavailableException", "TimeoutError")


def rule_based_analyses(stats: DataFrame) -> DataFrame:
    """An analysis text per incident from its counts (``n_events``, ``n_errors``)."""
    summary = F.format_string(ANALYSIS_SUMMARY, "n_errors", "n_events")
    body = F.struct(
        summary.alias("summary"),
        F.format_string(FALLBACK_CAUSE, "n_errors", "n_events").alias("root_cause_description"),
        F.array(*[F.lit(c) for c in FALLBACK_COMPONENTS]).alias("affected_components"),
        F.lit(FALLBACK_CONFIDENCE).alias("confidence_score"),
    )
    return stats.select("incident_id", F.to_json(body).alias("analysis"))


def complete(
    prompts: DataFrame,
    function: Callable[[str], str],
    prompt: str = "prompt",
    attempts: int = 3,
    transient: tuple[str, ...] = TRANSIENT,
    pause: float = 1.0,
    time_limit: float = 30.0,
    parallel: int | None = None,
) -> DataFrame:
    """Add ``reply``: ``function`` applied to every prompt, on the executors.

    A transient failure is tried again after pauses that double; a lasting one,
    or no reply within the time limit, becomes a reply that starts with
    ``Error:``. ``parallel`` spreads few prompts over that many tasks. A task that
    Spark repeats asks again.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType())])

    def attempt_all(text: str) -> str:
        for attempt in range(attempts):
            try:
                return function(text)
            except Exception as error:  # noqa: BLE001 - any failure becomes a reply
                known = type(error).__name__ in transient or any(c in str(error) for c in transient)
                if not known or attempt == attempts - 1:
                    return f"Error: {error}"
                time.sleep(pause * 2**attempt)
        return "Error: no attempt was made"

    def ask(text: str) -> str:
        # A call that hangs is left behind in its thread.
        worker = ThreadPoolExecutor(1)
        try:
            return worker.submit(attempt_all, text).result(time_limit)
        except FutureTimeout:
            return "Error: timeout"
        finally:
            worker.shutdown(wait=False, cancel_futures=True)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(reply=[ask(text) for text in frame[prompt]])

    spread = prompts.repartition(parallel) if parallel else prompts
    return spread.mapInPandas(batches, schema)


def is_failed_reply(reply: Column, strict: bool = False) -> Column:
    """A reply with ``Error:`` anywhere; in strict mode, at its start only."""
    failed = reply.startswith("Error:") if strict else reply.contains("Error:")
    return F.coalesce(failed, F.lit(True))


def choose_analysis(replies: DataFrame, fallback: DataFrame, strict: bool = False) -> DataFrame:
    """The reply where it is usable, else the rule-based analysis."""
    usable = ~is_failed_reply(F.col("reply"), strict) & holds_valid_json(F.col("reply"))
    return fallback.withColumnRenamed("analysis", "_rule").join(
        replies.select("incident_id", "reply"), "incident_id", "left"
    ).select(
        "incident_id",
        F.when(usable, F.col("reply")).otherwise(F.col("_rule")).alias("analysis"),
        F.coalesce(usable, F.lit(False)).alias("from_reply"),
    )


def split_by_confidence(analyses: DataFrame, score: str = "confidence_score") -> tuple[DataFrame, DataFrame]:
    """Analyses with a confidence of 0 to 1, and the others."""
    good = valid_confidence(F.col(score))
    return analyses.filter(good), analyses.filter(~good)
