"""Slices of a timeline, questions with their answers, and prompts.

A slice is first cut to its n rows per incident, on the map side, and only then
gathered into text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import cut_text
from faultline.functions.timestamps import timestamp_text
from faultline.operators.metrics import (
    INCIDENT,
    ORDER,
    error_stats,
    errors_per_service,
    event_counts,
    is_error,
    service_lists,
)
from faultline.plans.joins import lookup_join
from faultline.plans.ranking import exact_row_number, first_n, rows_before
from faultline.schema import (
    FIRST_ERRORS,
    KEY_EVENTS,
    PREDICTION_MIN_EVENTS,
    RECENT_ANSWER_CHARS,
    RECENT_ANSWERS,
    SUMMARY_CHARS,
    SUMMARY_EVENTS,
    TAIL_EVENTS,
)


def first_events(
    events: DataFrame, n: int, order: Sequence[str] = ORDER, keys: Sequence[str] = INCIDENT
) -> DataFrame:
    return first_n(events, keys, list(order), n)


def last_events(
    events: DataFrame, n: int, order: Sequence[str] = ORDER, keys: Sequence[str] = INCIDENT
) -> DataFrame:
    """The last ``n`` events of every incident, numbered in time order."""
    backwards = first_n(events, keys, [F.desc(c) for c in order], n)
    forwards = Window.partitionBy(*keys).orderBy(*order)
    return backwards.withColumn("rn", F.row_number().over(forwards).cast("long"))


def prediction_tail(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The last events of incidents that have enough of them for a prediction."""
    enough = event_counts(events).filter(F.col("n_events") > PREDICTION_MIN_EVENTS)
    return last_events(events, TAIL_EVENTS, order).join(
        enough.select("incident_id"), "incident_id"
    )


def key_events(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Errors, warnings and fatal events among the *first ten* events."""
    leading = first_events(events, KEY_EVENTS, order)
    return leading.filter(F.upper("level").isin("ERROR", "WARN", "FATAL"))


def first_errors(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The first errors of every incident, with the number of all and of the rest."""
    shown = first_events(events.filter(is_error()), FIRST_ERRORS, order)
    totals = error_stats(events).select("incident_id", "n_errors")
    return shown.join(totals, "incident_id").withColumn(
        "more", F.greatest(F.col("n_errors") - FIRST_ERRORS, F.lit(0))
    )


def as_text(sliced: DataFrame, line: Column, name: str, keys: Sequence[str] = INCIDENT) -> DataFrame:
    """A slice as one text per key, a line per row, in the order of ``rn``."""
    return sliced.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rn", line.alias("line")))),
                lambda row: row["line"],
            ),
            "\n",
        ).alias(name)
    )


def event_line(chars: int | None = None) -> Column:
    message = cut_text(F.col("message"), chars) if chars else F.col("message")
    return F.concat(
        timestamp_text(F.col("timestamp")),
        F.lit(" ["),
        F.col("level"),
        F.lit("] "),
        F.col("service"),
        F.lit(": "),
        message,
    )


def timeline_summary(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    return as_text(first_events(events, SUMMARY_EVENTS, order), event_line(SUMMARY_CHARS), "summary")


# ---------------------------------------------------------------------------
# Questions and answers
# ---------------------------------------------------------------------------


def question_answer_pairs(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Each user turn with the assistant turn that comes right after it."""
    answers = F.col(role) == "assistant"
    paired = rows_before(turns, [conversation], [turn], answers, 1, [turn, role, text])
    return paired.filter(F.col(f"before_{role}") == "user").select(
        conversation,
        F.col(f"before_{turn}").alias(turn),
        F.col(f"before_{text}").alias("question"),
        F.col(text).alias("answer"),
    )


def recent_answers(
    pairs: DataFrame, conversation: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """The last question-answer pairs of a conversation, answers cut short."""
    return (
        last_events(pairs, RECENT_ANSWERS, [turn], [conversation])
        .withColumn("answer", cut_text(F.col("answer"), RECENT_ANSWER_CHARS))
    )


def conversation_stats(turns: DataFrame, conversation: str, turn: str, role: str) -> DataFrame:
    """First and last turn, their distance and the number of questions."""
    return turns.groupBy(conversation).agg(
        F.min(turn).alias("session_start"),
        F.max(turn).alias("session_end"),
        (F.max(turn) - F.min(turn)).alias("duration"),
        F.count_if(F.col(role) == "user").alias("questions_count"),
    )


def in_parts(df: DataFrame, per_part: int, number: str = "rn", name: str = "part") -> DataFrame:
    """Cut numbered rows into parts of a bounded size, counted from 1."""
    return df.withColumn(name, F.expr(f"({number} - 1) div {int(per_part)} + 1"))


def conversation_export(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    pairs_per_part: int = 500,
) -> DataFrame:
    """Every conversation with its session bounds and all its pairs as an array.

    A conversation of more pairs than a part holds yields several rows.
    """
    pairs = question_answer_pairs(turns, conversation, turn, role, text)
    numbered = in_parts(exact_row_number(pairs, [conversation], [turn], "rn"), pairs_per_part)
    gathered = numbered.groupBy(conversation, "part").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rn", turn, "question", "answer"))),
            lambda p: F.struct(p[turn].alias(turn), p["question"].alias("question"), p["answer"].alias("answer")),
        ).alias("history")
    )
    stats = conversation_stats(turns, conversation, turn, role)
    exported = lookup_join(gathered, stats, [conversation])
    silent = stats.join(gathered.filter("part = 1").select(conversation), conversation, "left_anti")
    return exported.unionByName(
        silent.withColumn("part", F.lit(1).cast("long")), allowMissingColumns=True
    )


# ---------------------------------------------------------------------------
# Prompts
# ---------------------------------------------------------------------------


def root_cause_prompts(
    events: DataFrame, order: Sequence[str] = ORDER, lines_per_chunk: int = 1000
) -> DataFrame:
    """Prompts over the whole timeline of every incident.

    Nothing is left out: an incident longer than a chunk yields several prompts,
    numbered in order, and no prompt gathers more lines than a chunk holds.
    """
    numbered = exact_row_number(events, ["incident_id"], list(order), "rn")
    chunked = in_parts(numbered, lines_per_chunk, name="chunk")
    texts = as_text(chunked, event_line(), "log", ["incident_id", "chunk"])
    chunks = chunked.groupBy("incident_id").agg(F.max("chunk").alias("n_chunks"))
    ask = (
        "Find the root cause of the incident in the log below. Reply with one JSON object and "
        "nothing else. Its fields: summary (one sentence), root_cause_description (two or three "
        "sentences), affected_components (list of service names), confidence_score (0 to 1)."
    )
    return lookup_join(texts, chunks, ["incident_id"]).select(
        "incident_id",
        "chunk",
        "n_chunks",
        F.concat(
            F.lit(ask + "\n\nLog, part "),
            F.col("chunk").cast("string"),
            F.lit(" of "),
            F.col("n_chunks").cast("string"),
            F.lit(":\n"),
            F.col("log"),
        ).alias("prompt"),
    )


def prediction_prompts(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    ask = (
        "Does this log show a problem that a plain error threshold would miss, such as slow "
        "degradation, a cascade or a leak? Reply with one JSON object: issue_detected (true or "
        "false), severity (low, medium, high, critical), description, affected_services, "
        "recommended_actions, confidence (0 to 1).\n\nLog:\n"
    )
    tail = as_text(prediction_tail(events, order), event_line(), "log")
    return tail.select("incident_id", F.concat(F.lit(ask), F.col("log")).alias("prompt"))


def distribution_text(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Errors per service as lines, most errors first."""
    ranked = errors_per_service(events, order).withColumnRenamed("rank", "rn")
    line = F.concat(
        F.lit("- "), F.col("service"), F.lit(": "), F.col("n").cast("string"), F.lit(" errors")
    )
    return as_text(ranked, line, "distribution")


def question_prompts(
    questions: DataFrame,
    events: DataFrame,
    analyses: DataFrame,
    recent: DataFrame | None = None,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """One prompt per question (``incident_id``, ``question``).

    ``analyses`` has one ``analysis`` text per incident, ``recent`` the last pairs
    (``incident_id``, ``rn``, ``question``, ``answer``) of the conversation.
    """
    context = (
        analyses.select("incident_id", "analysis")
        .join(distribution_text(events, order), "incident_id", "left")
        .join(service_lists(events, order=order), "incident_id", "left")
        .join(timeline_summary(events, order), "incident_id", "left")
    )
    if recent is not None:
        line = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("answer"), F.lit("..."))
        context = context.join(as_text(recent, line, "history"), "incident_id", "left")
    else:
        context = context.withColumn("history", F.lit(None).cast("string"))

    def section(title: str, body: Column) -> Column:
        return F.when(body.isNotNull() & (body != ""), F.concat(F.lit(title), body))

    joined = lookup_join(questions, context, ["incident_id"], "left")
    return joined.select(
        *questions.columns,
        F.concat_ws(
            "\n\n",
            F.lit("Answer a question about an incident from the material below only."),
            section("Analysis:\n", F.col("analysis")),
            section("Errors by service:\n", F.col("distribution")),
            section("Services in order of appearance: ", F.array_join("services", ", ")),
            section("Timeline:\n", F.coalesce("summary", F.lit("no events"))),
            section("Earlier questions:\n", F.col("history")),
            section("Question: ", F.col("question")),
        ).alias("prompt"),
    )
