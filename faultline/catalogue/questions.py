"""Questions and answers over conversations and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.catalogue.registry import Tables, query, sql_second, with_log
from faultline.operators import analysis, answers, context, metrics

_PAIRS_SQL = """pairs AS (
    SELECT conv_id, turn, text AS question, answer FROM (
        SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'user' AND next_role = 'assistant')"""


@query(f"WITH {_PAIRS_SQL} SELECT * FROM pairs")
def qa_pairs(t: Tables) -> DataFrame:
    return context.question_answer_pairs(t.table("conversations"))


@query(
    f"""
WITH {_PAIRS_SQL}
SELECT conv_id, turn, question, left(answer, 200) AS answer FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM pairs)
WHERE back <= 2"""
)
def qa_last_two(t: Tables) -> DataFrame:
    pairs = context.question_answer_pairs(t.table("conversations"))
    return context.recent_answers(pairs).drop("rn")


_INTENT_SQL = """CASE
    WHEN {q} LIKE '%timeline%' OR {q} LIKE '%sequence%' OR {q} LIKE '%order%' OR {q} LIKE '%when%' THEN 'timeline'
    WHEN {q} LIKE '%error%' OR {q} LIKE '%failed%' OR {q} LIKE '%failure%' THEN 'error'
    WHEN {q} LIKE '%cause%' OR {q} LIKE '%why%' OR {q} LIKE '%reason%' OR {q} LIKE '%root%' THEN 'cause'
    WHEN {q} LIKE '%prevent%' OR {q} LIKE '%avoid%' OR {q} LIKE '%stop%' OR {q} LIKE '%future%' THEN 'prevention'
    ELSE 'other' END"""


@query(
    f"""SELECT conv_id, turn, {_INTENT_SQL.format(q="lower(text)")} AS intent
        FROM conversations WHERE role = 'user'"""
)
def question_intent(t: Tables) -> DataFrame:
    asked = t.table("conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", answers.question_intent(F.col("text")).alias("intent"))


@query(
    """
SELECT conv_id, min(turn) AS session_start, max(turn) AS session_end, max(turn) - min(turn) AS duration,
       count(*) FILTER (WHERE role = 'user') AS questions_count
FROM conversations GROUP BY 1"""
)
def conversation_sessions(t: Tables) -> DataFrame:
    return context.conversation_stats(t.table("conversations"), "conv_id", "turn", "role")


@query(
    f"""
WITH {_PAIRS_SQL},
numbered AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 + 1 AS part FROM pairs),
parts AS (SELECT conv_id, part, string_agg(concat(turn, '> ', question, ' < ', answer), chr(10) ORDER BY turn) AS history
          FROM numbered GROUP BY 1, 2)
SELECT c.*, coalesce(part, 1) AS part, coalesce(history, '') AS history
FROM (SELECT conv_id, min(turn) AS session_start, max(turn) AS session_end,
             count(*) FILTER (WHERE role = 'user') AS questions_count FROM conversations GROUP BY 1) c
LEFT JOIN parts USING (conv_id)"""
)
def conversation_export(t: Tables) -> DataFrame:
    exported = context.conversation_export(t.table("conversations"), pairs_per_part=2)
    lines = F.transform(
        "history",
        lambda p: F.concat(p["turn"].cast("string"), F.lit("> "), p["question"], F.lit(" < "), p["answer"]),
    )
    return exported.select(
        "conv_id",
        "session_start",
        "session_end",
        "questions_count",
        "part",
        F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("history"),
    )


_QUESTIONS_SQL = """questions AS (
    SELECT event_id, strftime(ts, '%Y%m%d') AS incident_id,
           CASE event_type WHEN 'click' THEN 'What was the SEQUENCE of events?'
                WHEN 'error' THEN 'Show all failures' WHEN 'view' THEN 'Why did it break?'
                WHEN 'signup' THEN 'How do we avoid this?' ELSE concat('Who is user ', user_id, '?') END AS question
    FROM events)"""


def _questions(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    asked = (
        F.when(kind == "click", "What was the SEQUENCE of events?")
        .when(kind == "error", "Show all failures")
        .when(kind == "view", "Why did it break?")
        .when(kind == "signup", "How do we avoid this?")
        .otherwise(F.concat(F.lit("Who is user "), F.col("user_id").cast("string"), F.lit("?")))
    )
    return t.events.select(
        "event_id", F.date_format("ts", "yyyyMMdd").alias("incident_id"), asked.alias("question")
    )


def rule_analyses(t: Tables) -> DataFrame:
    return analysis.rule_based_analyses(metrics.error_stats(t.log_events))


@query(
    with_log(
        f"""
SELECT q.event_id, q.incident_id, q.question, {_INTENT_SQL.format(q="lower(q.question)")} AS intent,
       CASE {_INTENT_SQL.format(q="lower(q.question)")}
            WHEN 'timeline' THEN coalesce(concat('Warnings and errors among the first events:', chr(10), chr(10), k.lines),
                concat('Of ', a.n_events, ' events, the first ', least(a.n_events, 10), ' hold no warning and no error.'))
            WHEN 'error' THEN coalesce(concat('Found ', e.n, ' error events.', chr(10), chr(10), e.lines,
                CASE WHEN e.n > 5 THEN concat(chr(10), chr(10), e.n - 5, ' further errors are not shown') ELSE '' END),
                'None of the events has the level ERROR.')
            WHEN 'cause' THEN concat('Root cause as analysed: ', a.analysis)
            WHEN 'prevention' THEN concat(a.n_errors, ' of ', a.n_events, ' events were errors. An alert on that share,',
                ' per hour, would show the next such incident earlier.')
            ELSE concat('Your question was: "', q.question,
                        '". Ask about the timeline, the errors, the root cause or prevention.') END AS answer
FROM questions q
LEFT JOIN (SELECT incident_id, string_agg(concat('• ', {sql_second("timestamp")}, ' [', level, '] ', message), chr(10)
                                          ORDER BY rn) AS lines
           FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, seq) AS rn FROM log_events)
           WHERE rn <= 10 AND level IN ('ERROR', 'WARN', 'FATAL') GROUP BY 1) k USING (incident_id)
LEFT JOIN (SELECT incident_id, any_value(n) AS n,
                  string_agg(concat('• ', {sql_second("timestamp")}, ': ', message), chr(10) ORDER BY rn) AS lines
           FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, seq) AS rn,
                        count(*) OVER (PARTITION BY incident_id) AS n FROM log_events WHERE level = 'ERROR')
           WHERE rn <= 5 GROUP BY 1) e USING (incident_id)
LEFT JOIN (SELECT incident_id, concat('{{"summary":"Counted: ', count(*) FILTER (WHERE level = 'ERROR'),
                  ' errors, ', count(*), ' events.","root_cause_description":"', count(*) FILTER (WHERE level = 'ERROR'),
                  ' of ', count(*), ' events are errors; no single cause is named by rule.',
                  '","affected_components":["auth-service","database"],"confidence_score":0.85}}') AS analysis,
                  count(*) FILTER (WHERE level = 'ERROR') AS n_errors, count(*) AS n_events
           FROM log_events GROUP BY 1) a USING (incident_id)""",
        _QUESTIONS_SQL,
    )
)
def rule_answers(t: Tables) -> DataFrame:
    return answers.rule_answers(_questions(t), t.log_events, rule_analyses(t))


@query(
    with_log(
        f"""
SELECT incident_id, string_agg(concat({sql_second("timestamp")}, ' [', level, '] ', service, ': ', left(message, 100)),
                               chr(10) ORDER BY rn) AS summary
FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, seq) AS rn FROM log_events)
WHERE rn <= 20 GROUP BY 1"""
    )
)
def timeline_summaries(t: Tables) -> DataFrame:
    return context.timeline_summary(t.log_events)


@query(
    with_log(
        f"""
SELECT incident_id, (rn - 1) // 100 + 1 AS chunk, count(*) AS n_lines,
       md5(string_agg(concat({sql_second("timestamp")}, ' [', level, '] ', service, ': ', message), chr(10)
                      ORDER BY rn)) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, seq) AS rn FROM log_events)
GROUP BY 1, 2"""
    )
)
def root_cause_prompts(t: Tables) -> DataFrame:
    prompts = context.root_cause_prompts(t.log_events, lines_per_chunk=100)
    log = F.regexp_replace(F.col("prompt"), r"(?s)^.*?Log, part \d+ of \d+:\n", "")
    return prompts.select(
        "incident_id",
        "chunk",
        F.size(F.split(log, "\n")).cast("long").alias("n_lines"),
        F.md5(log).alias("digest"),
    )


@query(
    with_log(
        f"""
SELECT incident_id, md5(string_agg(concat({sql_second("timestamp")}, ' [', level, '] ', service, ': ', message),
                                   chr(10) ORDER BY rn)) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, seq) AS rn,
             count(*) OVER (PARTITION BY incident_id) AS n FROM log_events)
WHERE n > 5 AND rn > n - 30 GROUP BY 1"""
    )
)
def prediction_prompts(t: Tables) -> DataFrame:
    prompts = context.prediction_prompts(t.log_events)
    log = F.regexp_replace(F.col("prompt"), r"(?s)^.*?\nLog:\n", "")
    return prompts.select("incident_id", F.md5(log).alias("digest"))


@query(
    with_log(
        f"""
SELECT q.event_id, concat('Answer a question about an incident from the material below only.',
    chr(10), chr(10), 'Analysis:', chr(10), 'Analysis of ', q.incident_id,
    chr(10), chr(10), 'Errors by service:', chr(10), d.lines,
    chr(10), chr(10), 'Services in order of appearance: ', s.services,
    chr(10), chr(10), 'Timeline:', chr(10), t.lines,
    chr(10), chr(10), 'Question: ', q.question) AS prompt
FROM questions q
JOIN (SELECT incident_id, string_agg(concat('- ', service, ': ', n, ' errors'), chr(10) ORDER BY n DESC, f) AS lines
      FROM (SELECT incident_id, service, count(*) AS n, min((timestamp, seq)) AS f FROM log_events
            WHERE level IN ('ERROR', 'FATAL') GROUP BY 1, 2) GROUP BY 1) d USING (incident_id)
JOIN (SELECT incident_id, string_agg(service, ', ' ORDER BY f) AS services
      FROM (SELECT incident_id, service, min((timestamp, seq)) AS f FROM log_events GROUP BY 1, 2)
      GROUP BY 1) s USING (incident_id)
JOIN (SELECT incident_id, string_agg(concat({sql_second("timestamp")}, ' [', level, '] ', service, ': ',
                                            left(message, 100)), chr(10) ORDER BY rn) AS lines
      FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, seq) AS rn FROM log_events)
      WHERE rn <= 20 GROUP BY 1) t USING (incident_id)""",
        _QUESTIONS_SQL,
    )
)
def question_prompts(t: Tables) -> DataFrame:
    analyses = t.log_events.select("incident_id").distinct().select(
        "incident_id", F.concat(F.lit("Analysis of "), "incident_id").alias("analysis")
    )
    return context.question_prompts(_questions(t), t.log_events, analyses).select("event_id", "prompt")
