import datetime as dt
import random
import re

from pyspark.sql import functions as F

from faultline.functions import commands, json_text, levels, redact, text, tiers, timestamps
from faultline.operators.answers import question_intent, root_cause_line
from faultline.operators.trends import line_parts, problem_class

# --- redaction -------------------------------------------------------------

CASES = {
    "card 4111 1111 1111 1111 for": "card [CARD]for",
    "epoch 1705312200 x": "epoch [PHONE] x",
    "ms 1705312200000 x": "ms [CARD]x",
    "tel (555) 123-4567": "tel ([PHONE]",
    "tel +1 555 123 4567": "tel +[PHONE]",
    "password = hunter2 ok": "[REDACTED] ok",
    "Authorization: Bearer abc.def==": "Authorization: [REDACTED]",
    "token: Bearer abcdef123": "[REDACTED] abcdef123",
    "client_secret=abc": "client_secret=abc",
    "id 12345678901234567890": "id 12345678901234567890",
    "mail a.b+c@d-e.org now": "mail [EMAIL] now",
    "API-KEY: x1 and api_key=y2": "[REDACTED] and [REDACTED]",
    "plain": "plain",
    "": "",
}


def staged(spark, values, strict=False):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in redact.with_redacted(frame, "v", "r", strict).orderBy("i").collect()]


def test_redaction_by_hand(spark, column):
    assert column(redact.redact, list(CASES)) == list(CASES.values())
    assert staged(spark, list(CASES)) == list(CASES.values())


def test_redaction_equals_the_patterns_applied_in_turn(spark, column):
    """The guards that skip a pattern never change the outcome."""
    patterns = [
        (redact.EMAIL, "[EMAIL]", 0),
        (redact.PHONE.replace("(?U)", ""), "[PHONE]", 0),
        (redact.CARD.replace("(?U)", ""), "[CARD]", 0),
        (redact.SECRET.replace("(?iU)", ""), "[REDACTED]", re.I),
        (redact.BEARER.replace("(?iU)", ""), "[REDACTED]", re.I),
    ]
    rng = random.Random(7)
    pieces = ["a@b.co", "555", "-", " ", "1234", "123", "4111111111111", "token", "=", ":", "Bearer", "é", "x",
              "(", ")", ".", "+1", "api_key", "PASSWORD", "\n", "_", "0", "12", "\u017fecret", "to\u212aen", "\u0663"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    texts += ["".join(rng.choice("0123 -(.)") for _ in range(rng.randint(10, 30))) for _ in range(3000)]

    def plain(value):
        for pattern, mark, flags in patterns:
            value = re.sub(pattern, mark, value, flags=flags)
        return value

    expected = [plain(t) for t in texts]
    assert column(redact.redact, texts) == expected
    assert staged(spark, texts) == expected


def test_strict_redaction_closes_the_gaps(spark, column):
    values = ["token: Bearer abcdef123", "client_secret=abc", "epoch 1705312200 x", "tel 555-123-4567 a@b.co"]
    expected = ["[REDACTED]", "[REDACTED]", "epoch 1705312200 x", "tel [PHONE] [EMAIL]"]
    assert column(lambda c: redact.redact(c, strict=True), values) == expected
    assert staged(spark, values, strict=True) == expected


def test_metadata_redaction(spark):
    row = spark.range(1).select(
        redact.redact_metadata(F.create_map(F.lit("k"), F.lit("a@b.co"))).alias("m")
    ).first()
    assert row.m == {"k": "[EMAIL]"}


# --- timestamps and levels ---------------------------------------------------

AT = dt.datetime(2024, 1, 15, 10, 30)
TIMES = {
    "2024-01-15 10:30:00": AT,
    "2024-01-15T10:30:00": AT,
    "2024-01-15T10:30:00Z": AT,
    "2024-01-15T10:30:00.1": AT.replace(microsecond=100000),
    "2024-01-15T10:30:00.123Z": AT.replace(microsecond=123000),
    "15/01/2024 10:30:00": AT,
    "01/15/2024 10:30:00": AT,
    "03/04/2024 10:30:00": dt.datetime(2024, 4, 3, 10, 30),
    "5/1/2024 1:2:3": dt.datetime(2024, 1, 5, 1, 2, 3),
    "2024-1-5 1:2:3": dt.datetime(2024, 1, 5, 1, 2, 3),
    "2024-01-15": dt.datetime(2024, 1, 15),
    "2024-02-30 10:00:00": None,
    "2024-01-15 10:30:60": None,
    "2024-01-15T10:30:00+00:00": None,
    "2024-01-15T10:30:00.1234567": None,
    "": None,
    "not a date": None,
}


def test_timestamp_formats(column):
    assert column(timestamps.parse_timestamp, list(TIMES)) == list(TIMES.values())


def test_epoch_seconds(column):
    assert column(timestamps.parse_seconds, ["1705312200", "1705312200.5", "x", "99999999999999"]) == [
        dt.datetime(2024, 1, 15, 9, 50),
        dt.datetime(2024, 1, 15, 9, 50, 0, 500000),
        None,
        None,
    ]


def test_timestamp_in_text(column):
    assert column(
        timestamps.find_timestamp,
        ["2024-01-15 10:30:00 ERROR x", "[2024-01-15T10:30:00.9Z] boom", "at 99/99/2024 10:30:00", "none",
         "0000-01-01 10:00:00", "2024-02-30 10:00:00 or 2024-01-15T10:30:00", "01/15/2024 10:30:00"],
    ) == [AT, AT, None, None, None, AT, AT]


def test_levels(column):
    texts = ["2024 ERROR x", "WARN: y", "an INFO z", "FATAL", "DEBUG on", "error: a", "TERROR", "none",
             "INFO Error rate", "ERROR then FATAL", "WARNING only"]
    assert column(levels.level_by_priority, texts) == [
        "ERROR", "WARN", "INFO", "FATAL", "DEBUG", "ERROR", None, None, "ERROR", "FATAL", "WARNING"]
    assert column(levels.level_by_position, texts) == [
        "ERROR", "WARN", "INFO", "FATAL", "DEBUG", "ERROR", None, None, "INFO", "ERROR", "WARNING"]


def test_line_parts(spark):
    line = "2025-02-08T14:31:49Z INFO database: Query done: 2ms"
    row = spark.range(1).select(*[c.alias(n) for n, c in line_parts(F.lit(line)).items()]).first()
    assert tuple(row) == ("INFO", "database", "Query done: 2ms")


# --- text ------------------------------------------------------------------


def test_percent_text_rounds_as_exact_binary(column):
    values = [0.125, 0.385, 0.3896, 0.005, 0.0, 1.0, 0.87]
    assert column(text.percent_text, values, "double") == ["12%", "38%", "39%", "0%", "0%", "100%", "87%"]
    rng = random.Random(3)
    many = [round(rng.random(), rng.randint(1, 5)) for _ in range(3000)] + [i / 2000 for i in range(2000)]
    for decimals in (0, 1):
        found = column(lambda c: text.percent_text(c, decimals), many, "double")
        assert found == [f"{v:.{decimals}%}" for v in many]


def test_strip_takes_unicode_space(column):
    assert column(text.strip, ["  x\t\r\n", "  ", "a b"]) == ["x", "", "a b"]


def test_lists_and_tags(spark):
    row = spark.range(1).select(
        text.bullet_list(F.array(F.lit("a"), F.lit("b")), "- ").alias("bullets"),
        text.numbered_list(F.array(F.lit("a"), F.lit("b"))).alias("numbers"),
        text.before_tag(F.lit("svc [CRITICAL]")).alias("tag"),
        text.escape_pipe(F.lit("a|b")).alias("pipe"),
    ).first()
    assert tuple(row) == ("- a\n- b", "1. a\n2. b", "svc", "a\\|b")


# --- JSON in text ----------------------------------------------------------


def test_validity(column):
    values = ['{"a":1}', '{"a":1} x', '{"a":1}\n{"b":2}', "[1,2]", "1,2", "{}] {}", "", "x", '{"a":1,"a":2}', "1],[2"]
    assert column(json_text.is_json, values) == [True, False, False, True, False, False, False, False, True, False]


def test_json_block(column):
    values = ['{"a":1}', 'say {"a":1} end', "say {\na} end", "no", "", None, "} {"]
    assert column(json_text.json_block, values) == ['{"a":1}', '{"a":1}', "{ a}", "no", "{}", "{}", "} {"]


def test_four_strategies(spark):
    values = [
        'x ```json\n{"a": {"b": 1}}\n``` y {"z": 2}',
        'text {"a": {"b": 1}} and {"c": 2}',
        '} {"a": 1}',
        '[1, 2]',
        "nothing",
        "y" * 600,
        '{"bad": } then {"a": 1}',
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    found = [r.f for r in json_text.extract_json(df, "t", "f").orderBy("i").collect()]
    assert found[:4] == ['{"a": {"b": 1}}', '{"a": {"b": 1}}', '{"a": 1}', "[1, 2]"]
    assert '"raw_response":"nothing"' in found[4]
    assert "y" * 500 + "..." in found[5] and "y" * 501 not in found[5]
    assert '"error"' in found[6]


def test_analysis_parsing(spark):
    values = [
        'Sure: {"summary": "s", "root_cause_description": "r", "affected_components": ["a"], "confidence_score": 0.87}',
        "z" * 600,
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, analysis string")
    good, plain = json_text.with_analysis(df).orderBy("i").collect()
    assert good["_a"].confidence_score == 0.87 and good["_a"].affected_components == ["a"] and good["_a_ok"]
    assert plain["_a"].summary == "z" * 500 and plain["_a"].confidence_score is None and not plain["_a_ok"]


def test_fences(column):
    assert column(json_text.strip_fences, ["```json\n{}\n```\n\n \n\nend "]) == ["{}\n\nend"]


# --- tiers, names, intents -------------------------------------------------


def test_tiers(column):
    scores = [1.0, 0.85, 0.8499, 0.7, 0.6999, 0.5, 0.4999, 0.0]
    assert column(tiers.severity_of_confidence, scores, "double") == [
        "critical", "critical", "high", "high", "medium", "medium", "low", "low"]
    assert column(tiers.priority_of_confidence, scores, "double") == [
        "Highest", "Highest", "High", "High", "Medium", "Medium", "Low", "Low"]
    assert column(tiers.display_of_confidence, [0.8, 0.6, 0.59], "double") == ["green", "yellow", "red"]
    assert column(tiers.priority_of_severity, ["CRITICAL", "low", "odd", None]) == ["Highest", "Low", "High", "High"]
    assert column(tiers.colour_of_severity, ["high", "odd"]) == ["#ff6347", "#808080"]
    assert column(tiers.known_severity, ["HIGH", "odd", None]) == ["high", "medium", "medium"]
    assert column(tiers.valid_confidence, [0.0, 1.0, 1.1, -0.1, None], "double") == [True, True, False, False, False]


def test_ranks(column):
    assert column(levels.level_rank, ["debug", "INFO", "WARNING", "ERROR", "CRITICAL", "odd"]) == [0, 1, 2, 3, 4, None]


def test_names_and_actions(column):
    assert column(commands.clean_name, ["auth;rm -rf /", "pay_ment-1", "dienst-ü"]) == ["authrm-rf", "payment-1", "dienst-ü"]
    assert column(commands.remediation_action, ["a nullable field", "Memory leak", "v2 was Deployed", "pool"]) == [
        "undo", "restart", "undo", "restart"]
    assert column(commands.first_known_service, ["Payment-service and auth-service", "x"]) == ["auth-service", "auth-service"]


def test_intents(column):
    asked = ["When did it fail?", "Show FAILED calls", "Why?", "How to avoid it", "Hello", "error order"]
    assert column(question_intent, asked) == ["timeline", "error", "cause", "prevention", "other", "timeline"]


def test_root_cause_line(column):
    found = column(root_cause_line, ['{\n  "root_cause_description": "x"\n}', "nothing"])
    assert found[0] == 'Root cause as analysed: "root_cause_description": "x"'
    assert found[1] == "No cause is named in the analysis."


def test_problem_class(column):
    assert column(problem_class, ["heap at 90%", "Disk full", "fine"]) == ["memory_leak", "disk_space", None]
