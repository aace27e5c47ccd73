import json
import random

import pytest
from pyspark.sql import functions as F

from faultline.functions.json_text import with_analysis
from faultline.operators import alerts, analysis, answers, context, metrics, outbox, remediation, reports, sessions, trends
from faultline.operators import timeline as tl


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def rates(make_events, errors, total):
    return make_events([("i", n, "ERROR" if n < errors else "INFO", f"s{n % 2}", "m") for n in range(total)])


@pytest.mark.parametrize(
    "errors,total,severity",
    [(0, 20, None), (3, 20, None), (4, 20, "high"), (5, 20, "high"), (6, 20, "critical"), (20, 20, "critical")],
)
def test_threshold_alerts(make_events, errors, total, severity):
    found = alerts.error_rate_alerts(rates(make_events, errors, total), now()).collect()
    assert [r.severity for r in found] == ([severity] if severity else [])


def test_alert_content(make_events):
    events = make_events([("i", 3, "error", "b", "m"), ("i", 1, "INFO", "a", "m"), ("i", 2, "ERROR", "c", "m"),
                          ("i", 4, "ERROR", None, "m"), ("i", 5, "ERROR", "b", "m")])
    (alert,) = alerts.error_rate_alerts(events, now()).collect()
    assert alert.affected_services == ["c", "b"]
    assert alert.description == "Share of errors above the limit: 80%"
    assert alert.trend.current_value == 0.8 and alert.trend.time_window_minutes == 5
    assert alert.recommended_actions == ["Begin with c, the first to fail", "Find what changed before these 4 errors"]


def test_fatal_counts_in_the_context_but_not_in_the_rate(make_events):
    events = make_events([("i", 1, "FATAL", "a", "m"), ("i", 2, "ERROR", "b", "m"), ("i", 3, "INFO", "", "m")])
    assert metrics.error_stats(events).first().n_errors == 1
    row = metrics.incident_context(events).first()
    assert row.error_clusters == {"a": 1, "b": 1} and row.service_topology == ["a", "b"]


def test_errors_per_service_order(make_events):
    events = make_events([("i", 1, "ERROR", "late", "m"), ("i", 2, "ERROR", "most", "m"), ("i", 3, "FATAL", "most", "m"),
                          ("i", 4, "ERROR", "later", "m")])
    found = metrics.errors_per_service(events).orderBy("rank").collect()
    assert [(r.service, r.n) for r in found] == [("most", 2), ("late", 1), ("later", 1)]


def test_slices_keep_the_first_events(make_events):
    events = make_events([("i", n, "ERROR" if n % 2 else "INFO", "s", f"m{n}") for n in range(1, 61)] + [("j", 1, "WARN", "s", "x")])
    assert {r.message for r in context.first_events(events, 25).filter("incident_id = 'i'").collect()} == {f"m{n}" for n in range(1, 26)}
    tail = context.prediction_tail(events).orderBy("rn").collect()
    assert [r.message for r in tail] == [f"m{n}" for n in range(31, 61)]
    assert context.key_events(events).filter("incident_id = 'i'").count() == 5
    shown = context.first_errors(events).orderBy("rn").collect()
    assert [r.message for r in shown] == ["m1", "m3", "m5", "m7", "m9"] and shown[0].more == 25
    assert metrics.truncation_notice(events, 50).filter("truncated").first().original_count == 60


def test_seq_is_a_total_order_whatever_the_partitions(spark, make_events):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(1, 9)}", rng.randint(1, 40), "INFO", "s", str(n)) for n in range(3000)]
    events = make_events(rows).repartition(7)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "4", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found = tl.sorted_timeline(events.withColumnRenamed("seq", "at"), ["timestamp", "at"])
            results.append(sorted((r.incident_id, r.seq, r.at) for r in found.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    expected = []
    for key in {r[0] for r in rows}:
        mine = sorted((r[1], n) for n, r in enumerate(rows, 1) if r[0] == key)
        expected += [(key, place, n) for place, (_, n) in enumerate(mine, 1)]
    assert results[0] == results[1] == results[2] == sorted(expected)


def test_events_before(make_events):
    rng = random.Random(5)
    rows = [("hot", n, "FATAL" if rng.random() < 0.1 else "INFO", "s", f"m{n}") for n in range(300)]
    found = sessions.events_before(make_events(rows), F.col("level") == "FATAL", 3).collect()
    expected = {(n, d, f"m{n - d}") for n, r in enumerate(rows) if r[2] == "FATAL" for d in (1, 2, 3) if n - d >= 0}
    assert {(r.seq - 1, -r.before_offset, r.before_message) for r in found} == expected


def test_error_sessions_against_a_loop(make_events):
    rng = random.Random(9)
    rows = [("i", rng.randint(0, 200_000), rng.choice(["ERROR", "FATAL", "INFO"]), rng.choice("ab"), "m") for _ in range(400)]
    rows += [("i", 500_000, "ERROR", "c", "m"), ("i", 501_800, "ERROR", "c", "m"), ("i", 503_601, "ERROR", "c", "m")]
    expected = []
    for service in "abc":
        times = sorted(r[1] for r in rows if r[3] == service and r[2] != "INFO")
        runs = [[times[0]]]
        for t in times[1:]:
            if t - runs[-1][-1] > 1800:
                runs.append([])
            runs[-1].append(t)
        expected += [(service, i, run[0], run[-1], len(run)) for i, run in enumerate(runs, 1)]
    found = sessions.error_sessions(make_events(rows)).select(
        "service", "session", F.unix_timestamp("started_at"), F.unix_timestamp("ended_at"), "n_errors").collect()
    assert sorted(tuple(r) for r in found) == sorted(expected)


def test_alert_life_cycle(spark):
    series = [0.1, 0.2, 0.3, 0.1, 0.2]
    frame = spark.createDataFrame([("s", n, v) for n, v in enumerate(series)], "service string, window_start long, error_rate double")
    found = alerts.alert_life_cycle(frame, ["service"]).orderBy("opened_at").collect()
    assert [(r.opened_at, r.resolved_at, r.n_windows, r.peak_rate) for r in found] == [(1, 3, 2, 0.3), (4, None, 1, 0.2)]


def test_metric_points_and_growth(make_events):
    events = make_events([("i", 0, "INFO", "s", "heap 245MB/512MB (48%)"), ("i", 3600, "INFO", "s", "heap 345MB/512MB"),
                          ("i", 7200, "INFO", "s", "heap 100MB/512MB"), ("i", 10, "WARN", "d", "Pool status: 49/50 connections active"),
                          ("i", 20, "WARN", "g", "latency p99=900ms"), ("i", 30, "WARN", "d", "Disk usage at 95%")])
    points = trends.metric_points(events)
    assert {(r.metric, r.value, r.capacity) for r in points.collect()} == {
        ("memory_leak", 245, 512), ("memory_leak", 345, 512), ("memory_leak", 100, 512),
        ("connection_pool_exhaustion", 49, 50), ("rising_latency", 900, None), ("disk_usage_growth", 95, None)}
    runs = trends.growth_runs(trends.metric_windows(points, "1 hour", ["service"]), ["service", "metric"])
    heap = runs.filter("metric = 'memory_leak'").orderBy("run").collect()
    assert [(r.n_windows, r.peak, r.per_hour) for r in heap] == [(2, 345.0, 100.0), (1, 100.0, None)]


# --- analyses and remediation ------------------------------------------------


def test_rule_based_analysis_is_valid_and_counts(make_events):
    events = make_events([("i", 1, "ERROR", "a", "m"), ("i", 2, "ERROR", "a", "m"), ("i", 3, "FATAL", "a", "m"), ("i", 4, "INFO", "a", "m")])
    body = json.loads(analysis.rule_based_analyses(metrics.error_stats(events)).first().analysis)
    assert "2 errors, 4 events" in body["summary"] and 0 <= body["confidence_score"] <= 1


def test_completion_retries_and_falls_back(spark):
    class ThrottlingException(Exception):
        pass

    def reply(prompt):
        if prompt == "slow":
            import time

            time.sleep(5)
        if prompt == "busy":
            raise ThrottlingException("slow down")
        if prompt == "broken":
            raise ValueError("no")
        return {"good": 'x {"summary": "s"}', "odd": "Error: {}", "prose": "just words"}[prompt]

    prompts = spark.createDataFrame([(p, p) for p in ("good", "odd", "prose", "busy", "broken", "slow")], "incident_id string, prompt string")
    replies = analysis.complete(prompts, reply, pause=0.01, time_limit=1.0)
    by_id = {r.incident_id: r.reply for r in replies.collect()}
    assert by_id["busy"].startswith("Error:") and by_id["broken"] == "Error: no"
    assert by_id["slow"] == "Error: timeout"
    fallback = prompts.select("incident_id", F.lit('{"summary":"rule"}').alias("analysis"))
    chosen = {r.incident_id: r.from_reply for r in analysis.choose_analysis(replies, fallback).collect()}
    assert chosen == {"good": True, "odd": False, "prose": False, "busy": False, "broken": False, "slow": False}


def test_remediation(spark):
    texts = [
        '{"root_cause_description": "release 2 has a bug", "affected_components": ["pay;ment [CRITICAL]", "x"]}',
        '{"root_cause_description": "memory leak", "affected_components": []}',
        "the user-service was deployed badly",
    ]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, analysis string")
    assert [r.command for r in remediation.with_remediation(frame).orderBy("i").collect()] == [
        "kubectl rollout undo deployment/payment -n default",
        "kubectl rollout restart deployment/auth-service -n default",
        "kubectl rollout undo deployment/user-service -n default",
    ]


def test_requests_are_checked(spark):
    rows = [("scale", "api", "prod", 3), ("scale", "api", "prod", -1), ("restart", "  ", "prod", 0), ("rollback", "a/b", "p d", 0)]
    frame = spark.createDataFrame(rows, "tool string, service string, namespace string, replicas int")
    good, bad = remediation.split_requests(frame)
    assert {r.reason for r in bad.collect()} == {"negative replicas", "empty service name"}
    assert {r.command for r in remediation.request_commands(good).collect()} == {
        "kubectl scale deployment/api --replicas=3 -n prod", "kubectl rollout undo deployment/ab -n pd"}


def test_predicted_alert_defaults(spark):
    replies = spark.createDataFrame([("a", 'x {"issue_detected": true}'), ("b", '{"issue_detected": false}'), ("c", "safe")], "incident_id string, reply string")
    from faultline.functions.json_text import with_prediction

    (found,) = alerts.predicted_alerts(with_prediction(replies), now()).collect()
    assert (found.incident_id, found.severity, found.affected_services) == ("a", "medium", ["unknown"])
    assert found.trend.confidence == 0.7 and found.trend.time_window_minutes == 15


# --- reports and outbox --------------------------------------------------------


@pytest.fixture
def analysed(spark):
    body = {"summary": "S", "root_cause_description": "R", "affected_components": ["a", "b"], "confidence_score": 0.87,
            "remediation_steps": ["one", "two"]}
    return spark.createDataFrame([("i", json.dumps(body), "do it"), ("j", "prose only", "")], "incident_id string, analysis string, command string")


def test_markdown_report(make_events, analysed):
    events = make_events([("i", n, "INFO", "s", f"m|{n}" + "x" * 100) for n in range(30)])
    history = events.sparkSession.createDataFrame([("i", n, f"q{n}", "a" * 400, None) for n in range(1, 1002)],
                                                  "incident_id string, rn long, question string, answer string, timestamp string")
    found = reports.markdown_reports(analysed, events, now(), history).collect()
    parts = {(r.incident_id, r.part): r.report for r in found}
    text = parts["i", 1]
    assert "87.0%" in text and "1. one\n2. two" in text and text.count("\n| 1970") == 25 and "m\\|0" in text
    assert "> " + "a" * 300 + "\n" in text and "a" * 301 not in text
    assert sum(t.count("**Q:**") for t in parts.values()) == 1001 and {p for _, p in parts} == {1, 2, 3}
    assert "prose only" in parts["j", 1] and "- Unknown" in parts["j", 1]


def test_json_report_round_trip(make_events, analysed):
    events = make_events([("i", n, "INFO", "s", f'm "{n}"') for n in range(60)])
    found = {r.incident_id: json.loads(r.report) for r in reports.json_reports(analysed, events, now()).collect()}
    assert [e["message"] for e in found["i"]["timeline"]] == [f'm "{n}"' for n in range(50)]
    assert found["i"]["root_cause"] == {"description": "R", "confidence_score": 0.87}
    assert found["i"]["remediation"] == {"command": "do it", "steps": ["one", "two"]}
    assert found["j"]["summary"] == "prose only" and found["j"]["timeline"] == []


def test_tickets(analysed):
    text = {r.incident_id: r.ticket for r in reports.tickets(analysed, now()).collect()}
    assert "• a\n• b" in text["i"] and "• unknown" in text["j"]


def test_payloads(spark, make_events, analysed):
    found = alerts.error_rate_alerts(rates(make_events, 10, 20), now())
    sent = json.loads(outbox.chat_alerts(found).first().payload)
    assert sent["channel"] == "#incidents" and sent["attachments"][0]["color"] == "#dc143c"
    blocks = sent["attachments"][0]["blocks"]
    assert [b["type"] for b in blocks] == ["header", "section", "section", "section"]
    assert blocks[0]["text"]["type"] == "plain_text" and blocks[1]["fields"][0]["text"] == "*Grade*\nCRITICAL"
    body = spark.createDataFrame([("i", "x" * 5000)], "incident_id string, report string")
    chat = json.loads(outbox.chat_reports(body, now()).first().payload)
    assert len(chat["blocks"][1]["text"]["text"]) == 3000
    issue = found.select("incident_id", F.lit("s").alias("summary"), "description", "severity",
                         F.lit(None).cast("array<string>").alias("services"), F.array(F.lit("fix")).alias("steps"))
    row = outbox.issues(issue, now()).first()
    fields = json.loads(row.payload)["fields"]
    assert fields["priority"]["name"] == "Highest" and "* N/A" in fields["description"] and "# fix" in fields["description"]
    assert row.mode == "dry_run" and row.key.startswith("INC-")
    usage = spark.createDataFrame([("i", 130)], "incident_id string, used long")
    responses = {r.incident_id: json.loads(r.response) for r in outbox.analysis_responses(analysed, usage).collect()}
    assert responses["i"]["trial_remaining"] == 0 and responses["j"]["trial_remaining"] == 100
    status = json.loads(outbox.status_responses(metrics.scan_status(found.select("incident_id"), rates(make_events, 10, 20)), found).first().response)
    assert status["status"] == "success" and status["abnormal_trends"][0]["type"] == "increasing_errors"


def test_scenario_responses(spark, analysed):
    catalogue = spark.createDataFrame([("i", "Pool", "high")], "scenario string, name string, severity string")
    asked = analysed.withColumnRenamed("incident_id", "scenario")
    (row,) = outbox.scenario_responses(asked, catalogue).collect()
    body = json.loads(row.response)
    assert body["demo"] and body["metadata"] == {"name": "Pool", "severity": "high"}
    assert body["analysis"]["confidence_score"] == 0.87 and body["remediation_command"] == "do it"


# --- questions ------------------------------------------------------------------


def test_rule_answers(spark, make_events):
    events = make_events([("i", n, "ERROR" if n < 7 else "INFO", "s", f"m{n}") for n in range(12)])
    asked = spark.createDataFrame([("i", "show errors"), ("i", "timeline?"), ("k", "any failure?"), ("i", "why")], "incident_id string, question string")
    analyses = spark.createDataFrame([("i", '{"root_cause_description": "x"}')], "incident_id string, analysis string")
    found = {(r.incident_id, r.intent): r.answer for r in answers.rule_answers(asked, events, analyses).collect()}
    assert found["i", "error"].startswith("Found 7 error events") and "2 further errors" in found["i", "error"]
    assert found["i", "timeline"].count("•") == 7
    assert "no events" in found["k", "error"] and found["i", "cause"].startswith("Root cause as analysed")


def test_pairs_and_recent(spark):
    turns = spark.createDataFrame(
        [(1, 1, "system", "s"), (1, 5, "user", "q1"), (1, 9, "assistant", "a1" * 200), (1, 10, "user", "q2"), (1, 11, "user", "q3"),
         (1, 12, "assistant", "a3"), (2, 1, "user", "alone")], "conv_id long, turn long, role string, text string")
    pairs = context.question_answer_pairs(turns)
    assert {(r.question, r.answer[:2]) for r in pairs.collect()} == {("q1", "a1"), ("q3", "a3")}
    assert [len(r.answer) for r in context.recent_answers(pairs).orderBy("rn").collect()] == [200, 2]
    exported = {(r.conv_id, r.part): r for r in context.conversation_export(turns, pairs_per_part=1).collect()}
    assert [h.question for h in exported[1, 2].history] == ["q3"] and exported[1, 1].questions_count == 3
    assert exported[2, 1].history is None


def test_prompts_hold_everything(spark, make_events):
    events = make_events([("i", n, "ERROR" if n % 3 == 0 else "INFO", f"s{n % 2}", f"m{n}") for n in range(50)])
    prompts = context.root_cause_prompts(events, lines_per_chunk=20).orderBy("chunk").collect()
    sizes = [sum(f": m{n}\n" in p.prompt + "\n" for n in range(50)) for p in prompts]
    assert sizes == [20, 20, 10]
    text = "\n".join(p.prompt for p in prompts)
    assert all(f": m{n}\n" in text + "\n" for n in range(50))
    questions = spark.createDataFrame([("i", "what?"), ("z", "else?")], "incident_id string, question string")
    analyses = spark.createDataFrame([("i", "the analysis")], "incident_id string, analysis string")
    recent = spark.createDataFrame([("i", 1, "old", "ans")], "incident_id string, rn long, question string, answer string")
    found = {r.incident_id: r.prompt for r in context.question_prompts(questions, events, analyses, recent).collect()}
    for piece in ("the analysis", "- s0: 9 errors", "appearance: s0, s1", "Question: what?", "Q: old\nA: ans..."):
        assert piece in found["i"]
    assert "no events" in found["z"]


def test_confidence_split_and_sessions(spark):
    frame = spark.createDataFrame([(0.5,), (1.2,), (None,)], "confidence_score double")
    good, bad = analysis.split_by_confidence(frame)
    assert (good.count(), bad.count()) == (1, 2)
    stored = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "session_id string, analysis string, created_at long")
    asked = spark.createDataFrame([(1, "a"), (2, None), (3, "zz")], "request long, session_id string")
    found = {r.request: (r.session_id, r.analysis) for r in metrics.session_or_latest(asked, stored, ["created_at"]).collect()}
    assert found == {1: ("a", "x"), 2: ("b", "y"), 3: ("zz", None)}


def test_scan_status_and_services(spark, make_events):
    events = make_events([("i", 1, "INFO", "known", "m"), ("i", 2, "INFO", "odd", "m")])
    incidents = spark.createDataFrame([("i",), ("none",)], "incident_id string")
    assert {r.incident_id: r.status for r in metrics.scan_status(incidents, events).collect()} == {"i": "success", "none": "no_data"}
    known = spark.createDataFrame([("known",)], "service string")
    assert {r.service: r.exists for r in metrics.known_service_check(events, known).collect()} == {"known": True, "odd": False}
    assert [r.service for r in metrics.known_service_check(events, known, "left_semi").collect()] == ["known"]


def test_analysis_struct_has_all_fields(analysed):
    assert with_analysis(analysed).schema["_a"].dataType.fieldNames()[:4] == [
        "summary", "root_cause_description", "affected_components", "confidence_score"]
