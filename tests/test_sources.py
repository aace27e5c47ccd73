import csv
import io
import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.operators import timeline
from faultline.sources import files, fragments, growing, scenarios
from faultline.sources.numbering import number_records


def as_of():
    return F.lit("2030-01-01").cast("timestamp")


def read(spark, *paths, **options):
    raw = files.raw_rows(spark, [str(p) for p in paths], **options)
    return timeline.to_events(raw, as_of()), timeline.quarantined(raw)


EVENT = {"timestamp": "2024-01-15T10:30:00", "level": "ERROR", "service": "auth-service", "message": "boom"}


def test_json_document_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([EVENT, dict(EVENT, level="WARN"), 5], indent=1))
    (tmp_path / "o.json").write_text(json.dumps(EVENT, indent=2))
    (tmp_path / "l.json").write_text(json.dumps(EVENT) + "\n\n" + json.dumps(EVENT))
    (tmp_path / "m.jsonl").write_text('{"timestamp": "2024-01-15", "broken": true\n{"level": "ERROR", "message": "t"}\nno')
    events, bad = read(spark, tmp_path)
    by_file = {r[0].rsplit("/", 1)[1]: r[1] for r in events.groupBy("source_file").count().collect()}
    assert by_file == {"a.json": 2, "o.json": 1, "l.json": 2, "m.jsonl": 1}
    assert sorted((r.line_number, r.reason) for r in bad.collect()) == [
        (1, "invalid JSON"), (3, "invalid JSON"), (3, "not a JSON object")]


def test_nothing_of_a_large_file_is_lost(spark, tmp_path):
    good = json.dumps(EVENT) + "\n"
    (tmp_path / "a.jsonl").write_text("no json\n" + good * 50)
    (tmp_path / "b.json").write_text("\n" * 1500 + "broken {\n" + good * 30)
    (tmp_path / "c.json").write_text(json.dumps([EVENT, EVENT], indent=1))
    raw = files.raw_json(spark, [str(tmp_path)])
    found = {}
    for r in raw.collect():
        key = (r.source_file.rsplit("/", 1)[1], r.reason)
        found[key] = found.get(key, 0) + 1
    assert found == {("a.jsonl", "invalid JSON"): 1, ("a.jsonl", None): 50, ("b.json", "invalid JSON"): 1,
                     ("b.json", None): 30, ("c.json", None): 2}


def documents(rng, n):
    """Events with what upsets a reader of braces: strings with braces, quotes and escapes, nested values."""
    texts = ['plain', 'a } b', '{"x": 1}', 'say \\"hi\\" {', 'back\\\\', '}}}{{{', '[', '],', 'é 你 😀', 'tab\t\nline', '']
    return [
        {"timestamp": "2024-01-15T10:30:00", "level": rng.choice(["ERROR", "WARN"]), "service": "s", "n": i,
         "message": rng.choice(texts), "more": rng.choice([{}, {"a": {"b": [1, {"c": "}"}]}}, [], [{"d": 1}], None, 1.5])}
        for i in range(n)
    ]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("split", [97, 1024, 1 << 20])
def test_one_document_read_by_many_tasks(spark, tmp_path, indent, split):
    events = documents(random.Random(split), 300)
    (tmp_path / "a.json").write_text(json.dumps(events, indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text("  \n" + json.dumps(events[:7], indent=indent) + "\n\n")
    (tmp_path / "c.json").write_text("\n".join(json.dumps(e) for e in events[:50]))
    (tmp_path / "o.json").write_text(json.dumps(events[0] | {"inner": events[:20]}, indent=indent))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        raw = files.raw_json(spark, [str(tmp_path)]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert not [r for r in raw if r.reason]
    found = {}
    for r in raw:
        found.setdefault(r.source_file.rsplit("/", 1)[1], []).append((r.line_number, int(r.fields["n"]), r.fields["message"]))
    want = [(i + 1, i, e["message"]) for i, e in enumerate(events)]
    assert sorted(found.pop("a.json")) == want
    assert sorted(found.pop("b.json")) == want[:7]
    assert sorted(found.pop("c.json")) == want[:50]
    assert found == {"o.json": [(1, 0, events[0]["message"])]}


@pytest.mark.parametrize(
    ("text", "good", "bad"),
    [
        ("[]", 0, 0), ("[ \n ]", 0, 0), ("{}", 1, 0), ("[1, 2]", 0, 2), ('[1, {"n":1}, "x", {"n":2}, [{"n":3}]]', 2, 3),
        ('[{"n":1}', 0, 1), ('[{"n":1},]', 0, 1), ('[{"n":1}{"n":2}]', 0, 1), ('[{"n":1}]x', 0, 1), ('{"n":1}\n{"n":2}', 2, 0),
        ('{"n":1\n{"n":2}', 1, 1), ('[{"n":1},\n{"n":2}', 1, 1), ('{"n":1}}', 0, 1), ('{"n":{"m":1}', 0, 1), ('["a}", {"n":"b}"}]', 1, 1),
        ("", 0, 0), (" \n ", 0, 0), ("]", 0, 1), ("}", 0, 1), ('[{"a":"x\ny"}]', 0, 2), ('{"n":1}\n', 1, 0), ('[{"n":1}]\n[{"n":2}]', 0, 2),
    ],
)
def test_what_is_a_document(spark, tmp_path, text, good, bad):
    (tmp_path / "x.json").write_text(text)
    rows = files.raw_json(spark, [str(tmp_path)]).collect()
    assert (sum(r.reason is None for r in rows), sum(r.reason is not None for r in rows)) == (good, bad)


def test_the_last_of_a_repeated_key_counts(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"level":"INFO","message":"a","level":"ERROR","message":null}\n{"level":"WARN"}')
    rows = {r.line_number: r.fields for r in files.raw_json(spark, [str(tmp_path)]).collect()}
    assert rows == {1: {"level": "ERROR", "message": None}, 2: {"level": "WARN"}}


def test_csv_of_all_kinds(spark, tmp_path):
    (tmp_path / "app[1].csv").write_text('level,message\nERROR,"line one\nline ""two"""\nWARN,plain\n')
    (tmp_path / "twice.csv").write_text("level,message,message\nERROR,a,b\n")
    (tmp_path / "more.csv").write_text("level,message\nERROR,a,b,c,d\nINFO\nWARN,x\n")
    events, bad = read(spark, tmp_path)
    rows = {(r.source_file.rsplit("/", 1)[1], r.level, r.message) for r in events.collect()}
    assert ("app%5B1%5D.csv", "ERROR", 'line one\nline "two"') in rows or ("app[1].csv", "ERROR", 'line one\nline "two"') in rows
    assert ("twice.csv", "ERROR", "a") in rows and ("more.csv", "WARN", "x") in rows
    assert len(rows) == 5
    assert [(r.raw, r.reason) for r in bad.collect()] == [("ERROR,a,b,c,d", "more fields than the header")]


@pytest.mark.parametrize("split", [50, 300, 1 << 20])
def test_quoted_line_breaks_read_by_many_tasks(spark, tmp_path, split):
    rng = random.Random(split)
    cells = ['plain', 'two\nlines', 'a "quote"', 'comma, here', '\n\n', 'x\n"\ny', '', ' lead', '"', 'é\n你']
    rows = [[str(i), rng.choice(cells), rng.choice(cells)] for i in range(200)]
    for name, header, end in (("a.csv", ["seq", "message", "app"], "\n"), ("b.csv", ["seq", "msg\nof", "app"], "\r\n")):
        with open(tmp_path / name, "w", newline="") as out:
            writer = csv.writer(out, lineterminator=end)
            writer.writerow(header)
            for n, row in enumerate(rows):
                writer.writerow(row)
                if n % 7 == 0:
                    out.write(end)
    (tmp_path / "open.csv").write_text('seq,message\n1,ok\n2,"never closed\n3,x\n')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = {}
        for r in files.raw_csv(spark, [str(tmp_path)]).collect():
            assert r.reason is None
            found.setdefault(r.source_file.rsplit("/", 1)[1], {})[r.line_number] = r.fields
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(found) == {"a.csv", "b.csv", "open.csv"}
    for name, header in (("a.csv", ["seq", "message", "app"]), ("b.csv", ["seq", "msg\nof", "app"])):
        assert sorted(found[name]) == list(range(1, 201))
        for i, row in enumerate(rows):
            assert [found[name][i + 1][h] or "" for h in header] == row
    assert found["open.csv"][1] == {"seq": "1", "message": "ok"} and len(found["open.csv"]) == 2
    assert found["open.csv"][2]["message"].startswith("never closed")


def test_growing_files(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    rng = random.Random(1)
    lines = [f"{i} " + "x" * rng.choice([0, 3, 40, 300]) + rng.choice(["", "\r", " é你"]) for i in range(400)]
    whole = "".join(line + "\n" for line in lines).encode()

    def trigger():
        growing.follow_text(spark, str(folder), split_bytes=97).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", state
        ).trigger(availableNow=True).start().awaitTermination()

    def seen(name="a.log"):
        rows = spark.read.parquet(out).filter(F.col("source_file").endswith(name)).orderBy("position").collect()
        return [r.line for r in rows]

    # Nothing whole yet; the middle of a character and of a line; then nothing new; then all.
    for n in (0, 5, 1001, 1001, 7777, 7778, len(whole)):
        (folder / "a.log").write_bytes(whole[:n])
        trigger()
        assert seen() == [x.strip() for x in whole[: whole[:n].rfind(b"\n") + 1].decode().split("\n") if x.strip()]
    (folder / "sub").mkdir()
    (folder / "sub" / "b.TXT").write_text("one\n\ntwo\nnever ended")
    (folder / "c.json").write_text("{}\n")
    # A file begun anew is read from its start.
    (folder / "a.log").write_text("again\n")
    trigger()
    assert sorted(seen("b.TXT")) == ["one", "two"]
    assert sorted(seen()) == sorted([x.strip() for x in lines if x.strip()] + ["again"])
    assert not seen("c.json")


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_ranges_give_each_line_once(size):
    data = b"a\n\nbcd\nefghijklmnop\n\n\nq\nrs\n"
    for floor in (0, 2, 7):
        parts = [growing.Range("f", at, min(at + size, len(data)), floor, len(data)) for at in range(floor, len(data), size)]
        found = [p for part in parts for ps, ls in growing.lines_of(io.BytesIO(data), part) for p in zip(ps, ls, strict=True)]
        want, at = [], floor
        for line in data[floor:].split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        assert found == want


def test_hidden_files_are_reported(spark, tmp_path):
    (tmp_path / "_app.log").write_text("ERROR x")
    (tmp_path / ".h.log").write_text("ERROR y")
    (tmp_path / "a.log").write_text("ERROR z")
    events, bad = read(spark, tmp_path)
    assert events.count() == 1
    assert sorted(r.source_file.rsplit("/", 1)[1] for r in bad.filter("reason = 'hidden file name'").collect()) == [".h.log", "_app.log"]


def test_csv_headers_and_cells(spark, tmp_path):
    (tmp_path / "x y.csv").write_text('timestamp,level,service,message\n2024-01-15 10:30:00,ERROR,db,"Disk, ""95%"""\n\n'
                                      '1705312200,WARN,db\n2024-01-15 10:30:00,INFO,db,a,b\n')
    (tmp_path / "z.csv").write_text("time,msg,extra\n2024-01-15 10:30:00,hello,7\n")
    events, bad = read(spark, tmp_path)
    rows = {r.message: r for r in events.collect()}
    assert rows['Disk, "95%"'].service == "db"
    assert rows["hello"].metadata == {"extra": "7"} and rows["hello"].level == "INFO"
    assert any(r.level == "WARN" and str(r.timestamp) == "2024-01-15 09:50:00" for r in rows.values())
    assert [r.reason for r in bad.collect()] == ["more fields than the header"]


def test_text_lines_keep_physical_numbers(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n2024-01-15 10:30:00 ERROR [auth] x 555-123-4567\r\n   \nplain a@b.co\n")
    (tmp_path / "b.SYSLOG").write_text("2024-01-15T10:30:00Z warn y")
    (tmp_path / "empty.txt").write_text("")
    events, _ = read(spark, tmp_path)
    rows = [(r.line_number, r.level, r.service, r.message, r.ts_inferred)
            for r in events.orderBy("source_file", "line_number").collect()]
    assert rows == [
        (2, "ERROR", "unknown", "2024-01-15 10:30:00 ERROR [auth] x [PHONE]", False),
        (4, "INFO", "unknown", "plain [EMAIL]", True),
        (1, "WARN", "unknown", "2024-01-15T10:30:00Z warn y", False),
    ]


@pytest.mark.parametrize("extension", ["json", "jsonl", "csv", "log", "txt", "syslog"])
def test_every_extension_yields_a_message(spark, tmp_path, extension):
    body = {"csv": "message,level\nhello,ERROR\n", "json": '[{"message":"hello","level":"ERROR"}]',
            "jsonl": '{"message":"hello","level":"ERROR"}\n'}.get(extension, "ERROR hello\n")
    (tmp_path / f"f.{extension}").write_text(body)
    events, _ = read(spark, tmp_path)
    row = events.first()
    assert "hello" in row.message and row.level == "ERROR"


def test_missing_and_unsupported(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<a/>")
    (tmp_path / "a.log").write_text("ERROR x")
    events, bad = read(spark, tmp_path, tmp_path / "absent.log")
    assert events.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["file not found", "unsupported format"]
    with pytest.raises(FileNotFoundError):
        files.raw_rows(spark, [str(tmp_path / "absent.log")], strict=True)
    with pytest.raises(ValueError):
        files.raw_rows(spark, [str(tmp_path)], strict=True)


def test_no_files_gives_no_events(spark, tmp_path):
    events, bad = read(spark, tmp_path / "absent.log")
    assert events.count() == 0 and bad.count() == 1


def test_line_numbers_over_many_blocks(spark, tmp_path):
    """Files cut into many splits number as if read in one go."""
    for name in ("a", "b"):
        lines = ["" if i % 3 == 0 else f"{name} {i} " + "x" * (i % 50) for i in range(1, 4001)]
        (tmp_path / f"{name}.log").write_text("\n".join(lines))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        lines = files.text_lines(spark, [str(tmp_path)])
        assert lines.select("source_file").count() == 2 * 2667
        wrong = lines.filter(F.split("value", " ")[1].cast("long") != F.col("line_number"))
        assert wrong.count() == 0
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert number_records(spark.read.text(str(tmp_path))).count() == 8000
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_aliases_and_fallbacks(spark, tmp_path):
    rows = [
        {"@timestamp": "2024-01-15T10:30:00", "severity": "warn", "component": "api", "msg": "slow", "id": 7},
        {"time": "junk", "date": "2024-01-15", "level": None, "severity": "ERROR", "error": "e"},
        {"time": 1705312200, "priority": "low", "message": "", "msg": "hidden"},
        {"timestamp": "1705312200", "app": "x"},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    events, _ = read(spark, tmp_path)
    a, b, c, d = events.orderBy("line_number").collect()
    assert (a.level, a.service, a.message, a.metadata) == ("WARN", "api", "slow", {"id": "7"})
    assert (str(b.timestamp), b.level, b.message) == ("2024-01-15 00:00:00", "INFO", "e")
    assert str(c.timestamp) == "2024-01-15 09:50:00" and c.level == "LOW" and '"msg":"hidden"' in c.message
    assert d.ts_inferred and d.service == "x" and d.message.startswith("{")


def test_round_trip(spark, tmp_path):
    events = spark.createDataFrame([("m1", "ERROR", "s1"), ("m, 2", "INFO", 'q"s'), ("m3", "WARN", "s3")],
                                   "message string, level string, service string")
    events.write.json(str(tmp_path / "j"))
    events.write.option("escape", '"').csv(str(tmp_path / "c"), header=True)
    for folder in ("j", "c"):
        found, _ = read(spark, tmp_path / folder)
        assert {tuple(r) for r in found.select("message", "level", "service").collect()} == {
            tuple(r) for r in events.collect()}


def test_scenarios(spark, tmp_path):
    (tmp_path / "db_pool.json").write_text(json.dumps({"name": "Pool", "severity": "high", "services": ["db"]}))
    events = spark.createDataFrame([("db_pool", 1), ("other", 2)], "scenario string, n int")
    joined = scenarios.with_scenario(events, scenarios.read_catalogue(spark, str(tmp_path))).collect()
    assert [(r.scenario, r.name, r.services) for r in joined] == [("db_pool", "Pool", ["db"])]


def test_measures_of_fragments():
    texts = ['{"a\\"{": "x[', 'y]\n{"', '', '\n[{', 'é"\\\\"[', 'no']

    def by_character(text, inside):
        quotes = depth = broken = 0
        plain = re.sub(r"(?s)\\.", "", text)
        for c in plain:
            if c == '"':
                inside, quotes = not inside, quotes + 1
            elif inside:
                broken += c in "\n\r"
            else:
                depth += (c in "{[") - (c == "]")
        return quotes % 2, depth, broken > 0

    for some in (pa.array(texts), pa.array(["x", *texts]).slice(1)):
        quotes, depth0, depth1, broken0, broken1 = (m.tolist() for m in fragments.json_measures(some))
        assert list(zip(quotes, depth0, broken0)) == [by_character(t, False) for t in texts]
        assert [d for d in zip(depth1, broken1)] == [by_character(t, True)[1:] for t in texts]


def test_each_json_text_is_read_once(spark):
    rows = spark.createDataFrame([("f", 1, '{"a": 1, "a": 2}')], "source_file string, line_number long, element string")
    read = files._json_rows(rows).filter("reason IS NULL")
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert not any("element" in line for line in plan.splitlines() if "Filter" in line)
    assert [r.fields for r in read.collect()] == [{"a": "2"}]


def test_many_ranges_get_wider():
    reader = growing.GrowingReader("/none", ["log"], 1 << 16)
    found = reader.partitions({"a": 10}, {"a": 10 + (1 << 30), "b": 100})
    assert len(found) <= growing.TASKS + 2
    assert [(r.start, r.end) for r in found if r.file == "b"] == [(0, 100)]
    mine = [r for r in found if r.file == "a"]
    assert mine[0].start == 10 and mine[-1].end == 10 + (1 << 30)
    assert all(x.end == y.start for x, y in zip(mine, mine[1:]))
