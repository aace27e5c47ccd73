import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from faultline.operators import cells, intervals, keyword_index, name_index, quantiles


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def no_loops(frame):
    plan = plan_of(frame)
    return "NestedLoop" not in plan and "Cartesian" not in plan


# --- names in texts ---------------------------------------------------------------------------


def names_by_hand(texts, names):
    out = {}
    for key, text in texts:
        hits = sorted((p, n) for n, p in names if n and text is not None and n in text)
        if hits:
            out[key] = hits[0][1]
    return out


def test_first_names_equal_plain_search(spark):
    rng = random.Random(5)
    letters = "aab你 -"
    names = [("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))), rng.randint(0, 30)) for _ in range(300)]
    names += [("auth-service", 1), ("auth-service", 0), ("service", 2), ("", 0), (None, 0), ("%_", 5), ("😀x", 7)]
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    texts += [(1000, "the auth-service failed"), (1001, None), (1002, ""), (1003, "100%_ 😀x"), (1004, "Auth-Service")]
    rows = spark.createDataFrame(texts, "key long, text string").repartition(3)
    listed = spark.createDataFrame(names, "name string, priority int")
    for gram in (1, 3, 5):
        found = name_index.first_names(rows, listed, gram=gram)
        assert {r.key: r.name for r in found.collect()} == names_by_hand(texts, names)
    assert no_loops(found)


def test_a_name_is_filed_under_its_rarest_piece(spark):
    texts = spark.createDataFrame([(i, f"customer#{i:04d}") for i in range(200)], "key long, text string")
    names = spark.createDataFrame([("customer#0007", 1), ("customer#9999", 2), ("cust", 3)], "name string, priority int")
    filed = {r.name: r._piece for r in name_index.file_names(texts, names).collect()}
    # The piece that fewest texts have; a name with a piece that no text has is not filed.
    assert filed == {"customer#0007": "#0007", "cust": "cust"}


def test_no_names_or_texts(spark):
    texts = spark.createDataFrame([(1, "x")], "key long, text string")
    names = spark.createDataFrame([], "name string, priority int")
    assert name_index.first_names(texts, names).count() == 0
    assert name_index.first_names(texts.limit(0), spark.createDataFrame([("x", 1)], "name string, priority int")).count() == 0


# --- the keyword index ------------------------------------------------------------------------


def test_index_search_equals_counting_and_opens_few_blocks(spark, tmp_path):
    rng = random.Random(2)
    common, rare = ["the", "of", "error"], [f"w{i}" for i in range(200)]
    texts = []
    for i in range(600):
        words = [rng.choice(common) for _ in range(rng.randint(0, 8))] + [rng.choice(rare) for _ in range(rng.randint(0, 6))]
        # A few texts have a word very often, so most blocks can't win.
        words += ["error"] * (40 if i % 97 == 0 else 0)
        texts.append((i, " ".join(words).title() if i % 2 else ",".join(words)))
    texts += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    index = keyword_index.build_index(docs, str(tmp_path / "index"), block_texts=10, buckets=8)
    queries = [(1, "error"), (2, "error"), (2, "w3"), (2, "w3"), (3, "nowhere"), (4, "w5"), (5, "the"), (5, "of")]
    asked = spark.createDataFrame(queries, "query_id long, keyword string")
    k = 5
    found = {}
    for r in keyword_index.search_index(index, asked, k).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.key, r.score)
    counts = {i: Counter(w for w in (t or "").lower().replace(",", " ").split()) for i, t in texts}
    for query in {q for q, _ in queries}:
        words = {w for q, w in queries if q == query}
        scored = sorted((-sum(c[w] for w in words), i) for i, c in counts.items() if any(c[w] for w in words))[:k]
        assert found.get(query, {}) == {n + 1: (i, -s) for n, (s, i) in enumerate(scored)}
    blocks = index.bounds().select("block").distinct().count()
    opened = Counter(r.query_id for r in keyword_index.opened_blocks(index, asked, k).collect())
    assert blocks > 50 and opened[1] < blocks / 4
    # Only the folders of asked keywords are read.
    one = spark.createDataFrame([(1, "w5")], "query_id long, keyword string")
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan_of(keyword_index.search_index(index, one, k)))


# --- cells of vectors -------------------------------------------------------------------------


def neighbours_by_hand(vectors, queries, k):
    def unit(v):
        v = np.array(v, dtype=float)
        return v / np.linalg.norm(v) if v.any() else v

    out = {}
    for q, a in queries:
        scored = sorted((-round(float(unit(a) @ unit(b)), 9), i) for i, b in vectors)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_cells_find_the_nearest_and_open_few(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(25, 12))
    points = [(i, (centres[i % 25] + rng.normal(scale=0.05, size=12)).tolist()) for i in range(900)]
    points += [(2000 + i, points[3][1]) for i in range(40)] + [(3000, [0.0] * 12)]
    asked = points[:300] + [(5000, [0.0] * 12), (5001, (-np.array(points[0][1])).tolist())]
    broken = [(9000, None), (9001, [None] + [1.0] * 11)]
    vectors = spark.createDataFrame(points + broken, "vec_id long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame(asked + broken, "query_id long, embedding array<double>").repartition(3)
    # Small parts: hot cells and queries meet part by part.
    monkeypatch.setattr(cells, "CELL_PART", 16)
    monkeypatch.setattr(cells, "QUERY_PART", 8)
    found, opened = cells.nearest_in_cells(vectors, queries, 4)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.similarity)
    want = neighbours_by_hand(points, asked, 4)
    assert set(got) == set(want)
    for q, row in got.items():
        assert [row[n][0] for n in range(1, 5)] == want[q], q
    n_cells = opened.select("cell").distinct().count()
    per_query = opened.filter("query_id < 300").groupBy("query_id").count().agg(F.avg("count")).first()[0]
    assert per_query < n_cells / 2


def test_fewer_vectors_than_asked_for(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.1])], "query_id long, embedding array<double>")
    found, _ = cells.nearest_in_cells(vectors, queries, 5)
    assert [(r.vec_id, r["rank"]) for r in found.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    none, _ = cells.nearest_in_cells(vectors.limit(0), queries, 5)
    assert none.count() == 0


# --- events within a time -----------------------------------------------------------------------


def test_events_within_equal_all_pairs(spark, make_events):
    rng = random.Random(3)
    rows = [("i", rng.choice([rng.randint(0, 5000), 777, 720, 660]), rng.choice(["INFO", "FATAL"]), f"s{n % 3}", f"m{n}") for n in range(400)]
    events = make_events(rows).withColumn("seq", F.col("message").substr(2, 9).cast("long"))
    events = events.unionByName(events.limit(3).withColumn("timestamp", F.lit(None).cast("timestamp")))
    anchors = events.filter("level = 'FATAL'").withColumnRenamed("seq", "anchor")
    want = sorted((a, b, rows[a][1] - rows[b][1]) for a in range(400) if rows[a][2] == "FATAL" for b in range(400) if 0 < rows[a][1] - rows[b][1] <= 60)
    for slot_events in (100_000, 5):
        found = intervals.events_within(events, anchors, 60, ["anchor"], ["seq"], slot_events=slot_events)
        assert sorted((r.anchor, r.before_seq, r.seconds_before) for r in found.collect()) == want
    assert no_loops(found)


# --- quantiles ----------------------------------------------------------------------------------


def test_merged_sketches_keep_the_rank_bound(spark):
    rng = np.random.default_rng(1)
    values = rng.lognormal(size=20_000)
    rows = [(int(i * 86400 / 20_000), float(v), "a" if i % 3 else "b") for i, v in enumerate(values)]
    rows += [(5, None, "a"), (6, float("nan"), "a"), (7, None, "c")]
    points = spark.createDataFrame(rows, "at long, value double, service string").withColumn("timestamp", F.timestamp_seconds("at"))
    hours = quantiles.sketched_windows(points, "1 hour", ["service"])
    assert hours.count() == 48
    days = quantiles.quantiles_of(quantiles.merged_windows(hours, "1 day", ["service"])).collect()
    assert {r.service for r in days} == {"a", "b"}
    for r in days:
        own = np.sort([v for _, v, s in rows if s == r.service and v is not None and v == v])
        assert r.n == len(own)
        for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert abs(np.searchsorted(own, r[name]) / len(own) - q) <= 2 * quantiles.RANK_ERROR


def test_only_cells_to_open_leave_the_task(spark):
    import numpy as np
    import pandas as pd

    from faultline.operators import cells

    centroids = np.eye(4)
    known = pd.DataFrame({"cell": [0, 1, 2, 3], "radius": [0.1] * 4, "n": [1, 5, 5, 5]})
    asked = spark.createDataFrame([(7, [1.0, 0.2, 0.1, 0.0], 0.15)], "query_id long, embedding array<double>, floor double")
    first = cells.cells_to_open(asked, centroids, known, 3, False).collect()
    more = cells.cells_to_open(asked, centroids, known, 3, True).collect()
    assert [tuple(r) for r in first] == [(7, 0), (7, 1)]
    assert [tuple(r) for r in more] == [(7, 2)]


def test_vectors_move_once_where_no_cell_is_ruled_out(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    points += [(1000 + i, (3.0 * np.array(points[i][1])).tolist()) for i in range(0, 400, 40)] + [(900, [0.0] * 16)]
    held, plain = [], cells.cut
    monkeypatch.setattr(cells, "cut", lambda df: held.append(plain(df)) or held[-1])
    monkeypatch.setattr(cells, "LEAST_PART", 64)
    vectors = spark.createDataFrame(points, "vec_id long, embedding array<double>").repartition(3)
    found, opened = cells.nearest_in_cells(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 3)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert {q: [row[n] for n in (1, 2, 3)] for q, row in got.items()} == neighbours_by_hand(points, points, 3)
    # Every query opens nearly every cell, and still no table is as long as queries times cells.
    n, n_cells = len(points), opened.select("cell").distinct().count()
    assert opened.count() > n * n_cells / 2
    tasks = cells.TASKS * spark.sparkContext.defaultParallelism
    shares = -(-tasks // min(tasks, -(-n // 64)))
    assert max(df.count() for df in held) <= 3 * n * shares < n * n_cells / 2
    with_vectors = [df for df in held if "embedding" in df.columns]
    assert [df.count() for df in with_vectors] == [n]


def test_best_of_many_equal_scores():
    best = cells.Best(3, 2)
    best.meet(np.array([0, 2]), np.arange(50, 90), np.tile([[0.5], [0.25]], 40))
    best.meet(np.array([0, 1, 2]), np.array([7, 95]), np.array([[0.5 + 1e-15, 0.5], [0.1, 0.2], [0.1, 0.9]]))
    assert best.ids.tolist() == [[7, 50], [95, 7], [95, 50]]
    assert best.scores.tolist() == [[0.5, 0.5], [0.2, 0.1], [0.9, 0.25]]


def test_equal_texts_are_searched_once(spark, monkeypatch):
    from faultline.operators import name_index

    searched, plain = [], name_index.file_names

    def watched(texts, *args):
        searched.append(texts.count())
        return plain(texts, *args)

    monkeypatch.setattr(name_index, "file_names", watched)
    texts = spark.createDataFrame([(n, f"call by user {n % 3}") for n in range(30)] + [(30, None)], "key long, text string")
    names = spark.createDataFrame([("user 1", 1), ("call", 2)], "name string, priority int")
    found = {r.key: r.name for r in name_index.first_names(texts, names).collect()}
    assert found == {n: "user 1" if n % 3 == 1 else "call" for n in range(30)}
    assert searched == [3]
