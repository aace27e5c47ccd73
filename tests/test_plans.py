import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import search
from faultline.operators import timeline
from faultline.plans.joins import held_lookup, lookup_join
from faultline.plans.ranking import exact_row_number, rows_before, first_n


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_large_lookup_equals_the_plain_join(spark, how):
    large = spark.range(2000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17))
    small = spark.range(0, 12, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = {tuple(r) for r in large.join(small, "k", how).select("*").collect()}
    looked_up = lookup_join(large, small, ["k"], how, max_rows=2)
    assert {tuple(r) for r in looked_up.collect()} == plain
    assert looked_up.count() == large.join(small, "k", how).count()


def test_lookup_join_refuses_types_that_repeat_rows(spark):
    with pytest.raises(ValueError):
        lookup_join(spark.range(2), spark.range(2), ["id"], "right")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    text = plan(first_n(df, ["k"], ["id"], 5))
    assert "WindowGroupLimit" in text and "Partial" in text


def vectors(spark, n, seed=1, dim=8):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim))
    data[3] = 0
    return data, spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("block", [1024, 10])
def test_nearest_vectors_against_brute_force(spark, block):
    data, frame = vectors(spark, 300)
    queries = frame.filter("vec_id < 40").withColumnRenamed("vec_id", "query_id")
    found = search.nearest_vectors(frame.repartition(5), queries, 3, block=block).collect()
    norms = np.linalg.norm(data, axis=1)
    scores = (data[:40] @ data.T) / np.where(norms[:40, None] * norms[None] == 0, np.inf, norms[:40, None] * norms[None])
    for q in range(40):
        best = sorted(range(300), key=lambda v: (-round(scores[q, v], 12), v))[:3]
        mine = sorted((r.rank, r.vec_id) for r in found if r.query_id == q)
        assert len(mine) == 3
        if q != 3:
            assert [v for _, v in mine] == best and mine[0][1] == q


def test_keyword_search_finds_the_named_unit(spark):
    units = spark.createDataFrame([(1, "def unique_handler(): Handles authentication."), (2, "other handler handler"), (3, "")], "doc_id long, text string")
    words = spark.createDataFrame([("unique_handler",), ("HANDLER",), ("absent",)], "keyword string")
    found = {(r.keyword, r.rank): (r.doc_id, r.score) for r in search.keyword_search(units, words, 5).collect()}
    assert found == {("unique_handler", 1): (1, 1), ("handler", 1): (2, 2)}


def test_a_hot_key_is_cut_into_many_partitions(spark):
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.range(20_000).withColumn("k", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")))
        numbered = exact_row_number(df, ["k"], ["id"])
        hot = numbered.filter("k = 0").select(F.spark_partition_id().alias("p"), "rn")
        sizes = [r["count"] for r in hot.groupBy("p").count().collect()]
        assert len(sizes) >= 2 and max(sizes) < 13_334 * 0.7
        assert hot.agg(F.max("rn"), F.count_distinct("rn")).first()[:] == (13_334, 13_334)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_null_keys_are_numbered_too(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 1)], "k string, at long")
    found = {(r.k, r.at): r.rn for r in exact_row_number(df, ["k"], ["at"]).collect()}
    assert found == {(None, 1): 1, (None, 2): 2, ("a", 1): 1}


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_rows_before_reach_over_partitions(spark, partitions):
    rng = random.Random(partitions)
    keys = [None, "a", "b", "hot", "hot", "hot", "hot", "c"]
    rows = [(rng.choice(keys), i, rng.random() < 0.3, None if i % 5 == 0 else f"v{i}", {"k": str(i)}) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, at int, wanted boolean, v string, m map<string,string>")
    df = df.withColumn("time", F.timestamp_seconds("at"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = rows_before(df.repartition(3), ["key"], ["at"], F.col("wanted"), 3, ["at", "v", "time"])
        got = sorted((str(r.key), r.at, r.before_offset, r.before_at, r.before_v, r.before_time.timestamp(), r.m["k"]) for r in found.collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = []
    for key in set(keys):
        own = [r for r in rows if r[0] == key]
        want += [
            (str(key), r[1], -d, own[i - d][1], own[i - d][3], float(own[i - d][1]), r[4]["k"])
            for i, r in enumerate(own) if r[2] for d in (1, 2, 3) if i >= d
        ]
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want, key=lambda w: w[:3])]
    assert {str(g) for g in got} == {str(w) for w in want}


def test_lookup_size_counts_bytes(spark):
    wide = spark.range(3).select(F.repeat(F.lit("x"), 1000).alias("v"))
    assert held_lookup(wide)[1] and not held_lookup(wide, max_bytes=2000)[1] and not held_lookup(wide, max_rows=2)[1]


def test_large_lookup_takes_rows_with_maps(spark):
    large = spark.range(50).select((F.col("id") % 5).alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    assert lookup_join(large, spark.range(3).withColumnRenamed("id", "k"), ["k"], max_rows=1).count() == 30


def test_times_need_utc(spark):
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        with pytest.raises(RuntimeError):
            timeline.to_events(spark.range(1), F.current_timestamp())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_dealt_table_has_parts_for_each_split(spark):
    from faultline.plans.cut import SPLIT_PARTS, spread

    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 3)).rdd.getNumPartitions() == max(cores, 3 * SPLIT_PARTS)
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == cores
