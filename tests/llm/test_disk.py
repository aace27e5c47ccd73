"""What stages write to disk: no text a second time, no set once more for every chunk it meets."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.llm import exact_dedup, jaccard, skew, toxicity


def texts_with_families(copies=40):
    rng = random.Random(4)
    texts = []
    for size in (12, 15, 60, 75, 90):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            words[rng.randrange(size)] = f"v{rng.randint(0, 9)}"
            texts.append(" ".join(words))
    return texts + [None, "", "one", texts[0], texts[70]]


@pytest.fixture
def new_folders(monkeypatch):
    """The folders that are made from now on, by label."""
    made, plain = [], skew.new_folder

    def watched(spark, label):
        made.append(plain(spark, label))
        return made[-1]

    monkeypatch.setattr(skew, "new_folder", watched)
    monkeypatch.setattr(jaccard, "new_folder", watched)
    return lambda label="": [f for f in made if f.rsplit("/", 1)[1].startswith(label)]


def test_stages_write_no_text_that_lies_in_files(spark, tmp_path, make_docs, new_folders):
    path = str(tmp_path / "docs")
    make_docs(texts_with_families()).write.parquet(path)
    docs = spark.read.parquet(path)
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    stages = [
        lambda d: toxicity.without_toxic(d, labels),
        exact_dedup.without_copies,
        jaccard.without_near_copies,
    ]
    for stage in stages:
        stay = stage(docs)
        assert stay.columns == docs.columns
        held = sorted(r.doc_id for r in stage(docs.localCheckpoint()).select("doc_id").collect())
        assert sorted(r.doc_id for r in stay.select("doc_id").collect()) == held
    # Rows that lie in no file are held once; only a labelled sample has texts besides.
    wrote = [f for f in new_folders() if "text" in spark.read.parquet(f).columns and "/toxicity-" not in f]
    assert sorted(f.rsplit("/", 1)[1].rsplit("-", 1)[0] for f in wrote) == ["exact-input", "near-input"]


def test_rows_in_files_have_numbers_of_their_own(spark, tmp_path):
    path = str(tmp_path / "a b%20c")
    spark.range(1000).selectExpr("id % 7 as doc_id", "cast(id as string) as _row").repartition(5).write.parquet(path)
    rows = spark.read.parquet(path)
    found = skew.numbered_in_place(rows, "in-place")
    assert found.count() == 1000 == found.select("_row").distinct().count()
    twice = {r.own: r.n for r in found.groupBy(F.col("`_row~own`").alias("own")).agg(F.countDistinct("_row").alias("n")).collect()}
    assert len(twice) == 1000
    assert sorted(r._row for r in skew.unnumbered(found).collect()) == sorted(map(str, range(1000)))
    # Files that are read twice, and rows that were made, have no place of their own.
    assert skew.lies_in_files(rows.select("doc_id")) and not skew.lies_in_files(rows.filter("doc_id > 2"))
    assert not skew.lies_in_files(rows.withColumn("x", F.rand())) and not skew.lies_in_files(spark.range(3))
    assert skew.numbered_in_place(spark.read.parquet(path, path), "twice").select("_row").distinct().count() == 2000


def test_a_set_is_written_once_however_many_chunks_it_meets(spark, monkeypatch, make_docs, new_folders):
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    texts = texts_with_families()
    found = {r.doc_id: r.component_id for r in jaccard.similar_groups(make_docs(texts), 5, 80).collect()}
    (folder,) = new_folders("chunks")
    sets = spark.read.parquet(folder)
    sized = spark.read.parquet(*new_folders("sized-members")).filter("group_size > 4")
    assert sets.count() == sets.select("doc_id").distinct().count() == sized.count() >= 100
    assert sets.groupBy("unit").count().agg(F.max("count")).first()[0] < 40
    monkeypatch.setattr(jaccard, "CHUNK", 10_000)
    assert found == {r.doc_id: r.component_id for r in jaccard.similar_groups(make_docs(texts), 5, 80).collect()}


def test_many_rows_go_without_a_shuffle_of_the_others(spark, monkeypatch):
    monkeypatch.setattr(skew, "SENT_ROWS", 20)
    ids = list(range(300)) + [(1 << 33) + n for n in range(32760, 32900)]
    rows = spark.createDataFrame([(n, "t") for n in ids], "_row long, text string")
    gone = [n for n in ids if n % 3 == 0]
    stay = skew.without_rows(rows, spark.createDataFrame([(n,) for n in gone], "_gone long"), "bits-test")
    plan = stay._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert stay.columns == ["text"] and stay.count() == len(ids) - len(gone)
    marked = skew.marked_rows(rows, spark.createDataFrame([(n,) for n in gone], "_gone long"), "bits-test")
    assert sorted(r._row for r in marked.filter("_marked").collect()) == gone
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    texts = [(n, t) for n, t in enumerate(texts_with_families())]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    small = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs, 5, 80).collect()}
    monkeypatch.undo()
    assert small == {r.doc_id: r.component_id for r in jaccard.similar_groups(docs, 5, 80).collect()}
