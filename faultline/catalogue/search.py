"""Vector and keyword search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.catalogue.registry import Tables, query, with_log
from faultline.operators import cells, keyword_index, name_index, search
from faultline.session import new_folder


@query(
    """
WITH means AS (
    SELECT label, pos, avg(v::DOUBLE) AS m
    FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY 1, 2),
centroids AS (SELECT label, list(m ORDER BY pos) AS centre FROM means GROUP BY 1),
scored AS (
    SELECT c.label::BIGINT AS query_id, e.vec_id,
           list_cosine_similarity(c.centre, e.embedding::DOUBLE[]) AS s
    FROM centroids c, embeddings e)
SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM scored)
WHERE rank <= 3"""
)
def cosine_topk(t: Tables) -> DataFrame:
    vectors = t.table("embeddings")
    found = search.nearest_vectors(vectors, search.label_centroids(vectors), 3)
    return found.withColumn("similarity", F.round("similarity", 6))


_WORDS_SQL = r"""unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> ''))"""


@query(
    f"""
WITH keywords AS (SELECT DISTINCT {_WORDS_SQL} AS keyword FROM benchmark),
     words AS (SELECT doc_id, {_WORDS_SQL} AS keyword FROM documents),
     scored AS (SELECT keyword, doc_id, count(*) AS score FROM words
                WHERE keyword IN (SELECT keyword FROM keywords) GROUP BY 1, 2)
SELECT keyword, doc_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, doc_id) AS rank FROM scored)
WHERE rank <= 5"""
)
def keyword_search(t: Tables) -> DataFrame:
    words = search.words_of(F.col("text"))
    keywords = t.table("benchmark").select(F.explode(words).alias("keyword")).distinct()
    return search.keyword_search(t.spread("documents"), keywords, 5)


@query(
    """
WITH scored AS (
    SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s
    FROM embeddings q, embeddings e)
SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM scored)
WHERE rank <= 3"""
)
def cosine_topk_many(t: Tables) -> DataFrame:
    """The three vectors nearest to every vector, itself among them."""
    vectors = t.table("embeddings")
    found, _ = cells.nearest_in_cells(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 3)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    f"""
WITH asked AS (SELECT DISTINCT item_id AS query_id, {_WORDS_SQL} AS keyword FROM benchmark),
     words AS (SELECT doc_id, {_WORDS_SQL} AS keyword FROM documents),
     counted AS (SELECT keyword, doc_id, count(*) AS n FROM words GROUP BY 1, 2),
     scored AS (SELECT query_id, doc_id, CAST(sum(n) AS BIGINT) AS score FROM asked JOIN counted USING (keyword) GROUP BY 1, 2)
SELECT query_id, doc_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
WHERE rank <= 5"""
)
def indexed_keyword_search(t: Tables) -> DataFrame:
    """The five documents with the most words of each benchmark item, from an index that is built once."""
    index = keyword_index.build_index(t.spread("documents"), new_folder(t.spark, "keywords"), block_texts=256)
    words = F.explode(search.words_of(F.col("text"))).alias("keyword")
    asked = t.table("benchmark").select(F.col("item_id").alias("query_id"), words).distinct()
    return keyword_index.search_index(index, asked, 5).withColumnRenamed("key", "doc_id")


@query(
    with_log(
        """
SELECT seq, min({'priority': priority, 'name': name}).name AS name
FROM log_events JOIN names ON contains(message, name) GROUP BY seq""",
        """names AS (
    SELECT concat('user ', user_id) AS name, user_id * 37 % 1000 AS priority FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT lower(c_name), 2000 + c_custkey FROM customer
    UNION ALL SELECT DISTINCT event_type, 100000 FROM events
    UNION ALL SELECT lower(n_name), 200000 FROM nation
    UNION ALL SELECT 'r 7', 300)""",
    )
)
def names_in_messages(t: Tables) -> DataFrame:
    """The first of a long list of names that each message holds."""
    events = t.table("events")
    users = events.select(F.col("user_id")).distinct()
    names = (
        users.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"), (F.col("user_id") * 37 % 1000).alias("priority"))
        .unionByName(t.table("customer").select(F.lower("c_name").alias("name"), (F.lit(2000) + F.col("c_custkey")).alias("priority")))
        .unionByName(events.select(F.col("event_type").alias("name"), F.lit(100_000).cast("long").alias("priority")).distinct())
        .unionByName(t.table("nation").select(F.lower("n_name").alias("name"), F.lit(200_000).cast("long").alias("priority")))
        .unionByName(events.limit(1).select(F.lit("r 7").alias("name"), F.lit(300).cast("long").alias("priority")))
    )
    return name_index.first_names(t.log_events.select("seq", "message"), names, "seq", "message")
