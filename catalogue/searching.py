"""Vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.operators import search as sr
from paperlake.session import cut

from .base import (
    HITS_SQL,
    PAPERS_SQL,
    QUESTIONS_SQL,
    papers,
    plain_distance,
    query,
    questions,
    table,
)

MEAN_SQL = """numbers AS (
  SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS x
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i) GROUP BY i),
mean AS (SELECT list(x ORDER BY i) AS v FROM numbers)"""


def mean_vector(spark, folder) -> list[float]:
    """The mean of all vectors: one number per dimension."""
    rows = (
        table(spark, folder, "embeddings")
        .select(F.posexplode("embedding").alias("i", "x"))
        .groupBy("i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .orderBy("i")
        .collect()
    )
    return [r["x"] for r in rows]


def _nearest(found):
    return found.select("arxiv_id", "title", plain_distance())


@query(f"""
WITH {PAPERS_SQL}, {MEAN_SQL}
SELECT arxiv_id, title, round(list_cosine_distance(embedding, v), 6) + 0.0 AS distance
FROM papers, mean WHERE embedding IS NOT NULL
ORDER BY round(list_cosine_distance(embedding, v), 12), arxiv_id LIMIT 10""")
def nearest_papers(spark, folder):
    """The ten papers nearest to the mean of all vectors."""
    return _nearest(sr.search(papers(spark, folder), mean_vector(spark, folder), 10))


@query(f"""
WITH {PAPERS_SQL}, {MEAN_SQL}
SELECT arxiv_id, title, round(list_cosine_distance(embedding, v), 6) + 0.0 AS distance
FROM papers, mean WHERE embedding IS NOT NULL AND topic_id = 3
ORDER BY round(list_cosine_distance(embedding, v), 12), arxiv_id LIMIT 10""")
def nearest_papers_of_topic(spark, folder):
    return _nearest(sr.search(papers(spark, folder), mean_vector(spark, folder), 10, topic_id=3))


def _hits(found):
    return found.select(
        "qid",
        "arxiv_id",
        F.col("rk").cast("long").alias("rk"),
        plain_distance(),
        plain_distance("similarity"),
    )


KNN_OUT_SQL = """
SELECT qid, arxiv_id, rk, round(distance, 6) + 0.0 AS distance,
       round(1 - distance, 6) + 0.0 AS similarity FROM ranked WHERE rk <= 5"""

TOPIC_HITS_SQL = f"""WITH {PAPERS_SQL}, {QUESTIONS_SQL}, pairs AS (
  SELECT qid, arxiv_id, round(list_cosine_distance(vector, embedding), 12) AS distance
  FROM questions JOIN papers ON questions.topic_id IS NULL OR questions.topic_id = papers.topic_id
  WHERE embedding IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, arxiv_id) AS rk FROM pairs)
"""


@query("WITH " + HITS_SQL + KNN_OUT_SQL)
def knn_join(spark, folder):
    """Every question's five nearest papers."""
    return _hits(sr.knn_join(questions(spark, folder), papers(spark, folder), 5))


@query(TOPIC_HITS_SQL + KNN_OUT_SQL)
def knn_join_in_topic(spark, folder):
    """The same inside the topic of the question, where it has one."""
    return _hits(sr.knn_join(questions(spark, folder), papers(spark, folder), 5, "topic_id"))


@query("WITH " + HITS_SQL + """
SELECT qid, CAST(rk AS BIGINT) AS rk, title AS paper_title, arxiv_id, round(distance, 3) + 0.0 AS distance,
       'https://arxiv.org/abs/' || arxiv_id AS url FROM hits""")
def hit_sources(spark, folder):
    known = papers(spark, folder)
    found = sr.with_text(cut(sr.knn_join(questions(spark, folder), known, 5)), known)
    return sr.sources(found).withColumns({
        "rk": F.col("rk").cast("long"),
        "distance": F.col("distance") + 0.0,
    })
