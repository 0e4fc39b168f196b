"""Cells and approximate search. The cells here are the means of the labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.operators import ann
from paperlake.operators import search as sr
from paperlake.operators.cell_index import CellIndex
from paperlake.session import cut, fresh_folder

from .base import DIM, HITS_SQL, papers, plain_distance, query, questions, table

CELLS_SQL = """numbers AS (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i) GROUP BY label, i),
cells AS (SELECT label AS cell, list(x ORDER BY i) AS centroid FROM numbers GROUP BY label),
placed AS (
  SELECT arxiv_id, topic_id, embedding, cell, distance FROM (
    SELECT arxiv_id, topic_id, embedding, cell, round(list_cosine_distance(embedding, centroid), 12) AS distance,
           row_number() OVER (PARTITION BY arxiv_id
             ORDER BY round(list_cosine_distance(embedding, centroid), 12), cell) AS turn
    FROM papers CROSS JOIN cells WHERE embedding IS NOT NULL) WHERE turn = 1),
probed AS (
  SELECT qid, vector, topic_id, cell FROM (
    SELECT qid, vector, topic_id, cell, row_number() OVER (PARTITION BY qid
             ORDER BY round(list_cosine_distance(vector, centroid), 12), cell) AS turn
    FROM questions CROSS JOIN cells) WHERE turn <= 3),
near AS (
  SELECT qid, arxiv_id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, arxiv_id) AS rk
  FROM (SELECT qid, arxiv_id, round(list_cosine_distance(vector, embedding), 12) AS distance
        FROM probed JOIN placed USING (cell)))"""


def label_means(spark, folder):
    return cut(
        table(spark, folder, "embeddings")
        .select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("numbers"))
        .select(F.col("label").alias("cell"), F.col("numbers.x").alias("centroid"))
    )


@query("""
SELECT count(*) AS papers, true AS at_most_20, true AS in_nearest, true AS tighter_than_one
FROM documents JOIN embeddings ON doc_id = vec_id""")
def trained_cells(spark, folder):
    """What is certain of k-means cells: each paper is in one, its nearest; they beat one cell for all."""
    known = cut(papers(spark, folder).where(F.col("embedding").isNotNull()))
    centroids = cut(ann.train_cells(known, 20))
    placed = ann.assign_cells(known, centroids).select("arxiv_id", "embedding", "cell", "angle")
    away = F.aggregate(
        F.zip_with("embedding", "centroid", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x
    ) / F.sqrt(
        F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x)
        * F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    )
    named = F.broadcast(centroids.withColumnRenamed("cell", "other"))  # twenty rows
    best = placed.join(named).groupBy("arxiv_id", "cell", "angle").agg(F.max(away).alias("most"))
    numbers = known.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    middle = numbers.agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("numbers")).select(
        F.lit(0).alias("cell"), F.col("numbers.x").alias("centroid")
    )
    whole = ann.assign_cells(known, middle).agg(F.avg(1 - F.cos("angle")).alias("one"))
    return best.agg(
        F.count("*").alias("papers"),
        (F.count_distinct("cell") <= 20).alias("at_most_20"),
        (F.max(F.col("most") - F.cos("angle")) <= 1e-6).alias("in_nearest"),
        F.avg(1 - F.cos("angle")).alias("mean"),
    ).join(whole).select("papers", "at_most_20", "in_nearest", (F.col("mean") < F.col("one")).alias("tighter_than_one"))


@query("WITH " + HITS_SQL + ", " + CELLS_SQL + """
SELECT papers.arxiv_id, cell, round(placed.distance, 6) + 0.0 AS distance
FROM papers LEFT JOIN placed USING (arxiv_id)""")
def assigned_cells(spark, folder):
    placed = ann.assign_cells(papers(spark, folder), label_means(spark, folder))
    distance = (F.round(F.lit(1.0) - F.cos("angle"), 6) + 0.0).alias("distance")
    return placed.select("arxiv_id", "cell", distance)


def _near(spark, folder):
    centroids = label_means(spark, folder)
    stored = ann.write_cells(papers(spark, folder), centroids, fresh_folder(spark, "cells"))
    return ann.ann_join(questions(spark, folder), stored, centroids, 5, 3)


@query("WITH " + HITS_SQL + ", " + CELLS_SQL + """
SELECT qid, arxiv_id, CAST(rk AS BIGINT) AS rk, round(distance, 6) + 0.0 AS distance FROM near WHERE rk <= 5""")
def ann_join(spark, folder):
    """Papers stored by cell, three cells probed per question."""
    return _near(spark, folder).select(
        "qid", "arxiv_id", F.col("rk").cast("long").alias("rk"), plain_distance()
    )


@query("WITH " + HITS_SQL + ", " + CELLS_SQL + """
SELECT count(*) AS wanted, count(near.qid) AS found, round(count(near.qid) / count(*), 6) AS recall
FROM hits LEFT JOIN (SELECT * FROM near WHERE rk <= 5) AS near
  ON near.qid = hits.qid AND near.arxiv_id = hits.arxiv_id""")
def recall(spark, folder):
    exact = sr.knn_join(questions(spark, folder), papers(spark, folder), 5)
    return ann.recall_at_k(_near(spark, folder), exact).withColumn("recall", F.round("recall", 6))


@query("WITH " + HITS_SQL + """
SELECT qid, arxiv_id, CAST(rk AS BIGINT) AS rk, round(distance, 6) + 0.0 AS distance FROM ranked WHERE rk <= 5""")
def knn_join_by_cells(spark, folder):
    """The exact join as it runs for more questions than fit every task."""
    known = papers(spark, folder).where(F.col("embedding").isNotNull())
    asked = questions(spark, folder).select(
        "qid", "vector", F.lit(None).cast("long").alias("topic"), F.lit(5).alias("k")
    )
    placed = known.select("arxiv_id", "embedding", F.lit(None).cast("long").alias("topic"))
    found = ann.exact_join(asked, placed, DIM, label_means(spark, folder))
    return found.select("qid", "arxiv_id", F.col("rk").cast("long").alias("rk"), plain_distance())


@query("WITH " + HITS_SQL + """
SELECT qid, arxiv_id, CAST(rk AS BIGINT) AS rk, round(distance, 6) + 0.0 AS distance FROM ranked WHERE rk <= 5""")
def knn_join_by_index(spark, folder):
    """The exact join over an index whose number of cells follows the papers, written in two appends and split."""
    known = cut(papers(spark, folder).where(F.col("embedding").isNotNull()).select("arxiv_id", "embedding"))
    first = F.pmod(F.xxhash64("arxiv_id"), F.lit(2)) == 0
    index = CellIndex.create(known.where(first), fresh_folder(spark, "index"), dim=DIM)
    index.append(known.where(~first))
    index.split(200)
    asked = questions(spark, folder).select(
        "qid", "vector", F.lit(None).cast("long").alias("topic"), F.lit(5).alias("k")
    )
    placed = index.papers().select("arxiv_id", "embedding", F.lit(None).cast("long").alias("topic"), "cell", "angle")
    found = ann.exact_join(asked, placed, DIM, index.centroids())
    return found.select("qid", "arxiv_id", F.col("rk").cast("long").alias("rk"), plain_distance())
