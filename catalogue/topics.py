"""Topics and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.operators import topics as tp

from .base import PAPERS_SQL, TOPICS_SQL, papers, query, table, topics


def _nations(spark, folder):
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.col("n_name").alias("name"),
        F.lit(None).cast("string").alias("description"),
    )


@query("""
WITH names AS (
  SELECT c_mktsegment AS name FROM customer
  UNION SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT o_orderpriority FROM orders),
missing AS (SELECT name FROM names WHERE name NOT IN (SELECT n_name FROM nation))
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(NULL AS VARCHAR) AS description FROM nation
UNION ALL
SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY name), name,
       'Research papers about ' || name
FROM missing""")
def upserted_topics(spark, folder):
    """Nations as stored topics; wanted are segments, nations and priorities."""
    stored = _nations(spark, folder)
    customer = table(spark, folder, "customer")
    lived_in = customer.join(
        stored, F.col("c_nationkey") == F.col("id")
    )
    names = (
        customer.select(F.col("c_mktsegment").alias("name"))
        .unionByName(lived_in.select("name"))
        .unionByName(table(spark, folder, "orders").select(F.col("o_orderpriority").alias("name")))
    )
    _, everything = tp.upsert_topics(names, stored)
    return everything


@query("""
SELECT c_custkey, c_nationkey AS topic_id, n_name AS topic_name
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey""")
def papers_with_topic(spark, folder):
    known = table(spark, folder, "nation").where("n_regionkey <> 2").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")
    )
    rows = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("topic_id")
    )
    return tp.with_topic(rows, known).select("c_custkey", "topic_id", "topic_name")


@query("""
SELECT o_orderkey, o_custkey AS topic_id FROM orders
WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def orphaned_papers(spark, folder):
    """Orders of customers that are in debt count as papers without their topic."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("topic_id"),
    )
    known = table(spark, folder, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("id")
    )
    return tp.orphans(rows, known).select("o_orderkey", "topic_id")


@query(f"""
WITH {TOPICS_SQL}, built_in(place, name) AS (VALUES
  (0, 'All Topics'), (1, 'Machine Learning'), (2, 'Quantum Computing'), (3, 'Computer Vision'),
  (4, 'Natural Language Processing'), (5, 'Artificial Intelligence'), (6, 'Deep Learning'),
  (7, 'Reinforcement Learning')),
stored AS (SELECT id, CASE id WHEN 4 THEN 'Deep Learning' ELSE name END AS name FROM topics)
SELECT name, 0 AS origin, CAST(place AS BIGINT) AS place FROM built_in
UNION ALL
SELECT name, 1, id FROM stored WHERE name NOT IN (SELECT name FROM built_in)""")
def topic_catalogue(spark, folder):
    """One stored topic has the name of a built-in one."""
    name = F.when(F.col("id") == 4, "Deep Learning").otherwise(F.col("name"))
    return tp.topic_catalogue(topics(spark, folder).withColumn("name", name))


@query(f"WITH {PAPERS_SQL} SELECT arxiv_id, title, topic_id FROM papers WHERE topic_id = 0")
def papers_of_topic(spark, folder):
    """Topic 0 is a topic, not the absence of one."""
    return tp.filter_topic(papers(spark, folder), 0).select("arxiv_id", "title", "topic_id")


@query(f"""
WITH {PAPERS_SQL}, fields AS (
  SELECT arxiv_id, lower(concat_ws(' ', title, abstract, authors, categories)) AS everything FROM papers)
SELECT arxiv_id FROM fields
WHERE contains(everything, 'group') AND contains(everything, 'the') AND contains(everything, 'src1')""")
def search_terms(spark, folder):
    return tp.search_terms(papers(spark, folder), "Group the SRC1").select("arxiv_id")
