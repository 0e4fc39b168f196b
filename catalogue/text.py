"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake import functions as fn
from paperlake.sources import (
    load_table,
    paper_rules,
    quarantine,
    topic_rules,
    vector_rules,
    with_defaults,
)

from .base import DIM, PAPERS_SQL, hash_embed_sql, papers, query, strip_sql, table


@query("SELECT source AS name, count(*) AS papers FROM documents GROUP BY source")
def scan_tables(spark, folder):
    docs = load_table(spark, f"{folder}/documents.parquet")
    return docs.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("papers"))


@query(f"SELECT doc_id, replace({strip_sql('text')}, chr(10), ' ') AS cleaned FROM documents")
def clean_text(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", fn.clean_text(F.col("text")).alias("cleaned")
    )


@query(r"""
SELECT page_id, split_part(url, '/', -1) AS paper_id,
       regexp_replace(split_part(url || 'v' || page_id, '/', -1), 'v\d+$', '') AS base_id
FROM pages""")
def paper_ids(spark, folder):
    versioned = F.concat("url", F.lit("v"), "page_id")
    return table(spark, folder, "pages").select(
        "page_id",
        fn.paper_id(F.col("url")).alias("paper_id"),
        fn.base_id(versioned).alias("base_id"),
    )


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS placed,
       CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS shown
FROM orders""")
def published_dates(spark, folder):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        fn.published_date(stamp).cast("string").alias("placed"),
        fn.published_date(F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(stamp))
        .cast("string")
        .alias("shown"),
    )


@query("""
SELECT doc_id, CASE WHEN quality = 1 THEN source ELSE 'No title' END AS title,
       CASE WHEN quality IS NOT NULL THEN text ELSE 'No abstract' END AS abstract
FROM documents LEFT JOIN labels USING (doc_id)""")
def default_fields(spark, folder):
    labelled = table(spark, folder, "documents").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )
    return with_defaults(
        labelled.select(
            "doc_id",
            F.when(F.col("quality") == 1, F.col("source")).alias("title"),
            F.when(F.col("quality").isNotNull(), F.col("text")).alias("abstract"),
        )
    )


@query("SELECT doc_id, source || chr(10) || chr(10) || text AS content FROM documents")
def embed_text(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", fn.embed_text(F.col("source"), F.col("text")).alias("content")
    )


@query("SELECT doc_id, 'https://arxiv.org/abs/' || doc_id AS url FROM documents")
def paper_urls(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", fn.paper_url(F.col("doc_id").cast("string")).alias("url")
    )


@query("""
SELECT event_id, printf('%.1f%%', 100 * round(1 - sqrt(value) / 100, 3)) AS similarity FROM events""")
def similarity_percent(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", fn.similarity_pct(F.sqrt("value") / 100).alias("similarity")
    )


@query("""
WITH parts AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT conv_id, turn, role || '; ' || trim(text, ' ' || chr(10)) AS authors,
       CASE WHEN turn % 2 = 0 THEN role ELSE '' END
         || CASE WHEN turn % 2 = 0 AND length(text) > 0 THEN ', ' ELSE '' END || text AS categories
FROM parts""")
def joined_names(spark, folder):
    turns = table(spark, folder, "conversations")
    authors = F.array(F.struct(F.col("role").alias("name")), F.struct(F.col("text").alias("name")))
    empty = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("")
    categories = F.array(F.struct(empty.alias("_term")), F.struct(F.col("text").alias("_term")))
    return turns.select(
        "conv_id",
        "turn",
        fn.join_authors(authors).alias("authors"),
        fn.join_categories(categories).alias("categories"),
    )


@query("""
SELECT vec_id, i - 1 AS place, CAST(embedding[i] AS DOUBLE) AS value
FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i)""")
def vector_text_round_trip(spark, folder):
    """Vectors written as text and read back, one row per number."""
    read_back = fn.vector_from_text(fn.vector_to_text(F.col("embedding")))
    return (
        table(spark, folder, "embeddings")
        .select("vec_id", F.posexplode(read_back).alias("place", "value"))
        .select("vec_id", F.col("place").cast("long").alias("place"), F.col("value").cast("double"))
    )


@query("""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
first AS (SELECT label, min(vec_id) AS vec_id FROM e GROUP BY label),
heads AS (SELECT e.label, v AS w FROM e JOIN first USING (vec_id))
SELECT vec_id, round(list_cosine_distance(v, w), 6) + 0.0 AS distance,
       round(list_dot_product(v, w), 6) + 0.0 AS product,
       round(sqrt(list_dot_product(v, v)), 6) AS norm,
       round(1 - list_dot_product(v, w), 4) + 0.0 AS unit_distance
FROM e JOIN heads USING (label)""")
def vector_functions(spark, folder):
    """Each vector against the first one of its label."""
    vectors = table(spark, folder, "embeddings")
    heads = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    v, w = F.col("embedding"), F.col("head")
    return vectors.join(heads, "label").select(
        "vec_id",
        (F.round(fn.cosine_distance(v, w), 6) + 0.0).alias("distance"),
        (F.round(fn.dot(v, w), 6) + 0.0).alias("product"),
        F.round(fn.l2_norm(v), 6).alias("norm"),
        (F.round(fn.cosine_distance(v, w, unit=True), 4) + 0.0).alias("unit_distance"),
    )


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, i - 1 AS place,
       round(CAST(CAST(v[i] / sqrt(list_dot_product(v, v)) AS FLOAT) AS DOUBLE), 5) + 0.0 AS value
FROM e, unnest(range(1, len(v) + 1)) AS r(i)""")
def unit_vectors(spark, folder):
    doubled = F.transform("embedding", lambda x: x * F.lit(2.0))
    return (
        table(spark, folder, "embeddings")
        .select("vec_id", F.posexplode(fn.l2_normalize(doubled)).alias("place", "value"))
        .select(
            "vec_id",
            F.col("place").cast("long").alias("place"),
            (F.round(F.col("value").cast("double"), 5) + 0.0).alias("value"),
        )
    )


@query(f"""
WITH {hash_embed_sql('text', 'doc_id', 'documents')}
SELECT doc_id, bucket, round(CAST(value AS DOUBLE), 6) AS value FROM hashed""")
def hash_embeddings(spark, folder):
    """Model-free embeddings of whole texts; the buckets that are not 0."""
    vector = fn.hash_embedding(F.col("text"), DIM)
    return (
        table(spark, folder, "documents")
        .select("doc_id", F.posexplode(vector).alias("bucket", "value"))
        .where(F.col("value") != 0)
        .select(
            "doc_id",
            F.col("bucket").cast("long").alias("bucket"),
            F.round(F.col("value").cast("double"), 6).alias("value"),
        )
    )


@query("""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
first AS (SELECT label, min(vec_id) AS vec_id FROM e GROUP BY label),
heads AS (SELECT e.label, v AS w FROM e JOIN first USING (vec_id))
SELECT label, count(*) AS vectors, round(avg(list_cosine_distance(v, w)), 6) AS distance
FROM e JOIN heads USING (label) GROUP BY label""")
def registered_functions(spark, folder):
    """The vector functions by their SQL names."""
    fn.register_functions(spark)
    table(spark, folder, "embeddings").createOrReplaceTempView("paperlake_embeddings")
    return spark.sql("""
        WITH heads AS (
          SELECT label, min_by(embedding, vec_id) AS head FROM paperlake_embeddings GROUP BY label)
        SELECT label, count(*) AS vectors,
               round(avg(cosine_distance(embedding, head)), 6) AS distance
        FROM paperlake_embeddings JOIN heads USING (label) GROUP BY label""")


@query("""
SELECT doc_id, concat_ws('; ', CASE WHEN length(source) > 4 THEN 'id too long' END,
         CASE WHEN lang = 'de' THEN 'missing title' END,
         CASE WHEN n_chars < 100 THEN 'bad date' END) AS reasons
FROM documents WHERE length(source) > 4 OR lang = 'de' OR n_chars < 100""")
def rejected_papers(spark, folder):
    """Papers that break a rule of the table: id length, title, date."""
    rows = table(spark, folder, "documents").select(
        "doc_id",
        F.col("source").alias("arxiv_id"),
        F.expr("nullif(lang, 'de')").alias("title"),
        F.when(F.col("n_chars") >= 100, F.current_date()).alias("published_date"),
    )
    _, bad = quarantine(rows, paper_rules(id_length=4))
    return bad.select("doc_id", F.array_join("reasons", "; ").alias("reasons"))


@query("""
SELECT c_custkey, c_name FROM customer WHERE length(c_name) <= 18 AND c_mktsegment <> 'BUILDING'""")
def accepted_topics(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_custkey",
        "c_name",
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("name"),
    )
    good, _ = quarantine(rows, topic_rules(name_length=18))
    return good.select("c_custkey", "c_name")


@query(f"""
WITH {PAPERS_SQL}
SELECT arxiv_id, CASE WHEN embedding IS NULL THEN 'missing vector'
                      WHEN topic_id = 3 THEN 'wrong dimension'
                      WHEN topic_id = 4 THEN 'null element' ELSE 'zero vector' END AS reasons
FROM papers WHERE embedding IS NULL OR topic_id IN (3, 4, 5)""")
def rejected_vectors(spark, folder):
    """Vectors spoilt in three topics, and the absent ones."""
    v = F.col("embedding")
    spoilt = (
        F.when(F.col("topic_id") == 3, F.slice(v, 2, DIM))
        .when(F.col("topic_id") == 4, F.transform(v, lambda x, i: F.when(i != 7, x)))
        .when(F.col("topic_id") == 5, F.transform(v, lambda x: x * 0))
        .otherwise(v)
    )
    rows = papers(spark, folder).withColumn("embedding", spoilt)
    _, bad = quarantine(rows, vector_rules(dim=DIM))
    return bad.select("arxiv_id", F.array_join("reasons", "; ").alias("reasons"))
