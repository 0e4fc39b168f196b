"""Registry of the queries, and the given tables in the roles the operators expect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIM = 64  # length of the given vectors


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its own name."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def topic_number(source: Column) -> Column:
    return F.substring(source, 4, 10).cast("long")


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as papers; those with an embedding can be found by vector."""
    docs = table(spark, folder, "documents")
    vectors = table(spark, folder, "embeddings")
    return docs.join(vectors, docs.doc_id == vectors.vec_id, "left").select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").cast("string").alias("arxiv_id"),
        F.concat_ws(" no. ", "source", "doc_id").alias("title"),
        F.concat(F.lit("Group "), "source").alias("authors"),
        F.col("text").alias("abstract"),
        F.col("lang").alias("categories"),
        topic_number(F.col("source")).alias("topic_id"),
        "embedding",
    )


PAPERS_SQL = """papers AS (
  SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS arxiv_id, source || ' no. ' || doc_id AS title,
         'Group ' || source AS authors, text AS abstract, lang AS categories,
         CAST(substr(source, 4) AS BIGINT) AS topic_id,
         CAST(embedding AS DOUBLE[]) AS embedding
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding as a question; those of label 9 are not limited to a topic."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("qid"),
        F.concat(F.lit("What is near "), F.col("vec_id"), F.lit("?")).alias("query"),
        F.col("embedding").alias("vector"),
        F.expr("nullif(label, 9)").cast("long").alias("topic_id"),
    )


QUESTIONS_SQL = """questions AS (
  SELECT vec_id AS qid, 'What is near ' || vec_id || '?' AS query,
         CAST(embedding AS DOUBLE[]) AS vector, CAST(nullif(label, 9) AS BIGINT) AS topic_id
  FROM embeddings)"""

# All pairs of questions and papers, then the k best of each question.
HITS_SQL = (
    PAPERS_SQL
    + ", "
    + QUESTIONS_SQL
    + """, pairs AS (
  SELECT qid, arxiv_id, round(list_cosine_distance(vector, embedding), 12) AS distance
  FROM questions CROSS JOIN papers WHERE embedding IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, arxiv_id) AS rk FROM pairs),
hits AS (
  SELECT qid, rk, distance, papers.arxiv_id, title, abstract AS content
  FROM ranked JOIN papers ON papers.arxiv_id = ranked.arxiv_id WHERE rk <= 5)"""
)


def topics(spark: SparkSession, folder: str) -> DataFrame:
    """Document sources as topics."""
    sources = table(spark, folder, "documents").select("source").distinct()
    return sources.select(
        topic_number(F.col("source")).alias("id"),
        F.col("source").alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


TOPICS_SQL = """topics AS (
  SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, source AS name FROM documents)"""


def chat_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn of the conversations as a chat request.

    Turns of the assistant carry no text; topics are known, unknown, absent, the
    name for all topics, or given by id.
    """
    n = F.col("conv_id") % 24
    return table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.when(F.col("role") != "assistant", F.col("text")).alias("query"),
        F.when(F.col("turn") == 1, F.col("conv_id") % 7).alias("topic_id"),
        F.when(n == 23, F.lit("All Topics")).when(n != 22, F.concat(F.lit("src"), n)).alias("topic"),
        F.when(F.col("turn") > 2, F.col("turn")).cast("int").alias("top_k"),
    )


CHAT_REQUESTS_SQL = """chat_requests AS (
  SELECT conv_id || '-' || turn AS request_id,
         CASE WHEN role <> 'assistant' THEN text END AS query,
         CASE WHEN turn = 1 THEN conv_id % 7 END AS topic_id,
         CASE WHEN conv_id % 24 = 23 THEN 'All Topics'
              WHEN conv_id % 24 <> 22 THEN 'src' || (conv_id % 24) END AS topic,
         CASE WHEN turn > 2 THEN turn END AS top_k
  FROM conversations)"""

# The characters white space is stripped of, as a DuckDB expression.
SPACES_SQL = " || ".join(
    f"chr({n})"
    for n in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203),
              8232, 8233, 8239, 8287, 12288)
)


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {SPACES_SQL})"


def title_case_sql(expr: str) -> str:
    """Title case, character by character."""
    return f"""coalesce(list_aggregate([
      CASE WHEN i = 1 OR NOT regexp_matches(substr({expr}, i - 1, 1), '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}ªº]')
           THEN CASE substr({expr}, i, 1) WHEN 'ß' THEN 'Ss' ELSE upper(substr({expr}, i, 1)) END
           ELSE lower(substr({expr}, i, 1)) END
      FOR i IN range(1, length({expr}) + 1)], 'string_agg', ''), '')"""


def plain_distance(col: str = "distance") -> Column:
    """A distance to six places, zero without a sign."""
    return (F.round(col, 6) + F.lit(0.0)).alias(col)


def hash_embed_sql(text: str, key: str, relation: str, dim: int = DIM) -> str:
    """Hashed term counts at length 1, as rows of key and vector (DOUBLE[])."""
    return f"""terms AS (
  SELECT {key}, term FROM (
    SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[ \\t\\n\\x0B\\f\\r]+')) AS term
    FROM {relation}) WHERE length(term) > 0),
counts AS (
  SELECT {key}, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {dim} AS bucket,
         CAST(count(*) AS DOUBLE) AS n
  FROM terms GROUP BY 1, 2),
norms AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM counts GROUP BY 1),
hashed AS (
  SELECT {key}, bucket, CAST(n / norm AS FLOAT) AS value FROM counts JOIN norms USING ({key}))"""
