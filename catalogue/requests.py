"""Requests: defaults, checks, topics, status."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.functions import (
    chat_reply,
    embedding_reply,
    json_value,
    title_case as title_case_of,
    to_json_row,
)
from paperlake.operators.requests import normalize_requests, validate_requests, with_status
from paperlake.operators.topics import resolve_topics
from paperlake.session import fresh_folder
from paperlake.sources import read_requests

from .base import (
    CHAT_REQUESTS_SQL,
    TOPICS_SQL,
    chat_requests,
    query,
    strip_sql,
    table,
    title_case_sql,
    topics,
)


@query(f"SELECT conv_id, turn, {title_case_sql('text')} AS titled FROM conversations")
def title_case(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", title_case_of(F.col("text")).alias("titled")
    )


@query(f"""
WITH asked AS (
  SELECT conv_id || '-' || turn AS request_id,
         CASE WHEN turn = 0 THEN 'machine learning' ELSE text END AS query,
         CASE WHEN turn > 3 THEN turn ELSE 10 END AS max_results, role, turn FROM conversations)
SELECT request_id, query, max_results,
       CASE WHEN role = 'system' THEN 'Systems' ELSE {title_case_sql('query')} END AS topic_name
FROM asked""")
def ingest_requests(spark, folder):
    turns = table(spark, folder, "conversations")
    requests = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.when(F.col("turn") != 0, F.col("text")).alias("query"),
        F.when(F.col("turn") > 3, F.col("turn")).alias("max_results"),
        F.when(F.col("role") == "system", F.lit("Systems")).alias("topic_name"),
    )
    return normalize_requests(requests, "ingest").withColumn(
        "max_results", F.col("max_results").cast("long")
    )


@query(f"""
WITH {CHAT_REQUESTS_SQL}
SELECT request_id, coalesce(query, '') AS query, topic_id, topic,
       CAST(coalesce(top_k, 5) AS BIGINT) AS top_k
FROM chat_requests""")
def stored_chat_requests(spark, folder):
    """Requests written as JSON lines, absent fields left out, read back with defaults."""
    path = fresh_folder(spark, "requests")
    chat_requests(spark, folder).write.json(path)
    read = normalize_requests(read_requests(spark, path, "chat"), "chat")
    return read.withColumn("top_k", F.col("top_k").cast("long"))


@query(f"""
WITH {CHAT_REQUESTS_SQL}
SELECT request_id, {strip_sql("coalesce(query, '')")} AS query,
       CASE WHEN length({strip_sql("coalesce(query, '')")}) > 0 THEN 200 ELSE 400 END AS status,
       CAST(least(greatest(coalesce(top_k, 5), 1), 50) AS BIGINT) AS top_k
FROM chat_requests""")
def checked_requests(spark, folder):
    asked = normalize_requests(chat_requests(spark, folder), "chat")
    good, bad = validate_requests(asked, "top_k")
    rows = good.withColumn("status", F.lit(200)).unionByName(bad.drop("error"))
    return rows.select("request_id", "query", "status", F.col("top_k").cast("long"))


@query("""
SELECT event_id, CAST(least(greatest(CAST(round(value) AS BIGINT), 1), 50) AS BIGINT) AS max_results
FROM events WHERE event_type <> 'error'""")
def bounded_batches(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(" ").alias("query"),
        F.round("value").cast("long").alias("max_results"),
    )
    good, _ = validate_requests(events, "max_results")
    return good.select("event_id", "max_results")


def _resolved(spark, folder, on_unknown):
    found = resolve_topics(chat_requests(spark, folder), topics(spark, folder), on_unknown)
    return found.select("request_id", "topic", "topic_id", "searchable")


_RESOLVED_SQL = """
SELECT request_id, topic, coalesce(topic_id, id) AS topic_id, {searchable} AS searchable
FROM chat_requests LEFT JOIN topics ON topic = name"""


@query(f"WITH {CHAT_REQUESTS_SQL}, {TOPICS_SQL}" + _RESOLVED_SQL.format(searchable="true"))
def resolved_topics(spark, folder):
    return _resolved(spark, folder, "all")


@query(
    f"WITH {CHAT_REQUESTS_SQL}, {TOPICS_SQL}"
    + _RESOLVED_SQL.format(
        searchable="topic_id IS NOT NULL OR topic IS NULL OR topic = 'All Topics' "
        "OR id IS NOT NULL"
    )
)
def resolved_topics_strict(spark, folder):
    return _resolved(spark, folder, "none")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 500 WHEN user_id % 5 = 0 THEN 404 ELSE 200 END AS status,
       CASE WHEN event_type = 'error' THEN props WHEN user_id % 5 = 0 THEN 'No papers found'
            ELSE 'Successfully processed ' || (user_id % 5) || ' papers' END AS message
FROM events""")
def ingest_status(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id",
        (F.col("user_id") % 5).alias("fetched"),
        (F.col("user_id") % 5).alias("processed"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )
    return with_status(rows, "ingest").select("event_id", "status", "message")


@query("""
SELECT conv_id, turn,
       CASE WHEN turn = 1 THEN 400 WHEN role = 'system' THEN 500 ELSE 200 END AS status,
       CASE WHEN turn = 1 THEN 'Query is required' WHEN role = 'system' THEN role
            WHEN turn = 0 THEN 'I could not find relevant information to answer your query.'
            ELSE text END AS message
FROM conversations""")
def chat_status(spark, folder):
    rows = table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("turn") != 1, F.lit("why?")).alias("query"),
        F.when(F.col("role") == "system", F.col("role")).alias("error"),
        F.col("turn").alias("context_chunks"),
        F.col("text").alias("answer"),
    )
    return with_status(rows, "chat").select("conv_id", "turn", "status", "message")


@query("""
SELECT vec_id, label AS words, i - 1 AS place, CAST(embedding[i] AS DOUBLE) AS value,
       'label ' || label AS answer
FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i)""")
def model_replies(spark, folder):
    """Replies of both models as JSON texts, and what is read out of them."""
    body = to_json_row("embedding", F.col("label").alias("inputTextTokenCount"))
    said = F.struct(F.concat(F.lit("label "), "label").alias("content"))
    reply = to_json_row(F.array(F.struct(said.alias("message"))).alias("choices"))
    replies = table(spark, folder, "embeddings").select(
        "vec_id", body.alias("body"), reply.alias("reply")
    )
    return replies.select(
        "vec_id",
        json_value(F.col("body"), "inputTextTokenCount", "int").alias("words"),
        chat_reply(F.col("reply")).alias("answer"),
        F.posexplode(embedding_reply(F.col("body"))).alias("place", "value"),
    ).select(
        "vec_id",
        "words",
        "answer",
        F.col("place").cast("long").alias("place"),
        F.col("value").cast("double").alias("value"),
    )
