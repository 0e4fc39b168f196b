"""Contexts, prompts, answers, responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.operators import answer as an
from paperlake.operators import search as sr
from paperlake.plans import chat
from paperlake.session import cut, fresh_folder
from paperlake.sources import write_responses

from .base import (
    CHAT_REQUESTS_SQL,
    DIM,
    HITS_SQL,
    PAPERS_SQL,
    TOPICS_SQL,
    chat_requests,
    hash_embed_sql,
    papers,
    query,
    questions,
    strip_sql,
    table,
    topics,
)
from .models import counting_completer, hash_model


def _hits(spark, folder):
    known = papers(spark, folder)
    return sr.with_text(cut(sr.knn_join(questions(spark, folder), known, 5)), known)


CONTEXTS_SQL = HITS_SQL + """, contexts AS (
  SELECT qid, string_agg('[Source ' || rk || ': ' || title || ' (arXiv:' || arxiv_id || ')]' || chr(10)
         || content || chr(10), chr(10) ORDER BY rk) AS context, count(*) AS context_chunks
  FROM hits GROUP BY qid),
prompts AS (
  SELECT qid, 'Based on the following research paper excerpts, please answer this question: '
         || query || chr(10) || chr(10) || 'Research Context:' || chr(10) || context || chr(10) || chr(10)
         || 'Please provide a comprehensive answer based on the information in these sources.' AS prompt
  FROM contexts JOIN questions USING (qid))"""


@query("WITH " + CONTEXTS_SQL + " SELECT qid, context FROM contexts")
def contexts(spark, folder):
    return an.build_context(_hits(spark, folder))


@query("WITH " + CONTEXTS_SQL + """
SELECT qid, replace(context, chr(10) || chr(10) || '[Source ', chr(10) || '---[Source ') AS context FROM contexts""")
def contexts_with_separator(spark, folder):
    return an.build_context(_hits(spark, folder), sep="---")


@query("WITH " + HITS_SQL + """
SELECT qid, string_agg(title || '|' || arxiv_id || '|' || 'https://arxiv.org/abs/' || arxiv_id, ';' ORDER BY rk) AS sources,
       round(sum(round(1 - distance, 3)), 3) AS similarity
FROM hits GROUP BY qid""")
def answer_sources(spark, folder):
    sources = an.collect_sources(_hits(spark, folder))
    listed = F.transform(
        "sources", lambda s: F.concat_ws("|", s["paper_title"], s["arxiv_id"], s["url"])
    )
    total = F.aggregate("sources", F.lit(0.0), lambda t, s: t + s["similarity"])
    return sources.select(
        "qid", F.array_join(listed, ";").alias("sources"), F.round(total, 3).alias("similarity")
    )


@query("WITH " + HITS_SQL + """
SELECT doc_id AS qid, count(hits.qid) AS context_chunks
FROM documents LEFT JOIN hits ON hits.qid = doc_id AND distance < 0.5 GROUP BY doc_id""")
def hit_counts(spark, folder):
    """Documents as questions, with the hits nearer than 0.5; many have none."""
    asked = table(spark, folder, "documents").select(F.col("doc_id").alias("qid"))
    hits = sr.knn_join(questions(spark, folder), papers(spark, folder), 5)
    return an.hit_counts(asked, hits.where("distance < 0.5"))


@query("WITH " + CONTEXTS_SQL + " SELECT qid, 'user' AS role, prompt FROM prompts")
def question_prompts(spark, folder):
    """Every question with its five nearest papers as a numbered context, and the prompt."""
    asked = questions(spark, folder)
    prompts = an.build_prompts(asked, an.build_context(_hits(spark, folder)))
    return prompts.select(
        "qid", F.col("messages")[0]["role"].alias("role"), F.col("messages")[0]["content"].alias("prompt")
    )


@query("WITH " + CONTEXTS_SQL + """
SELECT qid, CASE WHEN qid % 10 <> 0 THEN length(prompt) || ' characters' END AS answer,
       CASE WHEN qid % 10 = 0 THEN 'no model' END AS answer_error FROM (
  SELECT qid, replace(prompt, 'question: What', CASE WHEN qid % 10 = 0 THEN 'question: fail' ELSE 'question: What' END) AS prompt
  FROM prompts)""")
def answers(spark, folder):
    """A model that counts, and that fails on some questions."""
    failing = F.when(F.col("qid") % 10 == 0, F.regexp_replace("query", "^What", "fail"))
    asked = questions(spark, folder).withColumn("query", F.coalesce(failing, "query"))
    prompts = an.build_prompts(asked, an.build_context(_hits(spark, folder)))
    return an.answer(prompts, counting_completer).select("qid", "answer", "answer_error")


# Chat requests through all steps. The papers of this job are embedded by the
# hash embedder, like the questions.
CHAT_SQL = f"""WITH {PAPERS_SQL}, {TOPICS_SQL}, {CHAT_REQUESTS_SQL},
asked AS (
  SELECT request_id AS qid, {strip_sql("coalesce(query, '')")} AS query,
         coalesce(topic_id, id) AS topic_id, coalesce(top_k, 5) AS top_k
  FROM chat_requests LEFT JOIN topics ON topic = name),
texts AS (
  SELECT 'q' || qid AS key, query AS body FROM asked WHERE length(query) > 0
  UNION ALL SELECT 'p' || arxiv_id, abstract FROM papers),
{hash_embed_sql('body', 'key', 'texts')},
numbers AS (SELECT key, bucket, CAST(value AS DOUBLE) AS value FROM hashed),
lengths AS (SELECT key, sqrt(sum(value * value)) AS length FROM numbers GROUP BY key),
products AS (
  SELECT q.key AS qkey, p.key AS pkey, sum(q.value * p.value) AS product
  FROM numbers q JOIN numbers p ON q.bucket = p.bucket
  WHERE q.key LIKE 'q%' AND p.key LIKE 'p%' GROUP BY 1, 2),
pairs AS (
  SELECT qid, arxiv_id, title, abstract, top_k,
         round(1 - coalesce(product, 0) / (ql.length * pl.length), 12) AS distance
  FROM asked JOIN lengths ql ON ql.key = 'q' || qid
  JOIN papers ON asked.topic_id IS NULL OR asked.topic_id = papers.topic_id
  JOIN lengths pl ON pl.key = 'p' || arxiv_id
  LEFT JOIN products ON qkey = ql.key AND pkey = pl.key),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, arxiv_id) AS rk FROM pairs),
hits AS (SELECT * FROM ranked WHERE rk <= top_k),
found AS (
  SELECT qid, count(*) AS context_chunks, string_agg(arxiv_id, ',' ORDER BY rk) AS sources,
         sum(length('[Source ' || rk || ': ' || title || ' (arXiv:' || arxiv_id || ')]' || abstract) + 2)
           + count(*) - 1 AS context_length
  FROM hits GROUP BY qid)
SELECT asked.qid, CASE WHEN length(query) = 0 THEN 400 ELSE 200 END AS status,
       CASE WHEN length(query) = 0 THEN 'Query is required'
            WHEN found.qid IS NULL THEN 'I could not find relevant information to answer your query.'
            ELSE (context_length + length(query) + 179) || ' characters' END AS response,
       coalesce(sources, '') AS sources, CAST(coalesce(context_chunks, 0) AS BIGINT) AS context_chunks
FROM asked LEFT JOIN found USING (qid)"""


def hashed_papers(spark, folder):
    from paperlake.functions import hash_embedding

    return papers(spark, folder).withColumn("embedding", hash_embedding(F.col("abstract"), DIM))


def flat_responses(rows):
    return rows.select(
        "qid",
        "status",
        "response",
        F.array_join("sources.arxiv_id", ",").alias("sources"),
        F.col("context_chunks").cast("long").alias("context_chunks"),
    )


def _chat(spark, folder):
    return chat(
        chat_requests(spark, folder),
        cut(hashed_papers(spark, folder)),
        topics(spark, folder),
        lambda: hash_model(DIM),
        counting_completer,
        DIM,
    )


@query(CHAT_SQL)
def chat_responses(spark, folder):
    """Every conversation turn through the whole chat job."""
    return flat_responses(_chat(spark, folder))


@query(CHAT_SQL)
def written_responses(spark, folder):
    """The same, written as JSON and read back."""
    path = fresh_folder(spark, "responses")
    write_responses(_chat(spark, folder), path)
    layout = (
        "qid string, status int, response string, context_chunks long, "
        "sources array<struct<paper_title:string,arxiv_id:string,similarity:double,url:string>>"
    )
    return flat_responses(spark.read.schema(layout).json(path))
