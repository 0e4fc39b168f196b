"""Questions in, answers out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.answer import Completer, answer, build_prompts, chat_responses, gather
from ..operators.embed import Embedder, embed
from ..operators.requests import normalize_requests, validate_requests
from ..operators.search import knn_join, with_text
from ..operators.topics import resolve_topics
from ..schema import EMBEDDING_DIM
from ..session import cut


def hits_for(
    questions: DataFrame, papers: DataFrame, centroids: DataFrame | None = None
) -> DataFrame:
    """Ranked hits with their texts, as many per question as its ``top_k`` says.

    ``questions``: qid, vector, topic_id, top_k.
    """
    return with_text(cut(knn_join(questions, papers, "top_k", "topic_id", centroids)), papers)


def chat(
    requests: DataFrame,
    papers: DataFrame,
    topics: DataFrame,
    load_embedder: Callable[[], Embedder],
    load_completer: Callable[[], Completer],
    dim: int = EMBEDDING_DIM,
    on_unknown: str = "all",
    sep: str = "\n",
    centroids: DataFrame | None = None,
) -> DataFrame:
    """Answer a table of chat requests: qid, status, response, sources, context_chunks.

    The models see only requests that can be answered: the embedder those with a
    query, the chat model those with hits. Both results are materialised, so
    neither model is called twice for a row. Each request is answered for itself,
    also where two have one id.
    """
    named = cut(
        normalize_requests(requests, "chat").withColumn("_qid", F.monotonically_increasing_id())
    )
    asked = named.withColumn("qid", F.col("_qid")).drop("request_id", "_qid")
    valid, empty = validate_requests(asked)
    resolved = resolve_topics(valid, topics, on_unknown)
    vectors = cut(embed(resolved, "query", load_embedder, dim, out="vector"))
    searched = vectors.where(F.col("searchable") & F.col("vector").isNotNull())
    hits = hits_for(searched.select("qid", "vector", "topic_id", "top_k"), papers, centroids)
    answered = cut(answer(build_prompts(vectors, gather(hits, sep)), load_completer))
    rows = vectors.select("qid", "query", F.col("embed_error").alias("error")).unionByName(
        empty.select("qid", F.lit("").alias("query"), F.lit(None).cast("string").alias("error"))
    )
    answers = chat_responses(rows, answered)
    return answers.join(named.select("_qid", "request_id"), F.col("qid") == F.col("_qid")).select(
        F.col("request_id").alias("qid"), *(c for c in answers.columns if c != "qid")
    )
