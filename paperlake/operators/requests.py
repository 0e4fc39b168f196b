"""Requests: defaults, checks, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, title_case
from ..schema import BATCH_BOUNDS, DEFAULT_MAX_RESULTS, DEFAULT_QUERY, DEFAULT_TOP_K

# The texts of answers that carry no model output.
QUERY_REQUIRED = "Query is required"
NO_PAPERS = "No papers found"
NO_HITS = "I could not find relevant information to answer your query."
PROCESSED = "Successfully processed %d papers"


def normalize_requests(requests: DataFrame, kind: str) -> DataFrame:
    """Fill the fields a request of ``kind`` ``"ingest"`` or ``"chat"`` left out."""
    if kind == "chat":
        return requests.withColumns({
            "query": F.coalesce("query", F.lit("")),
            "top_k": F.coalesce("top_k", F.lit(DEFAULT_TOP_K)),
        })
    query = F.coalesce("query", F.lit(DEFAULT_QUERY))
    return requests.withColumns({
        "query": query,
        "max_results": F.coalesce("max_results", F.lit(DEFAULT_MAX_RESULTS)),
        "topic_name": F.coalesce("topic_name", title_case(query)),
    })


def validate_requests(
    requests: DataFrame, count_col: str | None = None, bounds: tuple[int, int] = BATCH_BOUNDS
) -> tuple[DataFrame, DataFrame]:
    """Split into requests with a query (white space around it removed) and the rest.

    ``count_col`` names a count to be kept within ``bounds``, as the entry form
    does; requests that come by file are not bounded unless it is named.
    """
    trimmed = requests.withColumn("query", strip(F.col("query")))
    if count_col is not None:
        low, high = bounds
        inside = F.least(F.greatest(F.col(count_col), F.lit(low)), F.lit(high))
        trimmed = trimmed.withColumn(count_col, inside)
    asked = F.coalesce(F.length("query") > 0, F.lit(False))
    rejected = trimmed.where(~asked).withColumns({
        "status": F.lit(400),
        "error": F.lit(QUERY_REQUIRED),
    })
    return trimmed.where(asked), rejected


def chat_status(query: Column, error: Column) -> Column:
    return F.when(F.length(query) == 0, 400).when(error.isNotNull(), 500).otherwise(200)


def ingest_status(fetched: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), 500).when(fetched == 0, 404).otherwise(200)


def with_status(requests: DataFrame, kind: str) -> DataFrame:
    """Add ``status`` and ``message`` to request rows.

    Ingest rows carry ``fetched`` and ``error``; chat rows ``query``, ``error``,
    ``context_chunks`` and ``answer``. 400: no query, 404: no papers, 500: any
    other error, else 200. A question without hits is answered by a fixed text.
    """
    if kind == "ingest":
        status = ingest_status(F.col("fetched"), F.col("error"))
        texts = requests.withColumn("status", status)
        return texts.withColumn(
            "message",
            F.when(F.col("status") == 404, NO_PAPERS)
            .when(F.col("status") == 500, F.col("error"))
            .otherwise(F.format_string(PROCESSED, F.col("processed"))),
        )
    status = chat_status(F.coalesce("query", F.lit("")), F.col("error"))
    return requests.withColumn("status", status).withColumn(
        "message",
        F.when(F.col("status") == 400, QUERY_REQUIRED)
        .when(F.col("status") == 500, F.col("error"))
        .when(F.coalesce("context_chunks", F.lit(0)) == 0, NO_HITS)
        .otherwise(F.col("answer")),
    )
