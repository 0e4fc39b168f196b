"""File streams: each micro-batch runs the whole job, then its files are done.

Neither job keeps streaming state. A micro-batch of papers writes what it will
store and report to a journal before it stores any paper, so one that is run
again after a failure stores the rest and reports what the first run would have;
answers are written to a folder of their micro-batch, which a repeat replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.answer import Completer
from ..operators.embed import Embedder
from ..plans.chat import chat
from ..plans.ingest import ingest
from ..schema import EMBEDDING_DIM, TOPICS
from ..session import cut
from ..sources.feeds import read_feed, with_position
from ..sources.requests import name_requests, read_requests
from ..sources.tables import load_table, write_responses

USED = "request_id string, used long, batch int"


def ingest_stream(
    spark: SparkSession,
    feed_path: str,
    requests: DataFrame,
    papers_table: str,
    topics_table: str,
    state_path: str,
    load_embedder: Callable[[], Embedder],
    dim: int = EMBEDDING_DIM,
    files_per_batch: int | None = None,
    account_path: str | None = None,
) -> StreamingQuery:
    """Ingest the feed files that are new under ``feed_path``, then stop.

    ``requests`` say which feeds belong to which topic, as in ``plans.ingest``.
    Each micro-batch writes under ``account_path`` (default: beside the state)
    its responses, the rows it set aside, and the entries it took of each
    request, which count towards ``max_results`` in the batches after it, and
    before all that a journal. A repeated micro-batch replaces what it wrote by
    the same.
    """
    account = (account_path or f"{state_path.rstrip('/')}-account").rstrip("/")

    def store(entries: DataFrame, batch_id: int) -> None:
        placed = with_position(entries)
        before = load_table(spark, f"{account}/used", USED).where(F.col("batch") < batch_id)
        used = before.groupBy("request_id").agg(F.sum("used").alias("used"))
        journal = f"{account}/journal/batch={batch_id}"
        result = ingest(requests, placed, papers_table, topics_table, load_embedder, dim, used, journal)
        responses = result.responses
        write_responses(responses, f"{account}/responses/batch={batch_id}", mode="overwrite")
        write_responses(result.rejected, f"{account}/rejected/batch={batch_id}", mode="overwrite")
        took = responses.select("request_id", F.col("total_papers_fetched").cast("long").alias("used"))
        took.write.mode("overwrite").parquet(f"{account}/used/batch={batch_id}")

    entries = read_feed(spark, feed_path, streaming=True, files_per_batch=files_per_batch)
    return (
        entries.writeStream.foreachBatch(store)
        .option("checkpointLocation", state_path)
        .trigger(availableNow=True)
        .start()
    )


def chat_stream(
    spark: SparkSession,
    request_path: str,
    papers_table: str,
    topics_table: str,
    out_path: str,
    state_path: str,
    load_embedder: Callable[[], Embedder],
    load_completer: Callable[[], Completer],
    dim: int = EMBEDDING_DIM,
    on_unknown: str = "all",
) -> StreamingQuery:
    """Answer the request files that are new under ``request_path``, then stop."""

    def respond(requests: DataFrame, batch_id: int) -> None:
        answers = chat(
            cut(name_requests(requests)),
            load_table(spark, papers_table),
            load_table(spark, topics_table, TOPICS),
            load_embedder,
            load_completer,
            dim,
            on_unknown,
        )
        write_responses(answers, f"{out_path}/batch={batch_id}", mode="overwrite")

    requests = read_requests(spark, request_path, "chat", streaming=True)
    return (
        requests.writeStream.foreachBatch(respond)
        .option("checkpointLocation", state_path)
        .trigger(availableNow=True)
        .start()
    )
