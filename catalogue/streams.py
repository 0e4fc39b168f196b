"""The file streams, run until their files are done."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.schema import PAPERS
from paperlake.session import cut, fresh_folder
from paperlake.sources import append_papers, append_topics, load_table, read_feed
from paperlake.streaming import chat_stream, ingest_stream

from .answers import CHAT_SQL, flat_responses, hashed_papers
from .base import DIM, chat_requests, query, topics
from .ingesting import ENTRIES_SQL, atom_entries, broken_entries, write_feed
from .models import counting_completer, hash_model


@query(f"WITH {ENTRIES_SQL} SELECT arxiv_id, title, abstract FROM entries")
def streamed_papers(spark, folder):
    """Feed files ingested in several micro-batches."""
    feed, stored, names, state = (
        fresh_folder(spark, x) for x in ("feed", "papers", "topics", "state")
    )
    files = write_feed(atom_entries(spark, folder), feed, 4)
    asked = cut(read_feed(spark, feed).select("feed").distinct().select(
        F.col("feed").alias("request_id"),
        F.lit(None).cast("string").alias("query"),
        F.lit(2**31 - 1).alias("max_results"),
        F.lit(None).cast("string").alias("topic_name"),
        "feed",
    ))
    ingest_stream(
        spark, feed, asked, stored, names, state, lambda: hash_model(DIM), DIM, files_per_batch=-(-files // 2)
    ).awaitTermination()
    return load_table(spark, stored, PAPERS).select("arxiv_id", "title", "abstract")


@query(CHAT_SQL)
def streamed_responses(spark, folder):
    """Request files answered as they arrive."""
    asked, stored, names, out, state = (
        fresh_folder(spark, x) for x in ("requests", "papers", "topics", "responses", "state")
    )
    chat_requests(spark, folder).write.json(asked)
    append_papers(
        hashed_papers(spark, folder).withColumn("published_date", F.lit(None).cast("date")), stored
    )
    append_topics(topics(spark, folder), names)
    chat_stream(
        spark, asked, stored, names, out, state, lambda: hash_model(DIM), counting_completer, DIM
    ).awaitTermination()
    layout = (
        "qid string, status int, response string, context_chunks long, "
        "sources array<struct<paper_title:string,arxiv_id:string,similarity:double,url:string>>"
    )
    return flat_responses(spark.read.schema(layout).json(out))


def _feed_requests(spark, feed, request, most):
    """One request for all files of a feed folder."""
    return read_feed(spark, feed).select("feed").distinct().select(
        F.lit(request).alias("request_id"),
        F.lit("documents").alias("query"),
        F.lit(most).alias("max_results"),
        F.lit(None).cast("string").alias("topic_name"),
        "feed",
    )


@query("""SELECT 'all' AS request_id, least(count(*), 50) AS fetched, least(count(*), 50) AS stored FROM documents""")
def streamed_ingest_limits(spark, folder):
    """A request whose files come in three micro-batches keeps its limit over all of them."""
    feed, stored, names, state, account = (
        fresh_folder(spark, x) for x in ("feed", "papers", "topics", "state", "account")
    )
    files = write_feed(atom_entries(spark, folder), feed, 3)
    asked = cut(_feed_requests(spark, feed, "all", 50))
    ingest_stream(
        spark, feed, asked, stored, names, state, lambda: hash_model(DIM), DIM,
        files_per_batch=-(-files // 3), account_path=account,
    ).awaitTermination()
    fetched = spark.read.schema("request_id string, total_papers_fetched long").json(f"{account}/responses")
    kept = load_table(spark, stored, PAPERS).agg(F.count("*").alias("stored"))
    return fetched.groupBy("request_id").agg(F.sum("total_papers_fetched").alias("fetched")).join(kept)


@query("""SELECT doc_id || 'v1' AS arxiv_id, 'bad date' AS reason FROM documents WHERE doc_id % 10 = 3""")
def streamed_rejects(spark, folder):
    """Entries with unreadable dates, set aside by the micro-batches with their reason."""
    feed, stored, names, state, account = (
        fresh_folder(spark, x) for x in ("feed", "papers", "topics", "state", "account")
    )
    files = write_feed(broken_entries(spark, folder), feed, 4)
    asked = cut(_feed_requests(spark, feed, "all", 2**31 - 1))
    ingest_stream(
        spark, feed, asked, stored, names, state, lambda: hash_model(DIM), DIM,
        files_per_batch=-(-files // 2), account_path=account,
    ).awaitTermination()
    rows = spark.read.schema("arxiv_id string, reasons array<string>").json(f"{account}/rejected")
    return rows.select("arxiv_id", F.array_join("reasons", "; ").alias("reason"))
