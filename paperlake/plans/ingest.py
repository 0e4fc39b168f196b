"""Feed entries in, new rows of the papers and topics tables out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import embed_text
from ..operators.embed import Embedder, embed
from ..operators.ingest import (
    ARRIVAL,
    WINDOW_ROWS,
    dedupe_batch,
    ingest_summary,
    limit_per_request,
    new_papers,
    preview,
)
from ..operators.keys import assign_ids, greatest_id
from ..operators.lookups import lookup
from ..operators.requests import normalize_requests, with_status
from ..operators.scratch import ROW, TEXT_SLICE_ROWS, Scratch, in_slices, with_row
from ..operators.topics import upsert_topics
from ..schema import EMBEDDING_DIM, PAPERS, TOPICS
from ..session import cut
from ..sources.feeds import papers_from_feed
from ..sources.quarantine import paper_rules, quarantine, reasons_of, topic_rules, vector_rules
from ..sources.tables import append_papers, append_topics, load_table, write_time
from .journal import Journal, fingerprint

# Fixed value: papers of a request that its response shows.
PREVIEW_ROWS = 5


@dataclass
class IngestResult:
    written: DataFrame  # the new rows of the papers table
    rejected: DataFrame  # rows set aside, with their reasons
    responses: DataFrame  # one row per request
    scratch: Scratch | None = None  # what the frames are read from

    def release(self) -> None:
        """Free the disk that the frames take; they can't be read after it."""
        if self.scratch is not None:
            self.scratch.drop()


PARTS = ("written", "asked_by", "rejected", "responses")


def _entry_key() -> list[str]:
    return ["request_id", "feed", "position"]


def ingest(
    requests: DataFrame,
    entries: DataFrame,
    papers_table: str,
    topics_table: str,
    load_embedder: Callable[[], Embedder],
    dim: int = EMBEDDING_DIM,
    used: DataFrame | None = None,
    journal: str | None = None,
) -> IngestResult:
    """Store the papers of saved feeds that are not stored yet.

    ``requests`` name in ``feed`` the file that holds their entries (a request
    with several files has a row for each), ``entries`` come from ``read_feed``.
    Topics are written before papers and papers are
    compared with the stored table, so a run repeated after a failure adds only
    what the first one left out. The model sees only rows that will be stored.
    ``used`` (request_id, used) says how many entries of a request earlier runs
    took; they count towards its ``max_results``.

    The frames of the result are read from scratch files, which stay until its
    ``release`` is called.

    With a ``journal``, a folder for this batch alone, the new rows, the rows set
    aside and the responses are written there before any paper is stored. A run
    repeated with the same requests and entries then stores what the first one
    did not get to, and returns the first one's rows and responses; a journal of
    other input, or one that was not finished, is written anew.
    """
    spark = entries.sparkSession
    scratch = Scratch(spark)
    try:
        if journal is None:
            result, parts, _ = _prepared(
                requests, entries, papers_table, topics_table, load_embedder, dim, used, scratch
            )
            _append_parts(spark, parts, papers_table)
            return result
        book = Journal(spark, journal, fingerprint(requests, entries))
        if not book.is_written():
            result, parts, asked_by = _prepared(
                requests, entries, papers_table, topics_table, load_embedder, dim, used, scratch
            )
            frames = (parts, [asked_by], [result.rejected], [result.responses])
            book.write(dict(zip(PARTS, frames, strict=True)))
            scratch.drop()
        written, asked_by, rejected, responses = (book.read(name) for name in PARTS)
        stored = load_table(spark, papers_table, PAPERS)
        left = scratch.keep("left", new_papers(written.select(ROW, "arxiv_id"), stored).select(ROW))
        _append_parts(spark, in_slices(written, book.folder("written"), left), papers_table)
    except BaseException:
        scratch.drop()
        raise
    scratch.drop()
    return IngestResult(_whole(written, asked_by), rejected, responses)


def _whole(written: DataFrame, asked_by: DataFrame) -> DataFrame:
    return written.join(asked_by, ROW).drop(ROW)


def _append_parts(spark: SparkSession, parts: list[DataFrame], papers_table: str) -> None:
    now = write_time(spark)
    for part in parts:
        append_papers(part, papers_table, now)


def _prepared(
    requests: DataFrame,
    entries: DataFrame,
    papers_table: str,
    topics_table: str,
    load_embedder: Callable[[], Embedder],
    dim: int,
    used: DataFrame | None,
    scratch: Scratch,
) -> tuple[IngestResult, list[DataFrame], DataFrame]:
    """Topics made, papers cleaned, checked, embedded and numbered; all but storing them.

    Texts are kept twice at most, as read and with their vectors, and not
    shuffled but where small limits are cut: all steps between move keys and the
    numbers of rows. The new rows also come in slices, to be stored in turn, and
    what was asked for them apart.
    """
    spark = entries.sparkSession
    asked = cut(normalize_requests(requests, "ingest"))
    named, misnamed = quarantine(
        asked.withColumn("name", F.col("topic_name")), topic_rules()
    )
    wanted = named.select("request_id", "feed", "max_results", "topic_name")
    if used is not None:
        left = F.col("max_results") - F.coalesce("used", F.lit(0))
        wanted = lookup(wanted, used, "request_id").select(
            "request_id", "feed", F.greatest(left, F.lit(0)).cast("int").alias("max_results"), "topic_name"
        )
    most = wanted.agg(F.coalesce(F.max("max_results"), F.lit(0))).first()[0]
    papers = papers_from_feed(entries)
    of_request = ["request_id", "max_results", "topic_name"]
    columns = ["feed", *(c for c in papers.columns if c != "feed"), *of_request]

    def keys(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(ROW, "feed", "position", "arxiv_id", *more, reasons_of(paper_rules()).alias("reasons"))

    # positions are fixed here: reading the files again could number them anew
    if most > WINDOW_ROWS:
        feeds = wanted.select("feed").distinct()
        texts = scratch.keep("texts", with_row(lookup(papers, feeds, "feed", "inner")))
        offered = lookup(keys(texts), wanted, "feed", "inner")
        batch = scratch.keep("batch", limit_per_request(offered, at_most=most, store=scratch.store))
    else:
        # few rows of each request are left, and only those are kept
        offered = lookup(papers, wanted, "feed", "inner")
        texts = scratch.keep("texts", with_row(limit_per_request(offered, at_most=most)))
        batch = scratch.keep("batch", keys(texts, *of_request, "place"))

    is_sound = F.size("reasons") == 0
    sound, broken = batch.where(is_sound).drop("reasons"), batch.where(~is_sound)
    stored_topics = load_table(spark, topics_table, TOPICS)
    # a request without entries makes no topic
    names = batch.select(F.col("topic_name").alias("name"))
    new_topics, _ = upsert_topics(names, stored_topics)
    append_topics(new_topics, topics_table)
    topics = load_table(spark, topics_table, TOPICS).select(
        F.col("name").alias("topic_name"), F.col("id").alias("topic_id")
    )
    first = batch.where(F.col("place") <= PREVIEW_ROWS).select(ROW, *of_request[:1])
    shown = texts.drop(*of_request).select(ROW, "feed", "position", "title", "authors", "arxiv_id", "published_date")
    previews = scratch.keep("previews", preview(lookup(shown, first, ROW, "inner"), PREVIEW_ROWS))

    stored = load_table(spark, papers_table, PAPERS)
    # two requests may name one feed; the lesser id then has the paper
    order = (*ARRIVAL, "request_id")
    fresh = scratch.keep("fresh", new_papers(dedupe_batch(sound, order=order), stored))

    def embedded_part(rows: DataFrame) -> DataFrame:
        with_text = rows.withColumn("_text", embed_text(F.col("title"), F.col("abstract")))
        made = embed(with_text, "_text", load_embedder, dim).drop("_text")
        return made.withColumn("vector_reasons", reasons_of(vector_rules(dim=dim)))

    plain = texts.drop(*of_request, "place")
    chosen = in_slices(plain, scratch.folder("texts"), fresh.select(ROW))
    embedded = scratch.keep("embedded", *(embedded_part(part) for part in chosen))
    tried = embedded.select(ROW, "embed_error", F.col("vector_reasons").alias("reasons"))
    tried = scratch.keep("tried", fresh.select(ROW, *_entry_key(), *of_request[1:], "place").join(tried, ROW))
    made, unmade = tried.where(is_sound).drop("reasons"), tried.where(~is_sound)
    vectorless = [F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embed_error")]
    aside = [
        part.select(*columns, "reasons", *vectorless)
        for part in in_slices(
            plain, scratch.folder("texts"), broken.select(ROW, *of_request, "reasons"), TEXT_SLICE_ROWS
        )
    ] + [
        part.select(*columns, "reasons", "embedding", "embed_error")
        for part in in_slices(
            embedded, scratch.folder("embedded"), unmade.select(ROW, *of_request, "reasons"), TEXT_SLICE_ROWS
        )
    ]
    rejected = scratch.keep("rejected", *aside)
    scratch.drop("texts")
    keyed = assign_ids(
        lookup(made.select(ROW, *_entry_key(), "topic_name"), topics, "topic_name"),
        greatest_id(stored), list(order), store=scratch.store,
    )
    ids = scratch.keep("ids", keyed.select(ROW, "topic_id", "id"))

    reason = F.array_join("reasons", "; ")
    failed = broken.select(*_entry_key(), reason.alias("reason")).unionByName(
        unmade.select(*_entry_key(), F.coalesce("embed_error", reason).alias("reason"))
    )
    marks = failed.withColumn("outcome", F.lit("failed")).unionByName(
        made.select(*_entry_key())
        .withColumn("reason", F.lit(None).cast("string"))
        .withColumn("outcome", F.lit("stored"))
    )
    outcomes = (
        batch.select(*_entry_key())
        .join(marks, _entry_key(), "left")
        .withColumn("outcome", F.coalesce("outcome", F.lit("skipped")))
    )
    responses = scratch.keep("responses", _responses(asked, misnamed, previews, outcomes))
    parts = in_slices(embedded.drop("vector_reasons"), scratch.folder("embedded"), ids)
    # request and place of the new rows; the rows themselves are broadcast numbers only
    asked_by = scratch.keep("asked_by", made.select(ROW, *of_request, "place"))
    written = embedded.drop("vector_reasons").join(ids, ROW)
    return IngestResult(_whole(written, asked_by), rejected, responses, scratch), parts, asked_by


def _responses(
    asked: DataFrame, misnamed: DataFrame, previews: DataFrame, outcomes: DataFrame
) -> DataFrame:
    rows = (
        asked.select("request_id", F.col("topic_name").alias("topic")).distinct()
        .join(ingest_summary(outcomes), "request_id", "left")
        .join(previews, "request_id", "left")
        .join(
            misnamed.select("request_id", F.array_join("reasons", "; ").alias("error")).distinct(),
            "request_id",
            "left",
        )
    )
    counted = rows.withColumns({
        c: F.coalesce(c, F.lit(0)) for c in ("fetched", "processed", "skipped", "failed")
    })
    return with_status(counted, "ingest").select(
        "request_id",
        "status",
        "message",
        F.col("fetched").alias("total_papers_fetched"),
        F.col("processed").alias("processed_count"),
        "skipped",
        "failed",
        "failures",
        "topic",
        "papers",
    )
