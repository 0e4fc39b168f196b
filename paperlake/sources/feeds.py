"""Saved Atom feeds: one row per entry, then typed paper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import FEED_ENTRY

# What stands in for an absent title or abstract.
NO_TITLE = "No title"
NO_ABSTRACT = "No abstract"


def with_position(entries: DataFrame) -> DataFrame:
    """Add ``position``, which grows with the place of an entry in its feed.

    A feed is read by one task from start to end, so a generated id does that.
    """
    return entries.withColumn("position", F.monotonically_increasing_id())


def read_feed(
    spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """Entries of all feed files under ``path``, with feed name and position.

    A stream has no positions; add them to each of its batches.
    """
    reader = spark.readStream if streaming else spark.read
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    entries = (
        reader.format("xml")
        .schema(FEED_ENTRY)
        .option("rowTag", "entry")
        .option("multiLine", True)
        .load(path)
        .select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("feed"))
    )
    return entries if streaming else with_position(entries)


def with_defaults(papers: DataFrame) -> DataFrame:
    """Replace an absent or empty title or abstract by its fixed text."""
    return papers.withColumns({
        "title": F.coalesce(F.nullif("title", F.lit("")), F.lit(NO_TITLE)),
        "abstract": F.coalesce(F.nullif("abstract", F.lit("")), F.lit(NO_ABSTRACT)),
    })


def papers_from_feed(entries: DataFrame) -> DataFrame:
    """Paper columns of feed entries; all other columns are kept.

    A missing id or an unreadable date stays null, for ``quarantine`` to set
    the row aside.
    """
    used = set(FEED_ENTRY.fieldNames())
    kept = [c for c in entries.columns if c not in used]
    return with_defaults(
        entries.select(
            *kept,
            tx.paper_id(F.col("id")).alias("arxiv_id"),
            tx.base_id(F.col("id")).alias("base_id"),
            tx.clean_text(F.col("title")).alias("title"),
            tx.join_authors(F.col("author")).alias("authors"),
            tx.clean_text(F.col("summary")).alias("abstract"),
            tx.published_date(F.col("published")).alias("published_date"),
            tx.join_categories(F.col("category")).alias("categories"),
        )
    )
