"""Topics: lookup by name, get-or-create, foreign key, catalogue, filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ALL_TOPICS, BUILT_IN_TOPICS
from .keys import assign_ids, greatest_id
from .lookups import lookup


# Fixed value: how the description of a new topic begins.
DESCRIPTION = "Research papers about "


def describe(name: Column) -> Column:
    """Description given to a new topic."""
    return F.concat(F.lit(DESCRIPTION), name)


def resolve_topics(
    requests: DataFrame, topics: DataFrame, on_unknown: str = "all"
) -> DataFrame:
    """Fill ``topic_id`` from the topic name; a given id wins over a name.

    ``All Topics`` and an absent name mean no topic filter. So does an unknown
    name with ``on_unknown="all"``; with ``"none"`` it searches nothing. The
    column ``searchable`` says which requests are to be searched.
    """
    if on_unknown not in ("all", "none"):
        raise ValueError("on_unknown is 'all' or 'none'")
    name = F.when(F.col("topic") != ALL_TOPICS, F.col("topic"))
    names = topics.select(F.col("name").alias("_name"), F.col("id").alias("_found"))
    wanted = requests.withColumn("_name", F.when(F.col("topic_id").isNull(), name))
    found = lookup(wanted, names, "_name")
    unknown = F.col("_name").isNotNull() & F.col("_found").isNull()
    return found.withColumns({
        "topic_id": F.coalesce("topic_id", "_found"),
        "searchable": F.lit(True) if on_unknown == "all" else ~unknown,
    }).drop("_name", "_found")


def upsert_topics(names: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics for all ``name`` values: (the new rows, stored and new rows together).

    New topics get the next ids in the order of their names.
    """
    wanted = names.select("name").where(F.col("name").isNotNull()).distinct()
    missing = wanted.join(topics.select("name").distinct(), "name", "left_anti")
    new = assign_ids(missing, greatest_id(topics), ["name"]).select(
        F.col("id").cast("long").alias("id"), "name", describe(F.col("name")).alias("description")
    )
    return new, topics.unionByName(new, allowMissingColumns=True)


def with_topic(papers: DataFrame, topics: DataFrame) -> DataFrame:
    """Add ``topic_name``; null for a paper without a topic or with an unknown one."""
    names = topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic_name"))
    return lookup(papers, names, "topic_id")


def orphans(papers: DataFrame, topics: DataFrame) -> DataFrame:
    """Papers whose topic does not exist; having no topic is allowed."""
    ids = topics.select(F.col("id").alias("topic_id")).distinct()
    return lookup(papers.where(F.col("topic_id").isNotNull()), ids, "topic_id", "left_anti")


def topic_catalogue(topics: DataFrame) -> DataFrame:
    """Built-in and stored topic names, each once, at its first position.

    ``origin`` is 0 for built-in names and 1 for stored ones; stored names
    follow in the order of their ids.
    """
    built_in = topics.sparkSession.createDataFrame(
        [(0, i, n) for i, n in enumerate(BUILT_IN_TOPICS)], "origin int, place long, name string"
    )
    stored = topics.select(
        F.lit(1).alias("origin"), F.col("id").cast("long").alias("place"), "name"
    )
    first = F.min(F.struct("origin", "place")).alias("first")
    return (
        built_in.unionByName(stored)
        .groupBy("name")
        .agg(first)
        .select("name", "first.origin", "first.place")
        .orderBy("origin", "place")
    )


def filter_topic(
    papers: DataFrame, topic_id: int | None, topic_col: str = "topic_id"
) -> DataFrame:
    """Papers of one topic; all papers for ``None``. Topic 0 is a topic."""
    return papers if topic_id is None else papers.where(F.col(topic_col) == topic_id)


def search_terms(papers: DataFrame, query: str) -> DataFrame:
    """Papers in which every word of the query occurs, in any field and case."""
    fields = F.lower(F.concat_ws(" ", "title", "abstract", "authors", "categories"))
    for term in query.lower().split():
        papers = papers.where(fields.contains(term))
    return papers
