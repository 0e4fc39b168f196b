"""Which papers of a batch are new, and the account of what became of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, fits
from .keys import place_in_group

# Up to this many rows per group, Spark limits each task's groups before a shuffle
# (the default of spark.sql.optimizer.windowGroupLimitThreshold).
WINDOW_ROWS = 1000

# Up to this many ids of a batch are broadcast to the stored table.
BATCH_ROWS = 500_000

ARRIVAL = ("feed", "position")


def limit_per_request(
    rows: DataFrame,
    request: str = "request_id",
    limit: str = "max_results",
    order: tuple[str, ...] = ARRIVAL,
    at_most: int | None = None,
    store: Callable[[DataFrame], DataFrame] = cut,
) -> DataFrame:
    """The first rows of each request, as many as its ``limit`` column says.

    ``at_most`` is the greatest of the limits (found if not given). A small one
    lets each task drop later rows before the shuffle, so a request with very
    many rows is not gathered whole. With a greater one rows are numbered by a
    range sort, which splits such a request over many tasks. Both ways keep the
    same rows, those without a request included, and ``place`` is a long.
    ``store`` is what materialises the sorted rows.
    """
    if at_most is None:
        at_most = rows.agg(F.coalesce(F.max(limit), F.lit(0))).first()[0]
    if at_most > WINDOW_ROWS:
        placed = place_in_group(rows, request, list(order), store=store)
    else:
        place = F.row_number().over(Window.partitionBy(request).orderBy(*order))
        first = rows.withColumn("place", place).where(F.col("place") <= int(at_most))
        placed = first.withColumn("place", F.col("place").cast("long"))
    return placed.where(F.col("place") <= F.col(limit))


def dedupe_batch(
    batch: DataFrame, key: str = "arxiv_id", order: tuple[str, ...] = ARRIVAL
) -> DataFrame:
    """One row per key, the first to arrive. Each task sends at most one row per key."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return batch.withColumn("_turn", turn).where(F.col("_turn") <= 1).drop("_turn")


def new_papers(
    batch: DataFrame, papers: DataFrame, key: str = "arxiv_id", batch_rows: int = BATCH_ROWS
) -> DataFrame:
    """Rows of a batch without repeats whose key is not stored yet.

    Only the key of the stored table is read. A batch proven small is sent to
    that scan, so the stored keys are not shuffled; otherwise both sides are
    shuffled by key, the stored one reduced to distinct keys first.
    """
    stored = papers.select(key)
    if fits(batch, batch_rows):
        mine = F.broadcast(batch.select(key))
        seen = stored.join(mine, key, "left_semi").distinct()
        # no more keys than the batch has rows
        return batch.join(F.broadcast(seen), key, "left_anti")
    return batch.join(stored.distinct(), key, "left_anti")


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """Per request: fetched, processed, skipped, failed, and failures by reason.

    ``outcomes``: request_id, outcome (``stored``, ``skipped``, ``failed``) and
    reason. Rows are counted by reason first, so a list holds one entry per
    reason, not one per row.
    """
    counted = outcomes.groupBy("request_id", "outcome", "reason").agg(F.count("*").alias("n"))

    def total(outcome: str):
        return F.sum(F.when(F.col("outcome") == outcome, F.col("n")).otherwise(0))

    reason = F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))
    return counted.groupBy("request_id").agg(
        F.sum("n").alias("fetched"),
        total("stored").alias("processed"),
        total("skipped").alias("skipped"),
        total("failed").alias("failed"),
        F.array_sort(F.collect_list(reason)).alias("failures"),
    )


def preview(
    rows: DataFrame,
    n: int,
    fields: tuple[str, ...] = ("title", "authors", "arxiv_id", "published_date"),
    request: str = "request_id",
    order: tuple[str, ...] = ARRIVAL,
) -> DataFrame:
    """The first ``n`` rows of each request as an array of ``fields``."""
    place = F.row_number().over(Window.partitionBy(request).orderBy(*order))
    first = rows.withColumn("_place", place).where(F.col("_place") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_place", *fields)))
    return first.groupBy(request).agg(
        F.transform(listed, lambda p: F.struct(*(p[f].alias(f) for f in fields))).alias("papers")
    )
