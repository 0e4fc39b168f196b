"""Surrogate keys without a single-task window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .lookups import lookup

# Layout of monotonically_increasing_id: partition number above, row number below.
ROW_BITS = 33


def greatest_id(table: DataFrame, id_col: str = "id") -> int:
    """The greatest key in use, 0 for an empty table."""
    return table.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]


def assign_ids(
    new: DataFrame,
    current_max: int,
    order_by: list[str],
    id_col: str = "id",
    store: Callable[[DataFrame], DataFrame] = cut,
) -> DataFrame:
    """Number rows from ``current_max + 1`` without gaps, in the given order.

    The rows are range-sorted and materialised once with their partition and
    place in it, so a lost executor cannot shift a key. The rows before each
    partition are summed over one row per partition and joined back. No step
    gathers rows by a key, so the order may begin with a column of few values.
    ``store`` is what materialises.
    """
    tagged = store(new.orderBy(*order_by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", ROW_BITS)
    place = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    # one row per partition of the sort, so its size is that of the cluster
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(id_col, F.col("_start") + place + F.lit(current_max + 1))
        .drop("_at", "_part", "_start")
    )


def place_in_group(
    rows: DataFrame,
    group: str,
    order_by: list[str],
    out: str = "place",
    store: Callable[[DataFrame], DataFrame] = cut,
) -> DataFrame:
    """``row_number`` per group that stays distributed inside a hot group.

    Rows are numbered over all groups in order, and the number of the first row
    of its group is taken off. Rows with a null group are a group too.
    """
    # a struct of a null is not null, so the join keeps that group
    numbered = assign_ids(rows, 0, [group, *order_by], out, store).withColumn("_group", F.struct(group))
    first = numbered.groupBy("_group").agg(F.min(out).alias("_first"))
    return (
        lookup(numbered, first, "_group", "inner")
        .withColumn(out, F.col(out) - F.col("_first") + 1)
        .drop("_group", "_first")
    )
