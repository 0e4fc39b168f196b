"""Joins with a table of keys, safe against hot and null keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fits

# Up to this many rows of a lookup table are broadcast.
LOOKUP_ROWS = 100_000

# A key with more rows than this is dealt over several tasks, so many to each.
HOT_ROWS = 50_000

# So many hot keys are dealt out at most.
HOT_KEYS = 10_000

# Rows with a null key match nothing and are dealt over this many tasks.
NULL_SALTS = 1024


def hot_keys(rows: DataFrame, key: str, hot_rows: int | None = None) -> list[tuple]:
    """(key, tasks) of every key of ``rows`` that is too frequent for one task.

    Counts are summed in Spark, with partial sums in each task. At most
    ``HOT_KEYS`` come back, the most frequent; a key beyond them has less than
    that fraction of all rows.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    found = counts.where(F.col("_n") > limit).orderBy(F.desc("_n")).limit(HOT_KEYS).collect()
    return [(row[key], -(-row["_n"] // limit)) for row in found]


def salted(
    rows: DataFrame, table: DataFrame, key: str, how: str = "left", hot_rows: int | None = None
) -> DataFrame:
    """Join ``rows`` with ``table`` on ``key``, the hot keys of ``rows`` dealt over tasks.

    A hot key gets as many salts as its own count asks for; its rows of
    ``table`` are repeated so often, all others stay single. Rows that are equal
    in every column share a salt.
    """
    hot = hot_keys(rows, key, hot_rows)
    spread = F.xxhash64(*rows.columns)
    own: Column = F.lit(0)
    if hot:
        kind = rows.schema[key].dataType
        known = rows.sparkSession.createDataFrame(
            hot, f"`{key}` {kind.simpleString()}, _salts int"
        )
        rows = rows.join(F.broadcast(known), key, "left")
        table = table.join(F.broadcast(known), key, "left")
        own = F.coalesce(F.pmod(spread, F.col("_salts")).cast("int"), own)
        last = F.coalesce("_salts", F.lit(1)) - 1
        table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_salts")
    else:
        table = table.withColumn("_salt", F.lit(0))
    aside = (-1 - F.pmod(spread, F.lit(NULL_SALTS))).cast("int")
    rows = rows.withColumn("_salt", F.when(F.col(key).isNull(), aside).otherwise(own))
    if hot:
        rows = rows.drop("_salts")
    return rows.join(table, [key, "_salt"], how).drop("_salt")


def lookup(
    rows: DataFrame, table: DataFrame, key: str, how: str = "left", most: int | None = None
) -> DataFrame:
    """Join ``rows`` with ``table``, whose ``key`` has few rows per value, mostly one.

    A table proven small is broadcast and ``rows`` are not shuffled. Otherwise
    the join is ``salted``: neither a key nor a null shared by a third of the
    rows ends up in one task.
    """
    if fits(table, LOOKUP_ROWS if most is None else most):
        return rows.join(F.broadcast(table), key, how)
    return salted(rows, table, key, how)
