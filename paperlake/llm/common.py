"""Helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.session import fresh_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to Python at a time where they carry whole texts; Spark's own default is 10,000.
TEXT_ROWS = 250
_ROWS_AT_A_TIME = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """What is executed inside sends at most ``rows`` rows to Python at a time; the setting is put back after it."""
    if rows is None:
        yield
        return
    before = spark.conf.get(_ROWS_AT_A_TIME, None)
    spark.conf.set(_ROWS_AT_A_TIME, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ROWS_AT_A_TIME)
        else:
            spark.conf.set(_ROWS_AT_A_TIME, before)


def stored(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written once, as Parquet in the shared folder, and read back.

    The rows are then the same for every reader and survive lost executors.
    ``batch_rows`` bounds the rows that go to Python at a time.
    """
    path = fresh_folder(df.sparkSession, label)
    with batches_of(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``df`` with its columns under names of our own, and the columns that bring the old names back.

    Whatever names an operator then makes can't clash with the caller's.
    """
    names = df.columns
    aside = df.toDF(*[f"_in{i}" for i in range(len(names))])
    return aside, [F.col(f"_in{i}").alias(name) for i, name in enumerate(names)]


def id_bucket(column: Column | str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null for a null id."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % F.lit(buckets)


def byte_length(column: Column | str) -> Column:
    return F.octet_length(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))


def chunks(values: Iterable, weight, limit: int) -> Iterator[list]:
    """Consecutive values in lists of at most ``limit`` total weight, or single ones."""
    held: list = []
    total = 0
    for value in values:
        w = weight(value)
        if held and total + w > limit:
            yield held
            held, total = [], 0
        held.append(value)
        total += w
    if held:
        yield held
