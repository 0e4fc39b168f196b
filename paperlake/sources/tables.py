"""The papers and topics tables, by catalog name or by path."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PAPERS, TOPICS


def _is_path(target: str) -> bool:
    return "/" in target


def load_table(
    spark: SparkSession, target: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """A stored table. With a schema, a path that holds nothing yet is empty."""
    if not _is_path(target):
        return spark.table(target)
    if schema is None:
        return spark.read.parquet(target)
    try:
        return spark.read.schema(schema).parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_time(spark: SparkSession) -> datetime:
    return spark.range(1).select(F.current_timestamp()).first()[0]


def _append(
    df: DataFrame, target: str, schema: T.StructType, at: datetime | None = None
) -> DataFrame:
    # a repeated run adds nothing, and then should leave no empty files
    empty = df.isEmpty()
    # one time for all rows, and the same in the returned frame
    now = at or write_time(df.sparkSession)
    rows = df.withColumn("created_at", F.lit(now)).select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)
    )
    if empty:
        return rows
    if _is_path(target):
        rows.write.mode("append").parquet(target)
    else:
        rows.write.mode("append").insertInto(target)
    return rows


def append_papers(df: DataFrame, target: str, at: datetime | None = None) -> DataFrame:
    """Append rows that already passed ``new_papers``; returns what was written.

    Parquet has no unique columns, so ids stay unique for one writer at a time
    only. Hand in a frame whose lineage was cut: the returned one reads it again.
    ``at`` is the time they carry, for rows that come in several frames.
    """
    return _append(df, target, PAPERS, at)


def append_topics(df: DataFrame, target: str) -> DataFrame:
    return _append(df, target, TOPICS)


def ensure_tables(spark: SparkSession, database: str = "default") -> tuple[str, str]:
    """Create ``papers`` and ``topics`` in ``database`` where they are absent."""
    names = []
    for name, schema in (("papers", PAPERS), ("topics", TOPICS)):
        full = f"{database}.{name}"
        if not spark.catalog.tableExists(full):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({columns}) USING parquet")
        names.append(full)
    return names[0], names[1]


def write_responses(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per row."""
    df.write.mode(mode).json(path)
