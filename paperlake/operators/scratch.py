"""Rows kept as Parquet until a job is done, met again by number without a shuffle of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder
from .keys import ROW_BITS

# The number of a kept row, unique in its frame.
ROW = "_row"

# Up to this many rows that name kept ones by numbers alone are broadcast at a time, and of those with texts.
SLICE_ROWS = 1_000_000
TEXT_SLICE_ROWS = 100_000

# Rows of a file of kept ones, so that a slice is many tasks.
FILE_ROWS = 20_000


def with_row(df: DataFrame) -> DataFrame:
    return df.withColumn(ROW, F.monotonically_increasing_id())


def write_parts(path: str, *frames: DataFrame) -> None:
    """Frames of one layout as one compressed table, one frame after the other."""
    for i, frame in enumerate(frames):
        writer = frame.write.mode("append" if i else "overwrite")
        writer.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(path)


class Scratch:
    """Frames kept under a folder of their own.

    Like ``cut``, keeping materialises a frame and forgets its lineage; but it is
    compressed, narrow columns are read alone, and it can be dropped.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self._stored = spark, fresh_folder(spark, "scratch"), 0

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def keep(self, name: str, *frames: DataFrame) -> DataFrame:
        """One or more frames of one layout as one."""
        write_parts(self.folder(name), *frames)
        return self.spark.read.schema(frames[0].schema).parquet(self.folder(name))

    def store(self, df: DataFrame) -> DataFrame:
        """``keep`` under a name of its own, to stand in for ``cut``."""
        self._stored += 1
        return self.keep(f"stored-{self._stored}", df)

    def drop(self, name: str | None = None) -> None:
        """Delete one frame, or all; what was made of them and not kept can't be read any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path if name is None else self.folder(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def in_slices(stored: DataFrame, path: str, rows: DataFrame, most: int | None = None) -> list[DataFrame]:
    """``stored``, kept at ``path`` with ``ROW``, joined with the ``rows`` that name its rows.

    The result comes in slices to be worked off one after the other (at least
    one, be it empty). Each reads only files with rows it needs and broadcasts
    at most ``most`` of ``rows`` (``SLICE_ROWS``), so texts are never shuffled,
    however many rows there are. ``rows`` are read once per slice; hand in a
    frame that was kept or cut.
    """
    most = SLICE_ROWS if most is None else most
    part = F.shiftright(ROW, ROW_BITS)
    # one row per task that wrote the kept rows
    sizes = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [stored.where(F.lit(False)).join(F.broadcast(rows), ROW)]
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    files: dict[int, set[str]] = {}
    for row in stored.select(part.alias("part"), name.alias("file")).distinct().collect():
        files.setdefault(row["part"], set()).add(row["file"])
    groups: list[list[int]] = [[]]
    for one in sorted(sizes):
        if groups[-1] and sum(sizes[x] for x in groups[-1]) + sizes[one] > most:
            groups.append([])
        groups[-1].append(one)
    slices = []
    for parts in groups:
        paths = [f"{path}/{file}" for file in sorted(set().union(*(files.get(x, set()) for x in parts)))]
        wide = stored.sparkSession.read.schema(stored.schema).parquet(*paths) if paths else stored.where(F.lit(False))
        mine = rows.where(part.between(parts[0], parts[-1]))
        # more than one only where a single task wrote more than ``most`` of them
        shares = -(-sum(sizes[x] for x in parts) // most)
        for i in range(shares):
            some = mine if shares == 1 else mine.where(F.pmod(ROW, F.lit(shares)) == i)
            slices.append(wide.join(F.broadcast(some), ROW))
    return slices
