"""What a job is about to do, written before it does it, so that a repeat does and reports the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import write_parts
from ..sources.tables import load_table

DONE = "print long, rows long"

# Changed with the columns of the frames, so that a journal of older code is written anew.
LAYOUT = 2


def fingerprint(*frames: DataFrame) -> tuple[int, int]:
    """A number that depends on all rows of the frames, in any order, and how many there are."""
    total, rows = LAYOUT, 0
    for i, frame in enumerate(frames):
        found = frame.agg(
            F.coalesce(F.bit_xor(F.xxhash64(F.lit(i), *frame.columns)), F.lit(0)).alias("print"),
            F.count("*").alias("rows"),
        ).first()
        total, rows = total ^ found["print"], rows + found["rows"]
    return total, rows


class Journal:
    """Frames of one batch under ``path``, valid once all are written and only for the input they were made of."""

    def __init__(self, spark: SparkSession, path: str, of: tuple[int, int]):
        self.spark, self.path, self.of = spark, path.rstrip("/"), of

    def is_written(self) -> bool:
        done = load_table(self.spark, f"{self.path}/done", DONE).collect()
        return [tuple(row) for row in done] == [self.of]

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, frames: dict[str, list[DataFrame]]) -> None:
        """Each of the frames may come in parts."""
        # an older mark would vouch for a half-written journal
        self.spark.createDataFrame([], DONE).write.mode("overwrite").parquet(f"{self.path}/done")
        for name, parts in frames.items():
            write_parts(self.folder(name), *parts)
        self.spark.createDataFrame([self.of], DONE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.folder(name))
