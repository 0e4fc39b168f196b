"""An index of papers by cell that lives through appends.

Under its path are ``cells``, the papers that have a vector, stored by cell with
their angle to its centroid, and ``centroids``, of which the last version counts.
A cell keeps its number and its centroid for good, so stored angles stay true:
a cell that has grown too large is split by moving papers to new cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import blocks
from .ann import CELL_PAPERS, TRAIN_ROWS, small_k_means, train_cells, write_cells

# A cell with more papers than this is to be split, and into so many at most.
MOST_PAPERS = 4 * CELL_PAPERS
MOST_PARTS = 64


class CellIndex:
    """Papers by cell, and the centroids of the cells; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, papers: DataFrame, path: str, centroids: DataFrame | None = None, dim: int | None = None) -> CellIndex:
        """Index ``papers`` (arxiv_id, embedding and whatever else) by given or newly trained cells."""
        index = cls(papers.sparkSession, path)
        index._write_centroids(train_cells(papers, dim=dim) if centroids is None else centroids, 0)
        write_cells(papers, index.centroids(), f"{index.path}/cells")
        return index

    def papers(self) -> DataFrame:
        """All indexed papers with ``cell`` and ``angle``."""
        return self.spark.read.parquet(f"{self.path}/cells")

    def centroids(self) -> DataFrame:
        every = self.spark.read.parquet(f"{self.path}/centroids")
        last = every.agg(F.max("version")).first()[0]
        return every.where(F.col("version") == last).drop("version")

    def _version(self) -> int:
        return self.spark.read.parquet(f"{self.path}/centroids").agg(F.max("version")).first()[0]

    def _write_centroids(self, centroids: DataFrame, version: int) -> None:
        centroids.write.mode("overwrite").parquet(f"{self.path}/centroids/version={version}")

    def append(self, papers: DataFrame) -> None:
        """Place papers, none of them indexed yet, in the cells there are; nothing else is read or moved."""
        write_cells(papers, self.centroids(), f"{self.path}/cells", "append")

    def split(self, most: int = MOST_PAPERS) -> int:
        """Split each cell of more than ``most`` papers; the number of cells that came to be.

        The parts are k-means centroids of the cell's own papers, learned from a
        bounded fraction of them. Papers nearest to the first part stay where
        they are, at the angle they have; the others move to new cells. The new
        centroids are written before any paper moves. Copies of one vector stay
        together, so a cell of copies stays as it is.
        """
        sizes = self.papers().groupBy("cell").agg(F.count("*").alias("papers")).where(F.col("papers") > most).collect()
        if not sizes:
            return 0
        full = {r["cell"]: min(MOST_PARTS, -(-r["papers"] // most)) for r in sizes}
        steps = self.spark.createDataFrame([(r["cell"], -(-r["papers"] // TRAIN_ROWS)) for r in sizes], "cell int, step long")
        crowded = self.papers().where(F.col("cell").isin(list(full)))
        some = crowded.join(F.broadcast(steps), "cell").where(F.pmod(F.xxhash64("embedding"), "step") == 0)

        def parts_of(rows: pd.DataFrame) -> pd.DataFrame:
            cell = int(rows["cell"].iloc[0])
            _, unit = blocks.unit_matrix(pa.array(rows["embedding"]))
            return pd.DataFrame({"cell": cell, "centroid": small_k_means(unit, full[cell]).tolist()})

        found = some.select("cell", "embedding").groupBy("cell").applyInPandas(
            parts_of, "cell int, centroid array<double>"
        ).collect()  # at most MOST_PARTS rows a cell
        centroids = self.centroids()
        new = int(centroids.agg(F.max("cell")).first()[0]) + 1
        parts: dict[int, tuple[np.ndarray, list[int]]] = {}
        made = []
        for cell in full:
            mine = sorted(r["centroid"] for r in found if r["cell"] == cell)
            numbers = [cell, *range(new, new + len(mine) - 1)]
            parts[cell] = (np.array(mine), numbers)
            made += [(number, centroid, cell) for number, centroid in zip(numbers[1:], mine[1:])]
            new += len(mine) - 1
        if not made:
            return 0
        fresh = self.spark.createDataFrame(made, "cell int, centroid array<double>, of int")
        if "branch" in centroids.columns:
            branch = centroids.select(F.col("cell").alias("of"), "branch", "branch_centroid")
            fresh = fresh.join(F.broadcast(branch), "of")
        self._write_centroids(centroids.unionByName(fresh.drop("of")), self._version() + 1)
        moved = cut(self._moved(crowded, parts))
        (
            moved.repartitionByRange("cell", F.xxhash64("arxiv_id"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("cell").parquet(f"{self.path}/cells")
        )
        return len(made)

    def _moved(self, crowded: DataFrame, parts: dict) -> DataFrame:
        """Papers of split cells with the cell and angle they have from now on."""
        shared = self.spark.sparkContext.broadcast(parts)

        @F.arrow_udf("cell int, angle double")
        def part_of(vectors: pa.Array, cells: pa.Array, angles: pa.Array) -> pa.Array:
            known = shared.value
            cell, angle = cells.to_numpy().astype(np.int32), angles.to_numpy().copy()
            here = cell.copy()
            for one in np.unique(cell):
                centers, numbers = known[int(one)]
                at = np.flatnonzero(cell == one)
                rows, unit = blocks.unit_matrix(vectors.take(pa.array(at)), centers.shape[1])
                away = blocks.distances(unit, centers)
                best = away.argmin(axis=1)
                goes = best > 0
                here[at[rows[goes]]] = np.array(numbers)[best[goes]]
                angle[at[rows[goes]]] = np.arccos(1.0 - away[np.arange(len(rows)), best][goes])
            return pa.StructArray.from_arrays([pa.array(here), pa.array(angle)], ["cell", "angle"])

        placed = crowded.withColumn("_part", part_of.asNondeterministic()("embedding", "cell", "angle"))
        return placed.withColumns({"cell": F.col("_part.cell"), "angle": F.col("_part.angle")}).drop("_part")
