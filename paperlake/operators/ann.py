"""Cells of nearby papers: approximate search, and exact search for many questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, fits
from ..sources.quarantine import quarantine, vector_rules
from . import blocks
from .search import (
    arrow_schema,
    asked_of,
    greatest_k,
    pair_schema,
    rank_hits,
    vector_dim,
    with_topic_column,
)

# The centroids go to every task, so their size is checked against this.
CENTROID_BYTES = 1024 * 1024 * 1024

# Papers of a cell on average, where the number of cells is not given.
CELL_PAPERS = 2_000

# More cells than this are trained in two levels: branches, then the cells of each.
FLAT_CELLS = 1_024

# Vectors that one k-means learns from at most; a fraction of all by the hash of their id.
TRAIN_ROWS = 200_000

# Distances to centroids that are held at a time, in several copies.
STRIP_NUMBERS = 1_000_000

# A cell with more papers is split into blocks of about this size, and one with
# more questions into groups of about that size.
BLOCK_ROWS = 20_000
QUESTION_ROWS = 100_000

# Such groups that a task of the join takes one after the other, about.
GROUPS_IN_TASK = 8

# Regions of topics for each block of papers there is; a topic is in one region.
TOPIC_REGIONS = 8

# A region with more than this share of the papers, and more than so many blocks,
# is not searched by its topics.
TOPIC_SHARE, TOPIC_BLOCKS = 0.25, 4

# Added to an angle bound, for the rounding of distances.
ANGLE_SLACK = 1e-5


def _some(rows: DataFrame, most: int, n: int) -> DataFrame:
    """About ``most`` of ``n`` rows, chosen by the hash of their vector: equal rows in, equal rows out."""
    step = -(-n // most)
    return rows if step <= 1 else rows.where(F.pmod(F.xxhash64("embedding"), F.lit(step)) == 0)


def _k_means(vectors: DataFrame, n: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=n, distanceMeasure="cosine", seed=seed, maxIter=10).fit(features)
    return np.array(model.clusterCenters())


def small_k_means(unit: np.ndarray, n: int, turns: int = 10) -> np.ndarray:
    """Up to ``n`` centroids of some unit vectors, by the angle; the same rows give the same ones."""
    distinct = np.unique(unit, axis=0)
    picked = np.random.default_rng(17).permutation(len(distinct))[:n]
    centers = distinct[picked]
    for _ in range(turns):
        nearest = (unit @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, unit)
        norms = np.linalg.norm(sums, axis=1)
        centers = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], centers)
    return centers


def train_cells(
    papers: DataFrame, n: int | None = None, seed: int = 17, dim: int | None = None
) -> DataFrame:
    """Centroids of cells (cell, centroid, branch, branch_centroid), by k-means on the angle.

    Only usable vectors of length ``dim`` (default: the commonest length) count.
    ``n`` is by default as many as give a cell ``CELL_PAPERS`` papers. Up to
    ``FLAT_CELLS`` cells are one branch. More are trained in two levels: about
    the square root of ``n`` branches over all, then the cells of each branch
    by its own papers and in proportion to them, in a task of its own. Every
    k-means learns from ``TRAIN_ROWS`` vectors or fewer.
    """
    spark = papers.sparkSession
    usable, _ = quarantine(papers, vector_rules(dim=dim or vector_dim(papers, "embedding")))
    vectors = usable.select("embedding")
    count = vectors.count()
    n = n or max(2, -(-count // CELL_PAPERS))
    layout = "cell int, centroid array<double>, branch int, branch_centroid array<double>"
    if n <= FLAT_CELLS:
        centers = _k_means(_some(vectors, TRAIN_ROWS, count), n, seed).tolist()
        return spark.createDataFrame([(i, c, 0, centers[0]) for i, c in enumerate(centers)], layout)
    branches = _k_means(_some(vectors, TRAIN_ROWS, count), round(n**0.5), seed)
    top = spark.createDataFrame([(i, c) for i, c in enumerate(branches.tolist())], "cell int, centroid array<double>")
    placed = cut(assign_cells(vectors, top).select("embedding", F.col("cell").alias("branch")))
    sizes = placed.groupBy("branch").agg(F.count("*").alias("papers"))
    shares = {r["branch"]: max(1, round(n * r["papers"] / max(1, count))) for r in sizes.collect()}
    steps = spark.createDataFrame(
        [(r["branch"], -(-r["papers"] // TRAIN_ROWS)) for r in sizes.collect()], "branch int, step long"
    )
    some = placed.join(F.broadcast(steps), "branch").where(F.pmod(F.xxhash64("embedding"), "step") == 0)

    def fine(rows):
        branch = int(rows["branch"].iloc[0])
        _, unit = blocks.unit_matrix(pa.array(rows["embedding"]))
        return pd.DataFrame({"branch": branch, "centroid": small_k_means(unit, shares[branch]).tolist()})

    cells = some.groupBy("branch").applyInPandas(fine, "branch int, centroid array<double>")
    numbered = cut(cells).withColumn("cell", F.row_number().over(Window.orderBy("branch", "centroid")) - 1)
    named = top.select(F.col("cell").alias("branch"), F.col("centroid").alias("branch_centroid"))
    return numbered.join(F.broadcast(named), "branch").select("cell", "centroid", "branch", "branch_centroid")


class Centroids:
    """Names and unit centroids of cells in every task, by branch where they have branches."""

    def __init__(self, centroids: DataFrame):
        dim = vector_dim(centroids, "centroid") or 1
        most = CENTROID_BYTES // (8 * dim)
        if not fits(centroids, most):
            raise ValueError(f"more than {most} centroids of length {dim}")
        has_branches = "branch" in centroids.columns
        order = ["branch", "cell"] if has_branches else ["cell"]
        table = centroids.orderBy(*order).toArrow().combine_chunks()
        rows, self.unit = blocks.unit_matrix(table.column("centroid").combine_chunks(), dim)
        self.names = table.column("cell").to_numpy()[rows].astype(np.int32)
        self.branches = None
        if has_branches:
            branch = table.column("branch").to_numpy()[rows]
            self.first = np.flatnonzero(np.r_[True, branch[1:] != branch[:-1]]) if len(branch) else np.zeros(0, int)
            self.last = np.append(self.first[1:], len(branch))
            tops = table.column("branch_centroid").combine_chunks().take(pa.array(rows[self.first]))
            _, self.branches = blocks.unit_matrix(tops, dim)

    @property
    def dim(self) -> int:
        return self.unit.shape[1]

    def strips(self, rows: int) -> Iterator[slice]:
        """Rows whose distances to all centroids are held at a time."""
        step = max(1, STRIP_NUMBERS // max(1, len(self.unit)))
        return (slice(at, at + step) for at in range(0, rows, step))

    def nearest(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and distance of the nearest centroid in the nearest branch of each vector."""
        place, away = np.zeros(len(unit), int), np.zeros(len(unit))
        if self.branches is None or len(self.branches) == 1:
            for some in self.strips(len(unit)):
                all_of = blocks.distances(unit[some], self.unit)
                place[some] = all_of.argmin(axis=1)
                away[some] = all_of.min(axis=1)
            return place, away
        branch = np.zeros(len(unit), int)
        for some in self.strips(len(unit)):
            branch[some] = blocks.distances(unit[some], self.branches).argmin(axis=1)
        for one in np.unique(branch):
            mine, first, last = np.flatnonzero(branch == one), self.first[one], self.last[one]
            all_of = blocks.distances(unit[mine], self.unit[first:last])
            place[mine] = first + all_of.argmin(axis=1)
            away[mine] = all_of.min(axis=1)
        return place, away


def assign_cells(papers: DataFrame, centroids: DataFrame, column: str = "embedding") -> DataFrame:
    """Add the nearest cell and the angle to its centroid; null without a vector.

    Of cells with branches it is the nearest of the nearest branch. Only the
    vector goes to Python; all other columns stay in the JVM.
    """
    shared = papers.sparkSession.sparkContext.broadcast(Centroids(centroids))
    kind = pa.struct([("cell", pa.int32()), ("angle", pa.float64())])

    @F.arrow_udf("cell int, angle double")
    def nearest_cell(vectors: pa.Array) -> pa.Array:
        known = shared.value
        rows, block = blocks.unit_matrix(vectors, known.dim)
        best, away = known.nearest(block)
        cell = np.full(len(vectors), -1, np.int32)
        angle = np.full(len(vectors), np.nan)
        cell[rows] = known.names[best]
        angle[rows] = np.arccos(1.0 - away)
        gone = cell < 0
        return pa.StructArray.from_arrays(
            [pa.array(cell, mask=gone), pa.array(angle, mask=gone)], fields=list(kind)
        )

    return (
        # else a filter on the cell would compute it twice
        papers.withColumn("_near", nearest_cell.asNondeterministic()(F.col(column)))
        .withColumns({"cell": F.col("_near.cell"), "angle": F.col("_near.angle")})
        .drop("_near")
    )


def write_cells(
    papers: DataFrame, centroids: DataFrame, path: str, mode: str = "errorifexists"
) -> DataFrame:
    """Store the papers that have a vector by cell, and read them back.

    A search of few cells then reads only their folders. Rows are ranged by cell
    and a hash of the id, so a cell that holds a large share of the papers is
    written by several tasks, and a small one by one.
    """
    placed = assign_cells(papers, centroids).where(F.col("cell").isNotNull())
    (
        placed.repartitionByRange("cell", F.xxhash64("arxiv_id"))
        .write.partitionBy("cell")
        .mode(mode)
        .parquet(path)
    )
    stored = T.StructType([*(f for f in placed.schema if f.name != "cell"), placed.schema["cell"]])
    return papers.sparkSession.read.schema(stored).parquet(path)


def probe_cells(questions: DataFrame, centroids: DataFrame, probes: int) -> DataFrame:
    """One row per question and each of its ``probes`` nearest cells."""
    shared = questions.sparkSession.sparkContext.broadcast(Centroids(centroids))

    @F.arrow_udf("array<int>")
    def nearest_cells(vectors: pa.Array) -> pa.Array:
        known = shared.value
        count = min(probes, len(known.names))
        rows, block = blocks.unit_matrix(vectors, known.dim)
        picked: list = [None] * len(vectors)
        for some in known.strips(len(rows)):
            away = blocks.distances(block[some], known.unit)
            for row, own in zip(rows[some], away):
                # the nearest ones and all that tie with the last; the lower cell number wins a tie
                near = np.flatnonzero(own <= np.partition(own, count - 1)[count - 1])
                picked[row] = known.names[near[np.lexsort((known.names[near], own[near]))[:count]]].tolist()
        return pa.array(picked, pa.list_(pa.int32()))

    return questions.withColumn("cell", F.explode(nearest_cells(F.col("vector"))))


def _parts(rows: DataFrame, limit: int, name: str, *more: Column) -> DataFrame:
    """How many parts of about ``limit`` rows each cell makes."""
    count = F.ceil(F.count("*") / F.lit(limit)).cast("int")
    return rows.groupBy("cell").agg(count.alias(name), *more)


def routed_join(
    routed: DataFrame, papers: DataFrame, dim: int, block_rows: int | None = None,
    question_rows: int | None = None,
) -> DataFrame:
    """Candidates for questions that were sent to cells.

    ``routed``: qid, vector, topic, k, cell, and reach, a distance its last hit
    cannot exceed, where one is known; ``papers``: arxiv_id, embedding, topic, cell. A cell is cut into blocks of papers and groups of questions, so no
    task gets a cell whole however many rows it has. Rows are shuffled once by
    (cell, block, group) and sorted there, papers first; a task then holds one
    block of papers and streams the questions past it, emitting at most ``k``
    rows per question and block.

    The sizes, one row per cell, are read first: the cells that are asked for
    then are literals, and papers stored by cell are read from their folders only.
    """
    groups_of = _parts(
        routed, question_rows or QUESTION_ROWS, "n_groups", F.max("k").alias("most")
    ).toPandas()
    most = int(groups_of["most"].max()) if len(groups_of) else 1
    asked_cells = [int(c) for c in groups_of["cell"]]
    papers = papers.where(F.col("cell").isin(asked_cells))
    blocks_of = _parts(papers, block_rows or BLOCK_ROWS, "n_blocks").toPandas()
    sizes = list(blocks_of.merge(groups_of, on="cell").itertuples(index=False))
    plan = F.broadcast(
        papers.sparkSession.createDataFrame(
            [(int(s.cell), int(s.n_blocks), int(s.n_groups)) for s in sizes],
            "cell int, n_blocks int, n_groups int",
        )
    )
    schema = pair_schema(routed, papers)
    out = arrow_schema(schema)
    null_qid = F.lit(None).cast(schema["qid"].dataType)
    null_id = F.lit(None).cast(schema["arxiv_id"].dataType)

    # vectors that are all single travel so; tasks take them in double
    kinds = {routed.schema["vector"].dataType.simpleString(), papers.schema["embedding"].dataType.simpleString()}
    number = "array<float>" if kinds == {"array<float>"} else "array<double>"

    def numbers(upto: str):
        return F.sequence(F.lit(0), F.col(upto) - 1)

    paper_side = papers.join(plan, "cell").select(
        "cell",
        F.pmod(F.xxhash64("arxiv_id"), F.col("n_blocks")).cast("int").alias("block"),
        F.explode(numbers("n_groups")).alias("grp"),
        F.lit(0).alias("side"),
        null_qid.alias("qid"),
        "arxiv_id",
        "topic",
        F.lit(None).cast("int").alias("k"),
        F.lit(None).cast("double").alias("reach"),
        F.col("embedding").cast(number).alias("v"),
    )
    reach = F.col("reach") if "reach" in routed.columns else F.lit(None)
    question_side = routed.join(plan, "cell").select(
        "cell",
        F.explode(numbers("n_blocks")).alias("block"),
        F.pmod(F.xxhash64("qid"), F.col("n_groups")).cast("int").alias("grp"),
        F.lit(1).alias("side"),
        "qid",
        null_id.alias("arxiv_id"),
        "topic",
        "k",
        F.coalesce(reach.cast("double"), F.lit(float("inf"))).alias("reach"),
        F.col("vector").cast(number).alias("v"),
    )
    key = ["cell", "block", "grp"]
    # the number of groups is known, so no task has to sort very many of them
    groups = sum(int(s.n_blocks) * int(s.n_groups) for s in sizes)
    usual = int(papers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = (
        paper_side.unionByName(question_side)
        .repartition(max(usual, groups // GROUPS_IN_TASK), *key)
        .sortWithinPartitions(*key, "side")
    )

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            turns = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *turns], [*turns, len(keys)]):
                group, side = tuple(keys[start, :3]), keys[start, 3]
                part = batch.slice(int(start), int(stop - start))
                if group != current:
                    current, block = group, []
                if side == 0:
                    columns = (part.column(c) for c in ("arxiv_id", "v", "topic"))
                    block.append(blocks.paper_block(*columns, dim, most))
                    continue
                rows, unit = blocks.unit_matrix(part.column("v"), dim)
                topics = blocks.topic_array(part.column("topic"))[rows]
                wanted = part.column("k").to_numpy()[rows]
                reaches = part.column("reach").to_numpy()[rows]
                asked = part.column("qid").take(pa.array(rows))
                for at in range(0, len(rows), blocks.STRIP):
                    some = slice(at, at + blocks.STRIP)
                    searches = blocks.Searches(wanted[some], unit[some], topics[some], reaches[some])
                    for papers_of_block in block:
                        searches.add(*papers_of_block)
                    found = searches.found(asked.slice(at, blocks.STRIP), out)
                    if found is not None:
                        yield found

    return together.mapInArrow(nearest, schema)


def ann_join(
    questions: DataFrame,
    papers: DataFrame,
    centroids: DataFrame,
    k: int | str,
    probes: int,
    topic_col: str | None = None,
) -> DataFrame:
    """Nearest papers among the ``probes`` cells nearest to each question.

    ``papers`` carries ``cell`` from ``assign_cells``. A neighbour in another cell
    is missed, and with a topic fewer than ``k`` rows may be found; more probes
    cure both, and probing all cells is exact.
    """
    asked = asked_of(questions, k, topic_col)
    known = papers.where(F.col("cell").isNotNull()).select(
        "arxiv_id", "embedding", with_topic_column(papers, topic_col).alias("topic"), "cell"
    )
    dim = vector_dim(centroids, "centroid")
    pairs = routed_join(probe_cells(asked, centroids, probes), known, dim)
    return rank_hits(pairs, greatest_k(asked))


def topic_split(asked: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions searched by their topic, the other questions, and the papers, these by region of topics.

    A region (``cell``) holds all papers of some topics, chosen by hash, so its
    papers are the only ones that a question of these topics can find. Questions
    without a topic, and those of a region that holds a large share of the
    papers, are the others.
    """
    count = known.count()
    regions = max(1, -(-count // BLOCK_ROWS)) * TOPIC_REGIONS
    region = F.pmod(F.xxhash64("topic"), F.lit(regions)).cast("int")
    placed = known.where(F.col("topic").isNotNull()).drop("cell", "angle").withColumn("cell", region)
    most = max(count * TOPIC_SHARE, BLOCK_ROWS * TOPIC_BLOCKS)
    sizes = placed.groupBy("cell").agg(F.count("*").alias("papers"))
    wide = [r["cell"] for r in sizes.where(F.col("papers") > most).collect()]  # few: each has a share
    apart = F.col("topic").isNotNull() & ~region.isin(wide) if wide else F.col("topic").isNotNull()
    return asked.where(apart).withColumn("cell", region), asked.where(~apart), placed


def topic_join(asked: DataFrame, placed: DataFrame, dim: int) -> DataFrame:
    """The exact nearest papers of questions that ``topic_split`` gave to regions."""
    return rank_hits(routed_join(asked, placed, dim), greatest_k(asked))


class Regions:
    """Neighbouring cells taken together, of about ``BLOCK_ROWS`` papers each.

    ``low`` and ``high`` are the least and greatest angle of a cell's papers to
    its centroid, ``papers`` their number.
    """

    def __init__(self, tree: Centroids, bounds: pd.DataFrame):
        bounds = bounds.reindex(tree.names)
        used = np.flatnonzero(bounds["papers"].to_numpy() > 0)  # an empty cell compares false
        near = np.zeros(len(used), int)
        if tree.branches is None or len(tree.branches) == 1:
            some = tree.unit[used[:: max(1, round(len(used) ** 0.5))]]
            for rows in tree.strips(len(used)):
                near[rows] = blocks.distances(tree.unit[used[rows]], some).argmin(axis=1)
        used = used[np.argsort(near, kind="stable")]
        papers = bounds["papers"].to_numpy()[used]
        turn = (np.cumsum(papers) - papers) // BLOCK_ROWS
        self.unit, self.names = tree.unit[used], tree.names[used]
        self.low, self.high = bounds["low"].to_numpy()[used], bounds["high"].to_numpy()[used]
        self.first = np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]]) if len(used) else np.zeros(0, int)
        self.of_cell = np.searchsorted(self.first, np.arange(len(used)), side="right") - 1
        self.order = np.argsort(self.names)

    def strips(self, rows: int) -> Iterator[slice]:
        step = max(1, STRIP_NUMBERS // max(1, len(self.unit)))
        return (slice(at, at + step) for at in range(0, rows, step))

    def open(self, unit: np.ndarray, limit: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which regions have a cell, other than the one ``done``, within ``limit``; whether the own region has."""
        angle = np.arccos(1.0 - blocks.distances(unit, self.unit))
        cells = np.maximum(angle - self.high, self.low - angle) <= limit[:, None]
        at = self.order[np.minimum(np.searchsorted(self.names, done, sorter=self.order), len(self.names) - 1)]
        rows = np.flatnonzero(self.names[at] == done)  # an empty cell is in no region
        cells[rows, at[rows]] = False
        regions = np.logical_or.reduceat(cells, self.first, axis=1)
        again = np.zeros(len(unit), bool)
        again[rows] = regions[rows, self.of_cell[at[rows]]]
        return regions, again


def exact_join(
    asked: DataFrame, known: DataFrame, dim: int, centroids: DataFrame | None = None
) -> DataFrame:
    """The exact nearest papers of many questions (qid, vector, topic, k).

    The nearest cell of a question is searched first; the angle of its k-th hit
    there bounds the search. Another cell can hold a nearer paper only if the
    triangle inequality on angles lets it, given the least and greatest angle of
    its papers to its centroid; the question is sent to the regions of those
    cells alone, so the copies of a question follow the blocks of papers, however
    many cells there are. Where its own region is one of them, that search
    replaces the first.
    Papers that carry ``cell`` and ``angle`` by these ``centroids``, as those of
    a ``CellIndex`` do, are searched as they are stored.
    """
    if centroids is None:
        centroids = train_cells(known, dim=dim)
        known = known.drop("cell", "angle")
    # used for the cell sizes, the bounds and both searches
    if {"cell", "angle"} <= set(known.columns):
        placed = known.where(F.col("cell").isNotNull())
    else:
        placed = cut(assign_cells(known, centroids).where(F.col("cell").isNotNull()))
    routed = cut(probe_cells(asked, centroids, 1))
    most = greatest_k(asked)
    ranked = rank_hits(routed_join(routed, placed, dim), most).drop("similarity")
    first = cut(ranked.join(asked.select("qid", "k"), "qid"))
    # the distance of the k-th hit, null where the cell had fewer
    reach = first.where(F.col("rk") == F.col("k")).select("qid", F.col("distance").alias("reach"))
    bounds = (
        placed.groupBy("cell")
        .agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("papers"))
        .toPandas()  # one row per cell
        .set_index("cell")
    )
    regions = Regions(Centroids(centroids), bounds)
    if not len(regions.first):
        return rank_hits(first.drop("rk"), most)
    shared = asked.sparkSession.sparkContext.broadcast(regions)
    kind = pa.struct([("regions", pa.list_(pa.int32())), ("again", pa.bool_())])

    @F.arrow_udf("regions array<int>, again boolean")
    def open_regions(vectors: pa.Array, reaches: pa.Array, done: pa.Array) -> pa.Array:
        known = shared.value
        rows, block = blocks.unit_matrix(vectors, dim)
        limit = reaches.to_numpy(zero_copy_only=False)[rows].astype(float)
        limit = np.where(np.isnan(limit), np.pi, np.arccos(1.0 - np.nan_to_num(limit))) + ANGLE_SLACK
        searched = done.to_numpy(zero_copy_only=False)[rows]
        counts, again, found = np.zeros(len(vectors), np.int32), np.zeros(len(vectors), bool), [np.zeros(0, np.int32)]
        for some in known.strips(len(rows)):
            opened, own = known.open(block[some], limit[some], searched[some])
            counts[rows[some]], again[rows[some]] = opened.sum(axis=1), own
            found.append(np.nonzero(opened)[1].astype(np.int32))
        ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
        return pa.StructArray.from_arrays([lists, pa.array(again)], fields=list(kind))

    opened = cut(
        routed.join(reach, "qid", "left")
        .withColumn("_open", open_regions.asNondeterministic()(F.col("vector"), F.col("reach"), F.col("cell")))
        .select("qid", "vector", "topic", "k", "reach", "_open.*")
    )
    rest = opened.select("qid", "vector", "topic", "k", "reach", F.explode("regions").alias("cell"))
    of_cell = asked.sparkSession.createDataFrame(
        pd.DataFrame({"cell": regions.names, "region": regions.of_cell.astype(np.int32)}), "cell int, region int"
    )
    by_region = placed.join(F.broadcast(of_cell), "cell").drop("cell").withColumnRenamed("region", "cell")
    kept = first.drop("rk").join(opened.where("again").select("qid"), "qid", "left_anti")
    return rank_hits(kept.unionByName(routed_join(rest, by_region, dim)), most)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact hits, how many of them the approximate search found, their share."""
    hit = approx.select("qid", "arxiv_id", F.lit(1).alias("hit"))
    return (
        exact.select("qid", "arxiv_id")
        .join(hit, ["qid", "arxiv_id"], "left")
        .agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
        .withColumn("recall", F.try_divide(F.col("found"), F.col("wanted")))
    )
