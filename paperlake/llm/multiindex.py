"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector has its own codebook; a cell is a pair of centroids, one
of each half, and every row is in one cell. A query walks the cells by summed
distance (minus the inner products with the two centroids), least first, with a
heap over pairs, until the cells it has met hold the wanted share of all rows.
As cells come in order, the distance of the last one says which cells were met:
that number goes with the query to the tasks, and all rows of its cells are
ranked again by the inner product of the original vectors.

The codebooks, and the share that reaches ``recall`` inside the sample, are
fitted on the driver on at most ``SAMPLE_ROWS`` rows and ``SAMPLE_NUMBERS``
numbers (those of least hash of the id); all rows are indexed. Counts of the
cells are bounded by the codebooks. Rows of neighbouring cells share a shelf of
about ``SHELF_ROWS`` rows, a larger cell is cut over several; a task holds one
shelf and the queries stream past it.

Equal vectors are one entry with their k + 1 least ids, and equal queries are
searched once, so copies cost nothing and change no result.

Cases: rows without an id or a vector, with a null or non-finite component, or
all zeros take no part; an id that occurs more than once counts as one row, with
the least of its vectors; vectors of each length have an index of their own;
ties go to the smaller id; fewer than k candidates are all returned; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import fsum, isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import stored
from paperlake.operators.lookups import salted

K, RECALL = 20, 0.95
SAMPLE_ROWS, SAMPLE_NUMBERS, TRIALS = 16_384, 4_000_000, 512
#: Rows that a cell has on average, and centroids of a half at most.
CELL_ROWS, MOST_CENTROIDS = 12, 128
SHELF_ROWS = 8_192
#: Queries that stream past one copy of a shelf, and that are scored at a time.
STREAM_QUERIES, AT_ONCE = 1_000_000, 128
RESULT = "query_id long, rank int, vec_id long, score double"


def _centroids(rows: np.ndarray, n: int, turns: int = 12) -> np.ndarray:
    """k-means; the same rows give the same centroids."""
    centres = rows[np.random.default_rng(3).choice(len(rows), n, replace=False)].copy()
    for _ in range(turns):
        nearest = _nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        counts = np.bincount(nearest, minlength=n)
        some = counts > 0
        centres[some] = sums[some] / counts[some, None]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T - 0.5 * np.square(centres).sum(axis=1)).argmax(axis=1)


@dataclass
class Codebooks:
    """Centroids of both halves, and the share of all rows that a query walks over."""

    first: np.ndarray
    second: np.ndarray
    share: float = 1.0

    def cells(self, rows: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        return _nearest(rows[:, :half], self.first) * len(self.second) + _nearest(rows[:, half:], self.second)

    def distances(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return -(queries[:, :half] @ self.first.T), -(queries[:, half:] @ self.second.T)

    @property
    def size(self) -> int:
        return len(self.first) * len(self.second)


def walk(one: np.ndarray, two: np.ndarray, counts: np.ndarray, wanted: int) -> tuple[float, list[int]]:
    """Cells by summed distance until they hold ``wanted`` rows: the last distance, and the cells."""
    by_one, by_two = one.argsort(kind="stable"), two.argsort(kind="stable")
    a, b = one[by_one].tolist(), two[by_two].tolist()
    by_one, by_two, held = by_one.tolist(), by_two.tolist(), counts.tolist()
    heap = [(a[0] + b[0], 0, 0)]
    met, found, last = [], 0, -np.inf
    while heap and found < wanted:
        last, i, j = heapq.heappop(heap)
        cell = by_one[i] * len(b) + by_two[j]
        met.append(cell)
        found += held[cell]
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return last, met


def fit(sample: np.ndarray, rows: int, k: int, recall: float) -> Codebooks:
    """Codebooks for ``rows`` rows, and the share in which ``recall`` of the sample's own neighbours lie."""
    n = int(np.clip(round((rows / CELL_ROWS) ** 0.5), 1, min(MOST_CENTROIDS, len(sample))))
    half = sample.shape[1] // 2
    books = Codebooks(_centroids(sample[:, :half], n), _centroids(sample[:, half:], n))
    cells = books.cells(sample)
    counts = np.bincount(cells, minlength=books.size)
    trials = sample[:TRIALS]
    scores = trials @ sample.T
    scores[np.arange(len(trials)), np.arange(len(trials))] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    needed = []
    for query, near, one, two in zip(range(len(trials)), best, *books.distances(trials)):
        summed = (one[:, None] + two).ravel()
        order = np.argsort(summed, kind="stable")
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(counts[order]) - counts[order]
        needed.append((before[cells[near]] + 1) / len(sample))
    needed = np.concatenate(needed) if needed else np.zeros(0)
    books.share = float(np.quantile(needed, recall)) if len(needed) else 1.0
    return books


def usable(vectors: DataFrame) -> DataFrame:
    """id, v (doubles) and dim of every row that takes part."""
    fine = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists("embedding", lambda x: x != 0)
    return (
        vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("id").isNotNull() & F.col("embedding").isNotNull() & fine)
        .groupBy("id")
        .agg(F.min("embedding").alias("v"))
        .withColumns({"dim": F.size("v"), "h": F.xxhash64("v")})
    )


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: h, v, ids (the k + 1 least) and their least id."""
    by_id = Window.partitionBy("h", "v").orderBy("id")
    least = rows.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1)
    return least.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("least", F.get("ids", F.lit(0)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _placed(entries: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    def place(batches):
        for batch in batches:
            cells = books.cells(_matrix(batch.column("v"), dim))
            yield batch.append_column("cell", pa.array(cells.astype(np.int32)))

    rows = entries.select("least", "h", "v", "ids")
    return rows.mapInArrow(place, "least long, h long, v array<double>, ids array<long>, cell int")


def shelves(counts: np.ndarray, shelf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First shelf of each cell and how many it has; cells in order, a larger one cut."""
    first, many = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    shelf, held = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > shelf_rows:
            shelf, held = shelf + 1, 0
        first[cell] = shelf
        many[cell] = max(1, -(-n // shelf_rows))
        if many[cell] > 1:
            shelf, held = shelf + int(many[cell]), 0
        else:
            held += n
    return first, many


def _asking(queries: DataFrame, books: Codebooks, counts: np.ndarray, first: np.ndarray, many: np.ndarray, dim: int) -> DataFrame:
    """least, v, how far each query walks, and the shelves on its way."""
    wanted = max(1, int(np.ceil(books.share * counts.sum())))

    def ask(batches):
        for batch in batches:
            stops, shelves_met = [], []
            for one, two in zip(*books.distances(_matrix(batch.column("v"), dim))):
                stop, met = walk(one, two, counts, wanted)
                met = [cell for cell in met if counts[cell]]
                stops.append(stop)
                shelves_met.append(np.unique(np.concatenate([np.arange(first[c], first[c] + many[c]) for c in met])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("least"), batch.column("v"), pa.array(stops, pa.float64()),
                 pa.array(shelves_met, pa.list_(pa.int64()))],
                ["least", "v", "stop", "shelves"],
            )

    return queries.select("least", "v").mapInArrow(ask, "least long, v array<double>, stop double, shelves array<long>")


class Shelf:
    """Rows of some cells, and the search among them."""

    def __init__(self, parts: list[pa.RecordBatch], books: Codebooks, dim: int, k: int):
        table = pa.Table.from_batches(parts).combine_chunks()
        self.books, self.k = books, k
        self.rows = np.concatenate([_matrix(c, dim) for c in table.column("v").chunks])
        self.ids = table.column("ids").to_pylist()
        cell = table.column("cell").to_numpy()
        self.one, self.two = np.divmod(cell, len(books.second))

    def search(self, queries: np.ndarray, stops: np.ndarray):
        """Up to k + 1 (score, id), best first, of each query among the cells it met."""
        for at in range(0, len(queries), AT_ONCE):
            asked = queries[at : at + AT_ONCE]
            scores = asked @ self.rows.T
            one, two = self.books.distances(asked)
            far = one[:, self.one] + two[:, self.two]
            scores[far > (stops[at : at + AT_ONCE, None] + 1e-9 * (1 + np.abs(far)))] = -np.inf
            n = min(self.k + 1, scores.shape[1])
            kth = np.partition(scores, -n, axis=1)[:, -n]
            for query, own, least in zip(asked, scores, kth):
                # What rounding could have put behind the kth is scored again, too.
                near = np.flatnonzero((own >= least - 1e-9 * (1 + abs(least))) & (own > -np.inf))
                found = []
                for row in near.tolist():
                    score = _inner(query, self.rows[row])
                    found += [(-score, i) for i in self.ids[row]]
                yield sorted(found)[: self.k + 1]


def _inner(x: np.ndarray, y: np.ndarray) -> float:
    """The inner product, rounded once: equal for equal sums, in whatever order."""
    terms = (x * y).tolist()
    return fsum(terms) if all(map(isfinite, terms)) else float(np.nan_to_num(sum(terms)))


def _hits(shelved: DataFrame, asking: DataFrame, books: Codebooks, dim: int, k: int, queries: int) -> DataFrame:
    """query (least id), vec_id and score: the best of each shelf for each query on whose way it lies."""
    streams = -(-queries // STREAM_QUERIES)
    none = F.lit(None)
    stock = shelved.select(
        "shelf", F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("stream"), F.lit(0).alias("kind"),
        "least", "v", "ids", "cell", none.cast("double").alias("stop"),
    )
    asked = asking.select(
        F.explode("shelves").alias("shelf"), F.pmod(F.xxhash64("least"), F.lit(streams)).cast("int").alias("stream"),
        F.lit(1).alias("kind"), "least", "v", none.cast("array<long>").alias("ids"), none.cast("int").alias("cell"), "stop",
    )
    together = stock.unionByName(asked).repartition("shelf", "stream").sortWithinPartitions("shelf", "stream", "kind")

    def scan(batches):
        here, parts, shelf = None, [], None
        for batch in batches:
            of, stream, kind = (batch.column(c).to_numpy() for c in ("shelf", "stream", "kind"))
            fresh = np.flatnonzero((np.diff(of) != 0) | (np.diff(stream) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *fresh.tolist()], [*fresh.tolist(), len(of)]):
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    if here != (of[a], stream[a]):
                        here, parts, shelf = (of[a], stream[a]), [], None
                    parts.append(part)
                    continue
                if shelf is None:
                    shelf, parts = Shelf(parts, books, dim, k), []
                asks = part.column("least").to_pylist()
                stops = part.column("stop").to_numpy()
                query, vec, score = [], [], []
                for own, found in zip(asks, shelf.search(_matrix(part.column("v"), dim), stops)):
                    query += [own] * len(found)
                    vec += [i for _, i in found]
                    score += [-s for s, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())],
                    ["query", "vec_id", "score"],
                )

    return together.mapInArrow(scan, "query long, vec_id long, score double")


def _nearest_of_length(rows: DataFrame, dim: int, n: int, k: int, recall: float, shelf_rows: int) -> DataFrame:
    spark = rows.sparkSession
    size = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dim))
    entries = stored(_entries(rows, k), "entries")
    sample = entries.select("least", "v").orderBy(F.xxhash64("least"), "least").limit(size).collect()
    books = fit(np.array([row["v"] for row in sample], float), n, k, recall)
    index = stored(_placed(entries, books, dim), "cells")
    counts = np.zeros(books.size, np.int64)
    for row in index.groupBy("cell").agg(F.count("*").alias("n")).collect():
        counts[row["cell"]] = row["n"]
    first, many = shelves(counts, shelf_rows)
    table = spark.createDataFrame(
        list(zip(range(books.size), first.tolist(), many.tolist())), "cell int, first long, many long"
    )
    shelved = index.join(F.broadcast(table), "cell").withColumn(
        "shelf", F.col("first") + F.pmod(F.xxhash64("least"), "many")
    )
    # Queries by vector: their least id among all rows stands for the vector.
    known = index.select("h", F.col("v").alias("same"), "least")
    queries = salted(rows.where("asked").select("id", "h", "v"), known, "h", "inner")
    queries = stored(queries.where(F.col("v") == F.col("same")).select("id", "least"), "queries")
    distinct = queries.select("least").distinct()
    n_queries = distinct.count()
    if not n_queries:
        return spark.createDataFrame([], RESULT)
    asking = _asking(index.join(distinct, "least", "left_semi"), books, counts, first, many, dim)
    hits = _hits(shelved, asking, books, dim, k, n_queries)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        hits.withColumn("at", F.row_number().over(best))
        .where(F.col("at") <= k + 1)
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found"))
        .withColumnRenamed("query", "least")
    )
    answered = salted(queries, stored(lists, "hits"), "least", "inner")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return answered.select("id", F.posexplode(others).alias("at", "x")).select(
        F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"),
        F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"),
    )


def nearest(
    vectors: DataFrame, asked: Column, k: int = K, *, recall: float = RECALL, shelf_rows: int = SHELF_ROWS
) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every row that ``asked`` (of id) marks.

    ``vectors`` has vec_id and embedding. ``recall`` is the share of neighbours
    that the walk is to find, as measured inside the sample.
    """
    rows = stored(usable(vectors).withColumn("asked", asked), "vectors")
    lengths = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()
    found = None
    for length in lengths:
        mine = rows.where(F.col("dim") == length["dim"])
        part = _nearest_of_length(mine, length["dim"], length["n"], k, recall, shelf_rows)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else vectors.sparkSession.createDataFrame([], RESULT)
