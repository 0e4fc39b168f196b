"""Exact top-k inner products by a KD-tree per shard.

Rows are dealt over shards of bounded size by the hash of their id. Each shard
becomes one tree: median splits of the widest side, tight boxes, leaves of rows.
A query goes best-first through a tree: the bound of a box is the sum over the
components of max(q * low, q * high), and boxes that can't beat the kth score so
far stay closed. Queries first search the shard they live in; the kth score
found there goes with them, in blocks, to the other shards.

Cases: rows without an id, a vector, or with a null or non-finite component take
no part; an id that occurs more than once counts as one row, with the least of
its vectors; vectors of another length than the query's are no candidates; ties
go to the smaller id, also between a box and the kth score, as a node knows its
least id; fewer than k candidates are all returned; scores beyond 64 bits are ranked as they
are and shown as the largest number.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import stored

SHARD_ROWS = 16_384
BLOCK_QUERIES = 2_048
LEAF_ROWS = 256
LARGEST = 2**63 - 1
HITS = "query_id long, vec_id long, score long"


class Tree:
    """A KD-tree over integer vectors; nodes are in heap order of their building."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int]] = []
        place = np.arange(len(ids))
        self._build(place, 0, len(ids), leaf_rows)
        self.ids, self.vectors = self.ids[place], self.vectors[place]
        self.low = np.stack([self.vectors[a:b].min(0) for a, b in self.span])
        self.high = np.stack([self.vectors[a:b].max(0) for a, b in self.span])
        self.least = np.array([self.ids[a:b].min() for a, b in self.span])
        widest = float(np.abs(self.vectors).max(initial=0)) if len(ids) else 0.0
        self.widest = widest

    def _build(self, place: np.ndarray, start: int, end: int, leaf_rows: int) -> None:
        """Split positions start to end of ``place`` until a leaf is small or all its rows are equal."""
        self.span.append((start, end))
        self.children.append((0, 0))
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = self.span[node]
            if b - a <= leaf_rows:
                continue
            rows = self.vectors[place[a:b]]
            side = int(np.argmax(rows.max(0) - rows.min(0)))
            values = rows[:, side]
            middle = (b - a) // 2
            if values.min() == values.max():
                continue
            place[a:b] = place[a:b][np.argpartition(values, middle)]
            self.children[node] = (len(self.span), len(self.span) + 1)
            for half in ((a, a + middle), (a + middle, b)):
                todo.append(len(self.span))
                self.span.append(half)
                self.children.append((0, 0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that each query can score in each node."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.high.T + down @ self.low.T

    def search(self, own: int, query: np.ndarray, bound: np.ndarray, k: int, kth: tuple | None) -> list[tuple[int, int]]:
        """Up to k (score, -id) that are not beaten by ``kth``, the kth best known so far."""
        best: list[tuple[int, int]] = []
        least = kth
        todo = [(-bound[0], 0)]
        while todo:
            most, node = heapq.heappop(todo)
            if least is not None and (-most, -self.least[node]) < least:
                if -most < least[0]:
                    break
                continue
            left, right = self.children[node]
            if left:
                for child in (left, right):
                    heapq.heappush(todo, (-bound[child], child))
                continue
            a, b = self.span[node]
            ids, scores = self.ids[a:b], self.vectors[a:b] @ query
            if least is not None:
                keep = scores >= least[0]
                ids, scores = ids[keep], scores[keep]
            if len(ids) > k + 1:
                some = np.lexsort((ids, -scores))[: k + 1]
                ids, scores = ids[some], scores[some]
            for i, s in zip(ids.tolist(), scores.tolist()):
                if i != own and (least is None or (s, -i) >= least):
                    heapq.heappush(best, (s, -i))
            while len(best) > k:
                heapq.heappop(best)
            if len(best) == k and (least is None or best[0] > least):
                least = best[0]
        return best


def exact(tree: Tree, queries: np.ndarray) -> tuple[Tree, np.ndarray]:
    """Both sides in a type that holds every product sum: doubles up to 2^53, else integers."""
    most = tree.widest * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
    kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
    for name in ("vectors", "low", "high"):
        setattr(tree, name, getattr(tree, name).astype(kind))
    return tree, queries.astype(kind)


def _search_all(tree: Tree, ids, vectors, kths, k: int) -> pd.DataFrame:
    found = []
    tree, asked = exact(tree, vectors)
    for start in range(0, len(ids), 256):
        part = slice(start, start + 256)
        bounds = tree.bounds(asked[part])
        for own, query, bound, kth in zip(ids[part].tolist(), asked[part], bounds, kths[part]):
            found += [(own, -i, min(max(int(s), -LARGEST), LARGEST)) for s, i in tree.search(own, query, bound, k, kth)]
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")


def _packed(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data)) as held:
        return [held[name] for name in held.files]


def usable(vectors: DataFrame) -> DataFrame:
    """id, v (floor of 256 times each component) and dim of the rows that take part."""
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding")
        .where(F.col("id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
        .select("id", whole.alias("v"))
        .groupBy("id")
        .agg(F.min("v").alias("v"))
        .withColumn("dim", F.size("v"))
    )


def top_k(vectors: DataFrame, asked: Column, k: int = 5, *, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of every row that ``asked`` (of id) marks."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors).withColumn("asked", asked), "vectors")
    sizes = {r["dim"]: -(-r["n"] // shard_rows) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = spark.createDataFrame(list(sizes.items()), "dim int, shards long")
    dealt = rows.join(F.broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("id"), "shards"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, matrix = pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy())
        tree = Tree(ids, matrix)
        mine = pdf["asked"].to_numpy(bool)
        hits = _search_all(tree, ids[mine], matrix[mine], [None] * int(mine.sum()), k)
        kth = {}
        for query, group in hits.groupby("query_id"):
            if len(group) == k:
                last = group.sort_values(["score", "vec_id"], ascending=[True, False]).iloc[0]
                kth[query] = (int(last["score"]), -int(last["vec_id"]))
        known = np.array([kth.get(i, (0, 0)) for i in ids[mine]], np.int64).reshape(-1, 2)
        has = np.array([i in kth for i in ids[mine]], bool)
        return pd.DataFrame({
            "dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])],
            "rows": [_packed(ids, matrix)],
            "queries": [_packed(ids[mine], matrix[mine], known, has)],
            "n": [int(mine.sum())],
            "hits": [hits.to_dict("records")],
        })

    built = stored(
        dealt.groupBy("dim", "shard").applyInPandas(
            build,
            "dim int, shard long, rows binary, queries binary, n int, "
            "hits array<struct<query_id: long, vec_id: long, score: long>>",
        ),
        "trees",
    )
    near = built.select(F.inline("hits"))

    # Blocks of queries against all other shards: a block joins the queries of
    # neighbouring shards until it has BLOCK_QUERIES.
    asking = built.where(F.col("n") > 0).select("dim", F.col("shard").alias("home"), "queries", "n")
    per_shard = max(1, round(BLOCK_QUERIES / max(1, shard_rows // 50)))
    blocks = asking.withColumn("block", F.floor(F.col("home") / per_shard).cast("long")).groupBy("dim", "block").agg(
        F.collect_list(F.struct("home", "queries")).alias("asked")
    )
    pairs = (
        blocks.join(F.broadcast(shards), "dim")
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
        .select(F.col("dim").alias("to_dim"), F.col("shard").alias("to_shard"), F.col("block").alias("of_block"), "asked")
    )
    known = blocks.select(F.col("dim").alias("block_dim"), "block")
    trees = (
        built.select("dim", "shard", "rows")
        .join(known, F.col("dim") == F.col("block_dim"))
        .select(F.col("dim").alias("tree_dim"), F.col("shard").alias("tree_shard"), F.col("block").alias("tree_block"), "rows")
    )

    def compare(tree_rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if tree_rows.empty or block.empty:
            return pd.DataFrame(columns=["query_id", "vec_id", "score"]).astype("int64")
        here = int(tree_rows["tree_shard"].iloc[0])
        tree = Tree(*_unpacked(tree_rows["rows"].iloc[0]))
        out = []
        for part in block["asked"].iloc[0]:
            if part["home"] == here:
                continue
            ids, matrix, known, has = _unpacked(part["queries"])
            kths = [tuple(x) if h else None for x, h in zip(known.tolist(), has.tolist())]
            out.append(_search_all(tree, ids, matrix, kths, k))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "vec_id", "score"]).astype("int64")

    far = (
        trees.groupBy("tree_dim", "tree_shard", "tree_block")
        .cogroup(pairs.groupBy("to_dim", "to_shard", "of_block"))
        .applyInPandas(compare, HITS)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.unionByName(far)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
