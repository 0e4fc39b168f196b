import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.llm import nearest
from paperlake.llm.queries import QUERIES

from .conftest import SMALL


def brute(rows, asked, k):
    out = []
    for query, vector in rows:
        if asked(query):
            q = np.floor(256 * np.asarray(vector, float)).astype(int)
            scored = sorted(
                (-int(np.floor(256 * np.asarray(v, float)).astype(int) @ q), i)
                for i, v in rows if i != query and len(v) == len(vector)
            )
            out += [(query, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed,shard_rows,leaf", [(1, 1000, 8), (2, 30, 4), (3, 7, 2)])
def test_against_brute_force(spark, monkeypatch, seed, shard_rows, leaf):
    monkeypatch.setattr(nearest, "LEAF_ROWS", leaf)
    draw = np.random.default_rng(seed)
    rows = [(int(i) * 5, [float(x) for x in draw.integers(-3, 4, 6) / 8]) for i in draw.permutation(150)]
    rows += [(2000 + i, [0.25] * 6) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    found = nearest.top_k(df, F.col("id") % 10 == 0, 4, shard_rows=shard_rows).collect()
    assert sorted(map(tuple, found)) == brute(rows, lambda i: i % 10 == 0, 4)


def test_production_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = QUERIES["op10_exact_top_k"](spark, SMALL).collect()
    assert sorted(map(tuple, found)) == brute(rows, lambda i: i % 50 == 0, 5)


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(4)
    vectors = np.concatenate([draw.integers(-40, 40, (400, 3)), draw.integers(200, 240, (400, 3))])
    tree = nearest.Tree(np.arange(800), vectors, 16)
    queries = draw.integers(-9, 10, (20, 3))
    bounds = tree.bounds(queries)
    for node, (a, b) in enumerate(tree.span):
        assert (bounds[:, node] >= (tree.vectors[a:b] @ queries.T).max(0)).all()
    seen = 0
    class Counted(np.ndarray):  # noqa: E301
        def __getitem__(self, at):
            nonlocal seen
            if isinstance(at, slice):
                seen += 1
            return np.asarray(super().__getitem__(at))
    tree.vectors = tree.vectors.view(Counted)
    tree.search(-1, np.array([1, 1, 1]), tree.bounds(np.array([[1, 1, 1]]))[0], 5, None)
    assert 0 < seen < sum(1 for left, _ in tree.children if not left) / 2


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], "x"), (50, [0.5, 0.5], "x"), (50, [0.5, 0.5], "y"), (1, None, None), (2, [1.0, None], "x"),
        (3, [nan, 1.0], "x"), (4, [inf, 1.0], "x"), (None, [1.0, 1.0], "x"), (100, [1.0], "x"), (5, [], "x"), (6, [3.0, 1.0], None),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = sorted(map(tuple, nearest.top_k(df, F.col("id") % 50 == 0).collect()))
    assert found == brute([(0, [1, 2]), (50, [0.5, 0.5]), (6, [3, 1]), (100, [1.0])], lambda i: i % 50 == 0, 5)
    assert nearest.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0
    big = [(0, [1e6, 1.0]), (1, [1e6, -1.0]), (2, [-1e6, 5.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, nearest.top_k(df, F.col("id") == 2, 1).collect())) == brute(big, lambda i: i == 2, 1)
    huge = spark.createDataFrame([(0, [1e15]), (1, [2e15])], "vec_id long, embedding array<double>")
    assert nearest.top_k(huge, F.col("id") == 0, 1).first().score == nearest.LARGEST
