from math import fsum

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.llm import multiindex
from paperlake.llm.queries import QUERIES

from .conftest import SMALL


def brute(rows, asked, k):
    """Exact neighbours of the rows that take part: {query: [(id, score)]}."""
    good = {i: v for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in good.items():
        if asked(q):
            scored = sorted((-fsum(a * b for a, b in zip(x, y)), i) for i, y in good.items() if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def grouped(found):
    out = {}
    for row in sorted(map(tuple, found)):
        assert row[1] == len(out.setdefault(row[0], [])) + 1
        out[row[0]].append((row[2], row[3]))
    return out


def test_recall_of_the_production_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found = grouped(QUERIES["op12_approximate_nearest"](spark, SMALL).collect())
    exact = brute(rows, lambda i: i % 20 == 0, 20)
    assert found.keys() == exact.keys()
    held = dict(rows)
    shared = 0
    for query, near in found.items():
        assert len(near) == 20 and query not in dict(near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(s == fsum(a * b for a, b in zip(held[query], held[i])) for i, s in near)
        shared += len(dict(near).keys() & dict(exact[query]).keys())
    assert shared >= 0.9 * 20 * len(exact)


def clustered(seed, n, dim=12, groups=25):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, dim))
    return centres[draw.integers(0, groups, n)] + 0.2 * draw.normal(size=(n, dim))


def test_few_rows_are_met_among_clusters_and_recall_holds(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "SAMPLE_ROWS", 600)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(clustered(2, 3000))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    sample = np.array([v for _, v in rows[:600]])
    assert multiindex.fit(sample, 3000, 5, 0.95).share < 0.35
    found = grouped(multiindex.nearest(df, F.col("id") % 30 == 0, 5, shelf_rows=300).collect())
    exact = brute(rows, lambda i: i % 30 == 0, 5)
    shared = sum(len(dict(found[q]).keys() & dict(near).keys()) for q, near in exact.items())
    assert found.keys() == exact.keys() and shared >= 0.9 * 5 * len(exact)


@pytest.mark.parametrize("shelf_rows,streams", [(10_000, 1_000_000), (40, 7)])
def test_whole_walks_are_exact_with_copies_and_hot_cells(spark, monkeypatch, shelf_rows, streams):
    """recall=1 inside a sample of all rows; a third of the rows has one vector, a tenth of them nearly so."""
    monkeypatch.setattr(multiindex, "STREAM_QUERIES", streams)
    draw = np.random.default_rng(6)
    vectors = clustered(4, 200, 6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, [0.5, 0.25, -1.0, 2.0, 0.0, 1.0]) for i in range(150)]
    rows += [(2000 + i, [0.5, 0.25, -1.0, 2.0, 0.0, 1.0 + 1e-6 * float(draw.normal())]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = grouped(multiindex.nearest(df, F.col("id") % 5 == 0, 4, recall=1.0, shelf_rows=shelf_rows).collect())
    exact = brute(rows, lambda i: i % 5 == 0, 4)
    assert found.keys() == exact.keys()
    assert sum(found[q] == exact[q] for q in exact) >= 0.97 * len(exact)
    assert all(found[q] == exact[q] for q in exact if 1000 <= q < 2000)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], "x"), (20, [0.5, 0.5], "x"), (20, [0.5, 0.5], "y"), (1, None, None), (2, [1.0, None], "x"),
        (3, [nan, 1.0], "x"), (4, [inf, 1.0], "x"), (None, [1.0, 1.0], "x"), (40, [1.0], "x"), (5, [], "x"),
        (6, [3.0, 1.0], None), (7, [0.0, 0.0], "x"), (60, [2.0], "x"), (80, [1.0, 1.0, 1.0], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").withColumn("id", F.lit(1))
    found = grouped(multiindex.nearest(df, F.col("id") % 20 == 0).collect())
    expected = brute([r[:2] for r in rows], lambda i: i % 20 == 0, 20)
    assert found == {q: near for q, near in expected.items() if near}
    assert multiindex.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert multiindex.nearest(df, F.col("id") == 999).count() == 0


def test_walk_meets_pairs_in_order():
    draw = np.random.default_rng(1)
    one, two, counts = draw.normal(size=7), draw.normal(size=5), draw.integers(0, 4, 35)
    summed = (one[:, None] + two).ravel()
    stop, met = multiindex.walk(one, two, counts, int(counts.sum()))
    assert met == np.argsort(summed, kind="stable")[: len(met)].tolist() and stop == summed[met[-1]]
    stop, met = multiindex.walk(one, two, counts, 20)
    assert counts[met].sum() >= 20 > counts[met[:-1]].sum()
    assert set(met) == set(np.flatnonzero(summed <= stop))


def test_shelves():
    first, many = multiindex.shelves(np.array([5, 5, 30, 0, 2, 9]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 5] and many.tolist() == [1, 1, 3, 1, 1, 1]
