import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake import functions as fn

from .conftest import plan_of


@pytest.mark.parametrize(
    "a, b, distance",
    [
        ([1.0, 0.0], [3.0, 0.0], 0.0),
        ([1.0, 0.0], [0.0, 2.0], 1.0),
        ([1.0, 0.0], [-2.0, 0.0], 2.0),
        ([0.0, 0.0], [1.0, 0.0], None),
        (None, [1.0, 0.0], None),
        ([1.0, None], [1.0, 0.0], None),
        ([1.0, 0.0, 0.0], [1.0, 0.0], None),
    ],
)
def test_cosine_distance(spark, a, b, distance):
    rows = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    found = rows.select(fn.cosine_distance(F.col("a"), F.col("b"))).first()[0]
    assert found == (None if distance is None else pytest.approx(distance, abs=1e-12))


def test_normalize_and_text(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    found = rows.select(
        fn.l2_normalize(F.col("v")).alias("u"), fn.vector_to_text(F.col("v")).alias("t")
    )
    got = found.select("u", "t", fn.vector_from_text(F.col("t")).alias("back")).collect()
    assert got[0]["u"] == pytest.approx([0.6, 0.8])
    assert got[0]["t"] == "[3.0,4.0]" and got[0]["back"] == [3.0, 4.0]
    assert got[1]["u"] is None and got[2]["u"] is None and got[2]["t"] is None


def test_column_functions_stay_in_the_jvm(spark):
    rows = spark.createDataFrame([([3.0], "a")], "v array<float>, s string")
    plan = plan_of(
        rows.select(
            fn.cosine_distance(F.col("v"), F.col("v")),
            fn.hash_embedding(F.col("s"), 16),
            fn.title_case(F.col("s")),
        )
    )
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("dim", [1, 7, 64])
def test_hash_embedding_counts_every_term(spark, dim):
    texts = ["a b a", "  One\ttwo\nTWO three  ", "w" * 50 + " x", " ".join(f"t{i % 37}" for i in range(3000))]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    got = rows.select(fn.hash_embedding(F.col("s"), dim)).collect()
    for text, row in zip(texts, got):
        counts = np.zeros(dim)
        for term in text.lower().split():
            counts[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim] += 1
        assert row[0] == pytest.approx(list(counts / np.linalg.norm(counts)), abs=1e-6)


def test_hash_embedding_of_nothing(spark):
    rows = spark.createDataFrame([("",), ("  \n",), (None,)], "s string")
    assert [r[0] for r in rows.select(fn.hash_embedding(F.col("s"), 8)).collect()] == [None] * 3
