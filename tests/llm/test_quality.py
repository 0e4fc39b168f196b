import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperlake.llm import quality
from paperlake.llm.common import TEXT_ROWS, id_bucket
from paperlake.llm.queries import QUERIES

from .conftest import SMALL


def test_pair_sum_is_that_of_all_pairs():
    draw = np.random.default_rng(3)
    n = quality.SIZE
    machine = quality.Machine(
        0.3, draw.normal(size=n), draw.normal(size=(n, 4)), np.zeros((len(quality.STATISTICS), quality.BINS - 1))
    )
    places, values = np.array([4, 90, 17, 2000, n - 1]), draw.normal(size=5)
    slow = machine.bias + sum(machine.linear[p] * v for p, v in zip(places, values))
    for i in range(5):
        for j in range(i):
            slow += machine.factors[places[i]] @ machine.factors[places[j]] * values[i] * values[j]
    assert machine.raw([(places, values), (places[:1], values[:1])])[0] == pytest.approx(slow)


def test_held_out_accuracy(spark):
    rows = QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = rows.merge(labels, on="doc_id")
    held = held[held.held_out]
    assert len(held) > 80 and (held.predicted == held.quality).mean() > 0.95
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.98


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("quality", F.when(id_bucket("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    same = [sorted(quality.classify(docs, x).collect()) for x in (labels, turned)]
    assert same[0] == same[1]


def test_odd_documents(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (None, 1), (5, 7), (6, None)], "doc_id long, quality int")
    rows = quality.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out is not None for r in rows)
    ones = {r.score for r in rows if r.doc_id == 1}
    assert len(ones) == 1
    kept = quality.keep(odd_docs, quality.train(odd_docs, labels), 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_without_labels_or_documents(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(odd_docs, none).collect()} == {0.5}
    assert quality.classify(odd_docs.limit(0), none).count() == 0


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    @F.arrow_udf("double")
    def rows_at_a_time(text: pa.Array) -> pa.Array:
        return pa.array([float(len(text))] * len(text))

    monkeypatch.setattr(quality, "with_score", lambda docs, _, column: docs.withColumn(column, rows_at_a_time("text")))
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep(docs, None, 1.0).count() == 2000
    assert quality.keep(docs, None, TEXT_ROWS + 1.0).count() == 0
    assert max(r.score for r in quality.classify(docs, none).collect()) <= TEXT_ROWS
