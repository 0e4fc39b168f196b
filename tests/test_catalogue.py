"""Every registered query against its SQL, on the smallest of the given folders."""

import importlib
import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from catalogue import QUERIES
from compare import compare

FOLDER = os.environ.get("COMPARE_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    same, note = compare(spark, FOLDER, name)
    assert same, note


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["qid", "role", "prompt"] and rows.count() > 0


def test_feeds_are_as_many_as_their_texts_ask_for(spark, tmp_path, monkeypatch):
    """A feed is read by one task, so feeds grow in number, not in size."""
    ingesting = importlib.import_module("catalogue.ingesting")
    monkeypatch.setattr(ingesting, "FEED_BYTES", 10_000)
    docs = spark.range(200).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 100).alias("text"), F.lit("en").alias("lang"),
        F.lit("src1").alias("source"),
    )
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    files = ingesting.write_feed(ingesting.atom_entries(spark, str(tmp_path)), str(tmp_path / "feed"), 3)
    sizes = [f.stat().st_size for f in (tmp_path / "feed").glob("part-*")]
    assert files == 10 and len(sizes) == 10 and max(sizes) < 30_000
    assert ingesting.write_feed(ingesting.atom_entries(spark, str(tmp_path)).limit(3), str(tmp_path / "few"), 3) == 3
