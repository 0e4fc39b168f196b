import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperlake.operators import nested as ns
from paperlake.operators.values import canonical_url, normalize_dates


def test_fields(spark):
    rows = spark.createDataFrame(
        [('{"a": {"b": [1, 2]}, "s": "x"}',), ('{"a": 5}',), ("broken",), (None,)], "j string"
    )
    got = ns.json_fields(rows, "j", {"second": ("a.b[1]", "int"), "s": "s", "bad": ("s", "int")})
    assert [tuple(r)[1:] for r in got.collect()] == [(2, "x", None)] + [(None, None, None)] * 3


def test_items(spark):
    text = '[{"n": 3, "t": ["a", "b"]}, {"n": 1, "t": ["c"]}, {"n": null}, {"n": 9, "t": null}]'
    rows = spark.createDataFrame([(1, text), (2, "[]"), (3, None)], "i int, j string")
    schema = "struct<n: double, t: array<string>>"
    kept = ns.json_items(rows, "j", schema, where=lambda x: x["n"] > 2, select=lambda x: x["n"])
    assert [r["items"] for r in kept.orderBy("i").collect()] == [[3.0, 9.0], [], None]
    flat = ns.json_items(rows, "j", schema, select=lambda x: F.coalesce(x["t"], F.array()), flatten=True)
    assert flat.where("i = 1").first()["items"] == ["a", "b", "c"]
    each = ns.json_items(rows, "j", schema, select=lambda x: x["n"], explode=True)
    assert [(r["i"], r["items"]) for r in each.collect()] == [(1, 3.0), (1, 1.0), (1, 9.0)]


def test_only_numbers_compare(spark):
    rows = spark.createDataFrame([('[{"n": "7"}, {"n": 7}, {"n": true}]',)], "j string")
    kept = ns.json_items(rows, "j", "struct<n: double>", where=lambda x: x["n"] > 1)
    assert [x["n"] for x in kept.first()["items"]] == [7.0]


def test_summaries(spark):
    rows = spark.createDataFrame([(1, [2.0, None, 1.0]), (2, [])], "i int, v array<double>")
    got = {r["i"]: r for r in ns.json_summaries(rows, "v").collect()}
    assert (got[1]["sum"], got[1]["avg"], got[1]["min"], got[1]["max"]) == (3.0, 1.5, 1.0, 2.0)
    assert got[1]["length"] == 3 and got[1]["first"] == 2.0
    assert (got[2]["sum"], got[2]["avg"], got[2]["min"], got[2]["first"]) == (0.0, None, None, None)


def test_by_key(spark):
    rows = spark.createDataFrame(
        [([(2, "b"), (1, "a"), (2, "c"), (1, "d")],), ([],)], "v array<struct<n:int,s:string>>"
    )
    key = lambda x: x["n"]
    got = rows.select(
        ns.min_by(F.col("v"), key)["s"], ns.max_by(F.col("v"), key)["s"],
        F.transform(ns.sort_by(F.col("v"), key), lambda x: x["s"]),
    ).collect()
    assert tuple(got[0]) == ("a", "b", ["a", "d", "b", "c"])
    assert tuple(got[1]) == (None, None, [])


def test_maps(spark):
    rows = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": 4})], "m map<string,int>, n map<string,int>")
    merged = rows.select(ns.merge_maps(F.col("m"), F.col("n")).alias("x"))
    assert merged.first()["x"] == {"a": 1, "b": 3, "c": 4}
    row = ns.map_summaries(merged, "x").first()
    assert (row["keys"], row["values"], row["length"]) == (["a", "b", "c"], [1, 3, 4], 3)


def test_dates(spark):
    rows = spark.createDataFrame([(" 2024-02-03",), ("03.02.2024",), ("never",), (None,)], "d string")
    good, bad = normalize_dates(rows, "d", ["yyyy-MM-dd", "dd.MM.yyyy"])
    assert {r["parsed"] for r in good.collect()} == {dt.datetime(2024, 2, 3)}
    assert good.count() == 2 and [r["reasons"] for r in bad.collect()] == [["unread date"]] * 2


@pytest.mark.parametrize(
    "url, plain",
    [
        ("HTTP://Example.COM/A/./b/../c?Q=1#top", "http://example.com/A/c?Q=1"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com#x", "https://example.com/"),
        ("https://User:Pw@Example.com:8080/x/", "https://User:Pw@example.com:8080/x/"),
        ("http://e.com/a/b/..", "http://e.com/a/"),
        ("http://e.com/../../a", "http://e.com/a"),
        ("http://e.com/a/.", "http://e.com/a/"),
        (None, None),
    ],
)
def test_urls(spark, url, plain):
    rows = spark.createDataFrame([(url,)], "u string")
    assert rows.select(canonical_url(F.col("u"))).first()[0] == plain
