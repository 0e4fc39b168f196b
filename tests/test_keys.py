import pytest
from pyspark.sql import functions as F

from paperlake.operators import ingest as ing
from paperlake.operators.keys import assign_ids, place_in_group
from paperlake.operators.lookups import hot_keys, lookup, salted
from paperlake.operators.topics import topic_catalogue, upsert_topics


def test_ids_are_dense_and_follow_the_order(spark):
    rows = spark.range(1000).selectExpr("id % 3 AS g", "999 - id AS n").repartition(7)
    got = assign_ids(rows, 50, ["g", "n"]).collect()
    assert sorted(r["id"] for r in got) == list(range(51, 1051))
    assert [(r["g"], r["n"]) for r in sorted(got, key=lambda r: r["id"])] == sorted(
        (r["g"], r["n"]) for r in got
    )


def test_ids_of_nothing(spark):
    assert assign_ids(spark.range(0).withColumnRenamed("id", "n"), 5, ["n"]).count() == 0


def test_places_in_a_hot_group(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 50)) AS g", "id AS n")
    got = place_in_group(rows.repartition(5), "g", ["n"]).collect()
    by_group = {}
    for r in sorted(got, key=lambda r: r["n"]):
        by_group.setdefault(r["g"], []).append(r["place"])
    assert len(got) == 3000 and all(p == list(range(1, len(p) + 1)) for p in by_group.values())


@pytest.mark.parametrize("most", [1000, 0])
@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_lookup_is_the_same_broadcast_or_salted(spark, most, how):
    rows = spark.range(300).selectExpr("if(id % 3 = 0, 7, if(id % 5 = 0, null, id)) AS k", "id AS n")
    table = spark.range(0, 100).selectExpr("id AS k", "id * 10 AS v")
    got = lookup(rows, table, "k", how, most=most)
    want = rows.join(table, "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.columns == want.columns


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_hot_keys_are_dealt_over_tasks(spark, how):
    """A third of the rows has one key, a tenth none; no task gets more than the bound."""
    rows = spark.range(6000).selectExpr(
        "if(id % 3 = 0, 'hot', if(id % 10 = 1, null, concat('k', id % 700))) AS k", "id AS n"
    )
    table = spark.range(500).selectExpr("if(id = 0, 'hot', concat('k', id)) AS k", "id * 10 AS v")
    got = salted(rows, table, "k", how, hot_rows=100)
    want = rows.join(table, "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.columns == want.columns
    assert hot_keys(rows, "k", 100) == [("hot", 20)]


def test_rows_of_a_hot_key_reach_many_tasks(spark):
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS n")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted(rows, spark.range(100).selectExpr("id AS k", "id AS v"), "k", hot_rows=50)
        most = joined.where("k = 7").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most < 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_topics_are_made_once(spark):
    stored = spark.createDataFrame([(4, "B", "old")], "id long, name string, description string")
    names = spark.createDataFrame([("C",), ("A",), ("B",), ("A",), (None,)], "name string")
    new, everything = upsert_topics(names, stored)
    assert sorted(map(tuple, new.collect())) == [
        (5, "A", "Research papers about A"), (6, "C", "Research papers about C")
    ]
    again, _ = upsert_topics(names, everything)
    assert again.count() == 0 and everything.count() == 3


def test_catalogue_keeps_the_first_position(spark):
    stored = spark.createDataFrame([(9, "Own"), (2, "Deep Learning"), (1, "Later")], "id long, name string")
    names = [r["name"] for r in topic_catalogue(stored).collect()]
    assert names[0] == "All Topics" and names.count("Deep Learning") == 1
    assert names[-2:] == ["Later", "Own"] and len(names) == 10


def test_limits_and_previews_are_per_request(spark):
    rows = spark.createDataFrame(
        [("a", "f", i, 2, f"t{i}") for i in range(5)] + [("b", "f", i, 9, f"u{i}") for i in range(3)],
        "request_id string, feed string, position long, max_results int, title string",
    )
    kept = ing.limit_per_request(rows).collect()
    assert sorted(r["title"] for r in kept) == ["t0", "t1", "u0", "u1", "u2"]
    shown = ing.preview(rows, 4, ("title",)).collect()
    assert {r["request_id"]: [p["title"] for p in r["papers"]] for r in shown} == {
        "a": ["t0", "t1", "t2", "t3"], "b": ["u0", "u1", "u2"]
    }


def test_summary(spark):
    rows = spark.createDataFrame(
        [("a", "stored", None), ("a", "skipped", None), ("a", "failed", "bad date"),
         ("a", "failed", "bad date"), ("b", "skipped", None)],
        "request_id string, outcome string, reason string",
    )
    got = {r["request_id"]: r for r in ing.ingest_summary(rows).collect()}
    assert tuple(got["a"])[1:5] == (4, 1, 1, 2)
    assert [tuple(f) for f in got["a"]["failures"]] == [("bad date", 2)]
    assert tuple(got["b"])[1:] == (1, 0, 1, 0, [])


def test_limits_below_and_above_the_window_keep_the_same_rows(spark, monkeypatch):
    from paperlake.operators import ingest as ing

    rows = spark.createDataFrame(
        [(g, i, 2) for i, g in enumerate(["r", None, "r", None, "s", None, "r"])],
        "request_id string, position long, max_results int",
    )
    found = []
    for limit in (1000, 0):
        monkeypatch.setattr(ing, "WINDOW_ROWS", limit)
        kept = ing.limit_per_request(rows, order=("position",))
        assert dict(kept.dtypes)["place"] == "bigint"
        found.append(sorted(map(str, kept.select("request_id", "position", "place").collect())))
    assert found[0] == found[1] and len(found[0]) == 5
