"""Nested JSON, mixed dates, addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.operators import nested as ns
from paperlake.operators.values import canonical_url, normalize_dates

from .base import query, table


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CAST(NULL AS VARCHAR) AS missing FROM events""")
def json_fields(spark, folder):
    fields = ns.json_fields(
        table(spark, folder, "events"), "props", {"k": ("k", "int"), "missing": "a.b[0]"}
    )
    return fields.select("event_id", "k", "missing")


@query("""
SELECT vec_id, CAST(embedding[i] AS DOUBLE) * 2 AS doubled
FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i) WHERE embedding[i] > 0.1""")
def json_items(spark, folder):
    """Vectors as JSON arrays: the numbers above 0.1, doubled, one row each."""
    rows = table(spark, folder, "embeddings").select(
        "vec_id", F.to_json("embedding").alias("numbers")
    )
    found = ns.json_items(
        rows, "numbers", "float",
        where=lambda x: x > F.lit(0.1).cast("float"), select=lambda x: x.cast("double") * 2, explode=True, out="doubled",
    )
    return found.select("vec_id", "doubled")


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, round(list_sum(v), 6) + 0.0 AS sum, round(list_avg(v), 6) + 0.0 AS avg,
       list_min(v) AS min, list_max(v) AS max, CAST(len(v) AS BIGINT) AS length, v[1] AS first,
       list_sort(v)[32] AS middle
FROM e""")
def json_summaries(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v")
    )
    found = ns.json_summaries(rows, "v")
    return found.select(
        "vec_id",
        (F.round("sum", 6) + 0.0).alias("sum"),
        (F.round("avg", 6) + 0.0).alias("avg"),
        "min",
        "max",
        F.col("length").cast("long").alias("length"),
        "first",
        F.col("sorted")[31].alias("middle"),
    )


@query("""
SELECT vec_id, list_position(embedding, list_min(embedding)) - 1 AS lowest,
       list_position(embedding, list_max(embedding)) - 1 AS highest
FROM embeddings""")
def json_extremes(spark, folder):
    """Which place of each vector holds its least and its greatest number."""
    items = F.transform("embedding", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    rows = table(spark, folder, "embeddings").select("vec_id", items.alias("items"))
    return rows.select(
        "vec_id",
        ns.min_by(F.col("items"), lambda s: s["x"])["i"].alias("lowest"),
        ns.max_by(F.col("items"), lambda s: s["x"])["i"].alias("highest"),
    )


@query("""
SELECT event_id, 'k,type' AS keys, json_extract_string(props, '$.k') || ',' || event_type AS values,
       CAST(2 AS BIGINT) AS length
FROM events""")
def json_maps(spark, folder):
    """The JSON object of an event merged with its type, as a map."""
    merged = ns.merge_maps(
        F.create_map(F.lit("k"), F.lit("old")),
        F.from_json("props", "map<string,string>"),
        F.create_map(F.lit("type"), F.col("event_type")),
    )
    rows = table(spark, folder, "events").select("event_id", merged.alias("m"))
    found = ns.map_summaries(rows, "m")
    return found.select(
        "event_id",
        F.array_join("keys", ",").alias("keys"),
        F.array_join("values", ",").alias("values"),
        F.col("length").cast("long").alias("length"),
    )


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM events WHERE event_type <> 'error'""")
def normalized_dates(spark, folder):
    """Event times written in four ways, one of them unreadable."""
    kind = F.col("event_type")
    written = (
        F.when(kind == "error", F.lit("soon"))
        .when(kind == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == "click", F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
        .otherwise(F.date_format("ts", "MMM d, yyyy HH:mm:ss"))
    )
    rows = table(spark, folder, "events").select("event_id", written.alias("written"))
    good, _ = normalize_dates(
        rows, "written", ["yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MMM d, yyyy HH:mm:ss"]
    )
    return good.select("event_id", F.date_format("parsed", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("""
SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages""")
def canonical_urls(spark, folder):
    """Addresses spoilt by case and dot segments, brought back."""
    spoilt = F.regexp_replace(
        F.regexp_replace("url", "^http", "HTTP"), r"\.example\.([a-z]+)/", ".EXAMPLE.$1/./x/../"
    )
    return table(spark, folder, "pages").select("page_id", canonical_url(spoilt).alias("url"))
