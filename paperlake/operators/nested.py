"""Nested JSON columns as typed columns, filtered arrays and summaries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import json_value


def json_fields(df: DataFrame, col: str, fields: dict[str, str | tuple[str, str]]) -> DataFrame:
    """Add a column per entry of ``fields``: name to path, or to (path, type).

    A missing path, or a value that is not of the type, gives null.
    """
    pairs = {n: (p, "string") if isinstance(p, str) else p for n, p in fields.items()}
    return df.withColumns({n: json_value(F.col(col), p, t) for n, (p, t) in pairs.items()})


def json_items(
    df: DataFrame,
    col: str,
    schema: str,
    where: Callable[[Column], Column] | None = None,
    select: Callable[[Column], Column] | None = None,
    flatten: bool = False,
    explode: bool = False,
    out: str = "items",
) -> DataFrame:
    """Filter, project and flatten the JSON array in ``col``.

    ``schema`` is the type of one element. Elements that are not of that type
    count as null, null results are dropped, and a comparison with null keeps
    nothing. ``explode`` gives a row per item instead of an array.
    """
    items = F.from_json(F.col(col), f"array<{schema}>")
    if where is not None:
        items = F.filter(items, where)
    if select is not None:
        items = F.transform(items, select)
    items = F.array_compact(items)
    if flatten:
        items = F.array_compact(F.flatten(items))
    return df.withColumn(out, F.explode(items) if explode else items)


def array_sum(items: Column) -> Column:
    """Sum of the numbers of an array; 0 for an empty one."""
    numbers = F.array_compact(items.cast("array<double>"))
    return F.aggregate(numbers, F.lit(0.0), lambda total, x: total + x)


def array_avg(items: Column) -> Column:
    """Mean of the numbers of an array; null for an empty one."""
    numbers = F.array_compact(items.cast("array<double>"))
    return F.try_divide(array_sum(items), F.size(numbers))


def sort_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """An array of structs in the order of ``key``; equal keys keep their order."""
    keyed = F.transform(
        items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))
    )
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def min_by(items: Column, key: Callable[[Column], Column]) -> Column:
    return F.get(sort_by(items, key), F.lit(0))


def max_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """The element with the greatest key, the first of equal ones."""
    keyed = F.transform(
        items, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), x.alias("x"))
    )
    return F.array_max(keyed)["x"]


def merge_maps(*maps: Column) -> Column:
    """Maps joined into one; where a key repeats the later map wins."""

    def without(earlier: Column, later: Column) -> Column:
        return F.map_filter(earlier, lambda k, _: ~F.map_contains_key(later, k))

    return reduce(lambda merged, later: F.map_concat(without(merged, later), later), maps)


def json_summaries(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """Summaries of an array column: sum, avg, min, max, length, sorted, joined, first."""
    items = F.col(col)
    return df.withColumns({
        f"{prefix}sum": array_sum(items),
        f"{prefix}avg": array_avg(items),
        f"{prefix}min": F.array_min(items),
        f"{prefix}max": F.array_max(items),
        f"{prefix}length": F.size(items),
        f"{prefix}sorted": F.sort_array(items),
        f"{prefix}joined": F.array_join(items.cast("array<string>"), ","),
        f"{prefix}first": F.get(F.array_compact(items), F.lit(0)),
    })


def map_summaries(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """Sorted keys, values in the order of their keys, and entry count of a map column."""
    entries = F.array_sort(F.map_entries(F.col(col)))
    return df.withColumns({
        f"{prefix}keys": F.transform(entries, lambda e: e["key"]),
        f"{prefix}values": F.transform(entries, lambda e: e["value"]),
        f"{prefix}length": F.size(col),
    })
