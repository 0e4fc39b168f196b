"""Vector arithmetic over ``array<float>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double; null if a length differs or an element is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """``a`` scaled to length 1; null for the zero vector."""
    return _let(
        l2_norm(a),
        lambda n: F.when(
            n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float"))
        ),
    )


def cosine_distance(a: Column, b: Column, unit: bool = False) -> Column:
    """1 minus the cosine of the angle, so smaller is nearer.

    Null for a zero or missing vector. ``unit=True`` skips the two norms where
    both sides are known to have length 1.
    """
    if unit:
        return F.lit(1.0) - dot(a, b)
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def vector_to_text(col: Column) -> Column:
    """``[a,b,c]``, the text form vector databases read."""
    return F.concat(F.lit("["), F.array_join(col.cast("array<string>"), ","), F.lit("]"))


def vector_from_text(col: Column) -> Column:
    return F.from_json(col, "array<float>")


def hash_embedding(text: Column, dim: int) -> Column:
    """Embed a text without a model: hashed term counts, scaled to length 1.

    Each white-space separated term adds 1 to one of ``dim`` buckets. The
    counts are made inside the row: the buckets of all terms plus one of every
    bucket are sorted, and the length of each run, less that one, is the count.
    So the whole text is used, nothing is shuffled, and the work is that of a
    sort. A text without terms has no embedding (null).
    """
    terms = F.filter(F.split(F.lower(text), r"\s+"), lambda t: F.length(t) > 0)
    buckets = F.transform(
        terms,
        lambda t: (
            F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % dim
        ).cast("int"),
    )
    padded = F.sort_array(F.concat(buckets, F.sequence(F.lit(0), F.lit(dim - 1))))

    def run_ends(b: Column) -> Column:
        # 1-based position of the last entry of each bucket, in bucket order
        marks = F.transform(
            b, lambda x, i: F.when(F.coalesce(F.get(b, i + 1) != x, F.lit(True)), i + 1)
        )
        return F.array_compact(marks)

    def counts(ends: Column) -> Column:
        return F.transform(
            ends,
            lambda e, i: (e - F.coalesce(F.get(ends, i - 1), F.lit(0)) - 1).cast("float"),
        )

    return _let(
        padded, lambda b: _let(run_ends(b), lambda e: _let(counts(e), l2_normalize))
    )
