"""SQL names for the column functions that SQL users need."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = (
    "aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (t, x) -> t + x)"
)

_SQL_FUNCTIONS = {
    "vector_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": _DOT.format(a="a", b="b"),
    "vector_norm(a ARRAY<FLOAT>) RETURNS DOUBLE": f"sqrt({_DOT.format(a='a', b='a')})",
    "cosine_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": (
        "1D - try_divide(vector_dot(a, b), sqrt(vector_dot(a, a) * vector_dot(b, b)))"
    ),
    "title_case(s STRING) RETURNS STRING": (
        r"array_join(transform(regexp_extract_all(s, "
        r"r'[\p{IsUppercase}\p{IsLowercase}\p{Lt}]+|[^\p{IsUppercase}\p{IsLowercase}\p{Lt}]+', 0), "
        r"p -> initcap(p)), '')"
    ),
}


def register_functions(spark: SparkSession) -> None:
    """Create ``vector_dot``, ``vector_norm``, ``cosine_distance``, ``title_case``.

    They are SQL functions, so the optimiser inlines their bodies.
    """
    for signature, body in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
