"""Vector arithmetic as Catalyst expressions, in double precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatchError


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def cosine_similarity(vector: Column, query: Sequence[float] | Column) -> Column:
    """One minus cosine distance; null when either vector has no direction."""
    if isinstance(query, Column):
        return F.try_divide(dot(vector, query), norm(vector) * norm(query))
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    return F.try_divide(dot(vector, literal(query)), norm(vector) * F.lit(length))


def register_functions(spark: SparkSession) -> None:
    """``cosine_similarity(a, b)`` for SQL texts, as an expression that Catalyst inlines."""
    dot_sql = "aggregate(zip_with({0}, {1}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        f"try_divide({dot_sql.format('a', 'b')}, sqrt({dot_sql.format('a', 'a')}) * sqrt({dot_sql.format('b', 'b')}))"
    )


def check_query(query: Sequence[float], dims: int | None) -> list[float]:
    """Refuse a query vector of the wrong length before any plan is built."""
    if dims is not None and len(query) != dims:
        raise DimensionMismatchError(f"query has {len(query)} dimensions, the table has {dims}")
    return [float(x) for x in query]


def checked(vector: Column, dims: int) -> Column:
    """The vector itself, or an error at write time if its length is wrong."""
    message = F.concat(F.lit(f"expected {dims} dimensions, got "), F.size(vector).cast("string"))
    return F.when(vector.isNull() | (F.size(vector) == dims), vector).otherwise(F.raise_error(message))
