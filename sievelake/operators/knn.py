"""Exact nearest rows to one vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = ("l2", "cosinesimil", "innerproduct")


def _vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def inner_product(column: Column, values: Sequence[float]) -> Column:
    return _sum(F.zip_with(column, _vector(values), lambda a, b: a.cast("double") * b))


def squared_l2(column: Column, values: Sequence[float]) -> Column:
    return _sum(F.zip_with(column, _vector(values), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)))


def cosine(column: Column, values: Sequence[float]) -> Column:
    own = F.sqrt(_sum(F.transform(column, lambda a: a.cast("double") * a.cast("double"))))
    length = sum(float(v) * float(v) for v in values) ** 0.5
    return F.try_divide(inner_product(column, values), own * F.lit(length))


def score(column: Column, values: Sequence[float], space: str = "l2") -> Column:
    """Higher is nearer: 1/(1+d*d), (1+cos)/2, or d+1 and 1/(1-d) for products."""
    if space == "l2":
        return F.lit(1.0) / (F.lit(1.0) + squared_l2(column, values))
    if space == "cosinesimil":
        return (F.lit(1.0) + cosine(column, values)) / 2
    if space == "innerproduct":
        p = inner_product(column, values)
        return F.when(p >= 0, p + 1).otherwise(F.lit(1.0) / (F.lit(1.0) - p))
    raise ValueError(f"no such space: {space}")


def distance(column: Column, values: Sequence[float], space: str = "l2") -> Column:
    if space == "l2":
        return F.sqrt(squared_l2(column, values))
    return F.lit(1.0) - cosine(column, values) if space == "cosinesimil" else -inner_product(column, values)


def nearest(df: DataFrame, id_column: str, column: str, vector: Sequence[float], k: int, space: str = "l2", min_score: float | None = None, max_distance: float | None = None, boost: float = 1.0) -> DataFrame:
    """The ``k`` best rows with ``_score``; ties by id.  A top-k, no full sort.

    Rows without a score, as of a zero vector under ``cosinesimil``, are left out."""
    right = F.size(column) == len(vector)
    found = df.filter(right).withColumn("_score", score(F.col(column), vector, space) * F.lit(float(boost))).filter("_score IS NOT NULL")
    if min_score is not None:
        found = found.filter(F.col("_score") >= min_score)
    if max_distance is not None:
        found = found.filter(distance(F.col(column), vector, space) <= max_distance)
    return found.orderBy(F.desc("_score"), id_column).limit(k)
