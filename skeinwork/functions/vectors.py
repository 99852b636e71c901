"""Vector expressions over array<float> columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero. The length is bound once, not computed for every element."""
    with_length = F.transform(F.array(as_double(a)), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    scaled = F.transform(with_length, lambda s: F.transform(s["v"], lambda x: x / F.when(s["n"] == 0, 1.0).otherwise(s["n"])))
    return F.element_at(scaled, 1)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def mean_vector(df: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: the mean of all vectors, `center`. Partial sums are combined before the shuffle."""
    parts = df.select(F.posexplode(as_double(F.col(column))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))
