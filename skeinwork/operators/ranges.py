"""Running sums over a whole table without sorting it in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at least and at most, and about how many rows a range has in between.
BUCKETS, MOST, ROWS = 64, 4096, 1_000_000


def place(x: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at or below x, by two looks at about the root of their number each."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    every = F.array(*map(F.lit, bounds))
    coarse = F.size(F.filter(F.array(*map(F.lit, bounds[step - 1 :: step])), lambda b: b <= x))
    return F.element_at(F.transform(F.array(coarse), lambda c: c * step + F.size(F.filter(F.slice(every, c * step + 1, F.lit(step)), lambda b: b <= x))), 1)


def running(df: DataFrame, order: str, **sums: str) -> DataFrame:
    """df with a running sum (its own row included) of a column for each keyword, by the numeric column `order`.

    Rows are dealt to value ranges with fixed bounds near the quantiles, as many as the rows ask for; sums run within a range and
    start from the totals of the ranges below, a table of at most MOST + 1 rows. Equal values of `order`
    share a range; they should be distinct, or ordered by nothing else.
    """
    n = min(MOST, max(BUCKETS, df.count() // ROWS))
    bounds = sorted(set(df.approxQuantile(order, [i / n for i in range(1, n)], min(0.005, 0.25 / n))))
    placed = df.withColumn("__range", place(F.col(order), bounds))
    totals = placed.groupBy("__range").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    below = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", *(F.coalesce(F.sum(f"__{n}").over(below), F.lit(0)).alias(f"__{n}") for n in sums))
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *(F.sum(c).over(inside).alias(n) for n, c in sums.items())).join(F.broadcast(starts), "__range")
    return summed.select(*df.columns, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in sums))
