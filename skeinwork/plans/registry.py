"""Registry of the library's own queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "vec_topk_centered_floor_cap"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with equivalent SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one in fewer pieces than there are cores (a small file with one row group) is dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


from skeinwork.plans import dense_queries, evaluation_queries, lexical_queries, text_queries  # noqa: E402,F401  they fill the registry
