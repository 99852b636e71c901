"""Helpers of the training-data operators: shared scratch tables and size checks."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of every operator here: maximal runs of anything but ASCII white space.
WORD_SPLIT = r"[\x20\x09-\x0D]+"

#: A side of a join is sent to all executors only if its measured size is below this.
BROADCAST_BYTES = 16 << 20

#: Spark's setting to delete a statement's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests on one machine) a temporary folder stands in, and only on a
    local master; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="skeinwork-"))
    return _LOCAL[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage ends here, so work is not
    repeated and a lost executor costs only its own tasks. Shuffle files of the write go when it has ended."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    got = spark.read.schema(df.schema).parquet(path)
    got._staged_at = path
    return got


_FOLDERS: set[str] = set()


def _folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    context = spark.sparkContext
    folder = f"{shared_dir(spark).rstrip('/')}/skeinwork/{context.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, context._jvm, context._jsc.hadoopConfiguration(), folder)
    return folder


def _delete(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the JVM may be gone
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def discard(*staged: DataFrame) -> None:
    """Delete staged tables whose readers have all been written."""
    for df in staged:
        context = df.sparkSession.sparkContext
        p = context._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


#: Emptied before an operator fills a task's memory: what operators keep in a worker process from task to task.
CACHES: list[dict] = []


def release() -> None:
    for cache in CACHES:
        cache.clear()


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df, at about row_bytes a row, is below limit; counts no more rows than needed."""
    most = max(1, limit // row_bytes)
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast df if its measured size allows; else leave the join to a shuffle."""
    return F.broadcast(df) if small(df, row_bytes, limit) else df


def spare_name(columns: list[str], base: str) -> str:
    """A name for a helper column that no column has, in any case of letters."""
    taken, name = {c.lower() for c in columns}, f"__{base}"
    while name in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """Bind value to a lambda variable, so that it is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table; with `spread`, one in fewer pieces than there are cores (a small file with one row group) is dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df
