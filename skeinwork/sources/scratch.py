"""The folder that driver and executors share for written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_FOLDERS: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a temporary folder stands in, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="skeinwork-"))
    return _LOCAL[0]


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the driver ends."""
    context = spark.sparkContext
    folder = f"{scratch_dir(spark)}/skeinwork/{context.applicationId}-tables"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, context._jvm, context._jsc.hadoopConfiguration(), folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _delete(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the JVM may be gone
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table whose readers have all ended."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str, **options: int) -> DataFrame:
    """df written to the shared folder, with options of Spark's writer, and read back, so that it is computed once."""
    path = fresh(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def pieces(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs within reads files in pieces of at most `most` bytes, or of what the session has set if that is less."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", before.strip().lower()).groups()
    spark.conf.set(key, str(min(most, int(number) << 10 * " kmgt".index(unit or " "))))
    try:
        yield
    finally:
        spark.conf.set(key, before)
