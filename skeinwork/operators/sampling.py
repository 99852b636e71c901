"""Seeded samples that do not depend on partitioning, and their manifests.

Every draw is a digest of key and seed, which SQL engines compute alike.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.operators.ranges import running
from skeinwork.sources.scratch import stage


def draw(seed: int, key: str) -> Column:
    """Digest of a key and the seed, the order of draws."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def unit(seed: int, key: str) -> Column:
    """A number in [0, 1) from a key and the seed: the first 52 bits of the digest."""
    return F.conv(F.left(draw(seed, key), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def size_slots(files: DataFrame, n: int, seed: int = 1508) -> DataFrame:
    """path, size, slots: n draws with replacement, each file by its share of the total size.

    Files stand in the order of their digests, so that running sums need no single sorted list. A draw finds its file by the
    stretch of length total / files that it falls into; a file is in as many stretches as it touches.
    """
    spans = running(files.withColumn("__order", unit(seed, "path")), "__order", __hi="size").withColumn("__lo", F.col("__hi") - F.col("size"))
    known = files.agg(F.sum("size").alias("total"), F.count("*").alias("n")).first()  # two numbers
    width = max((known["total"] or 0) / max(known["n"], 1), 1e-9)
    draws = files.sparkSession.range(n).withColumn("__at", unit(seed, "id") * float(known["total"] or 0)).withColumn("__cell", F.floor(F.col("__at") / width))
    cells = spans.filter("size > 0").select("path", "__lo", "__hi", F.explode(F.sequence(F.floor(F.col("__lo") / width), F.floor(F.col("__hi") / width))).alias("__cell"))
    hit = draws.join(cells, "__cell").filter("__at >= __lo and __at < __hi")
    return files.join(hit.groupBy("path").agg(F.count("*").alias("slots")), "path", "left").withColumn("slots", F.coalesce("slots", F.lit(0).cast("long")))


def sample_in_groups(rows: DataFrame, slots: DataFrame, group: str, key: str, seed: int = 1508) -> DataFrame:
    """Per group as many rows as it has slots (all if it has fewer), without replacement: those of the least digests. Null groups have no slots.

    Rows are filtered to a stretch of digests that holds the sample before they are sorted: about twice the slots of each group, whatever its size.
    A stretch that turns out to hold too few is widened, so the result never depends on it.
    """
    wanted = slots.filter(F.col("slots") > 0).select(group, F.col("slots").alias("__slots"))
    counts = rows.groupBy(group).agg(F.count("*").alias("__count"))
    known = stage(wanted.join(counts, group), "sample-groups")  # a row a group
    place, width = unit(seed, key), 2.0
    while True:
        stretch = known.withColumn("__share", F.least(F.lit(1.0), (F.col("__slots") * width + 50) / F.col("__count")))
        near = stage(rows.join(stretch.drop("__count"), group).filter(place < F.col("__share")), "sample-rows")
        held = near.groupBy(group).agg(F.count("*").alias("__held"))
        short = known.join(held, group, "left").filter(F.coalesce("__held", F.lit(0)) < F.least("__slots", "__count"))
        if short.isEmpty():
            break
        width *= 8
    order = Window.partitionBy(group).orderBy(draw(seed, key), key)
    return near.withColumn("__at", F.row_number().over(order)).filter(F.col("__at") <= F.col("__slots")).select(*rows.columns)


def sample_source(rows: DataFrame, files: DataFrame, n: int, group: str, key: str, seed: int = 1508) -> DataFrame:
    """Size-proportional sample of n rows of one source, sorted by key.

    Files (path, size) get slots by size and give as many rows, or all they have; what is missing is drawn again among the
    files that had no slot, by size, until there is none. A file is drawn from once, so no row comes twice.
    """
    table = stage(files.join(rows.groupBy(F.col(group).alias("path")).agg(F.count("*").alias("rows")), "path", "left").select("path", "size", F.coalesce("rows", F.lit(0)).alias("rows")), "sample-files")
    left, drawn, wanted, turn = table, None, n, 0
    while wanted > 0 and not left.isEmpty():
        slots = stage(size_slots(left.select("path", "size"), wanted, seed + turn).join(left.select("path", "rows"), "path"), "sample-slots")
        hit = slots.filter("slots > 0")
        given = hit.agg(F.coalesce(F.sum(F.least("slots", "rows")), F.lit(0)), F.count("*")).first()
        if not given[1]:  # files of size 0 are never drawn
            break
        drawn = hit.select("path", "slots") if drawn is None else drawn.unionByName(hit.select("path", "slots"))
        left, wanted, turn = slots.filter("slots = 0").select("path", "size", "rows"), wanted - given[0], turn + 1
    if drawn is None:
        return rows.limit(0)
    return sample_in_groups(rows, drawn.withColumnRenamed("path", group), group, key, seed).orderBy(key)


def balanced(rows: DataFrame, n: int, source: str, key: str, seed: int = 1508) -> DataFrame:
    """n // (number of sources) rows of each source, by the order of draws."""
    sources = stage(rows.select(source).distinct(), "sample-sources")
    each = n // max(sources.count(), 1)
    return sample_in_groups(rows, sources.withColumn("slots", F.lit(each)), source, key, seed)


def balanced_topped(rows: DataFrame, n: int, source: str, key: str, seed: int = 1508) -> DataFrame:
    """As `balanced`; what sources are short of, and the remainder of the division, is taken from all that is left, by the order of draws."""
    sources = stage(rows.select(source).distinct(), "sample-sources")
    each = n // max(sources.count(), 1)
    most = stage(sample_in_groups(rows, sources.withColumn("slots", F.lit(n)), source, key, seed), "sample-most")  # n rows of each source hold any top-up
    numbered = most.withColumn("__at", F.row_number().over(Window.partitionBy(source).orderBy(draw(seed, key), key)))
    own = numbered.filter(F.col("__at") <= each)
    more = numbered.filter(F.col("__at") > each).orderBy(draw(seed, key), key, source).limit(n - own.count())
    return own.unionByName(more).drop("__at")


def manifest(rows: DataFrame, source: str, file: str, key: str, seed: int, requested: int | None = None) -> dict:
    """Counts and sorted files of each source, with the seed and the time (UTC)."""
    by = rows.groupBy(source).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(file)).alias("files")).collect()  # a row a source
    return {
        "created_at": datetime.now(timezone.utc).isoformat(),
        "seed": seed,
        "requested": requested,
        "count": sum(r["n"] for r in by),
        "sources": {r[source]: {"count": r["n"], "files": r["files"]} for r in sorted(by, key=lambda r: r[source])},
    }


def most_frequent(rows: DataFrame, column: str, k: int) -> DataFrame:
    """column, n of the k most frequent values; ties: the least."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def fingerprint(rows: DataFrame, key: str, encoders: dict, seed: int) -> dict:
    """Identity of an index: encoders, seed, count, first and last key."""
    r = rows.agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("z")).first()
    return {"encoders": encoders, "seed": seed, "count": r["n"], "first": r["a"], "last": r["z"]}


def check_fresh(saved: dict, now: dict) -> None:
    """Refuse an index that was built from something else."""
    if json.dumps(saved, sort_keys=True, default=str) != json.dumps(now, sort_keys=True, default=str):
        raise ValueError(f"stale index: built from {saved}, the corpus is now {now}; build it again")
