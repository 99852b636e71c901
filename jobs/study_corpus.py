"""Draw the study corpus: a balanced, seeded sample of a corpus's documents as normalised chunk records.

Each source gets an equal number of chunks, by digests of document ids and the seed, so the sample does not depend on files, order or
partitioning; what a source is short of goes to the others, by size. Records are written as JSON lines by source,
a manifest of counts beside them. A run replaces both, so a rerun writes the same, and repairs a run that broke off.

    spark-submit --py-files skeinwork.zip jobs/study_corpus.py jobs/study_corpus.json --corpus DIR --output DIR

Cases: null or blank texts are not drawn; a null source is the source named by `no_source`; of rows with one id the least text is taken;
a null id is not drawn; fewer documents than asked for are all taken; an empty corpus writes an empty manifest; further columns are not read.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs._run import main
from skeinwork.functions import text as T
from skeinwork.operators import chunking, sampling
from skeinwork.sources import scratch

log = logging.getLogger("jobs.study_corpus")

RECORD = "chunk_id string, text string, document string, section string, token_estimate int, source string"


@dataclass(frozen=True)
class Settings:
    corpus: str = ""  # Parquet
    output: str = ""
    key: str = "doc_id"
    text: str = "text"
    source: str = "source"
    title: str = "lang"  # what stands in a chunk's title behind its source
    no_source: str = "none"
    size: int = 2000
    seed: int = 1508


def study_corpus(spark: SparkSession, s: Settings) -> dict:
    """Draw and write the sample. Gives what was read and written."""
    columns = {"id": F.col(s.key).cast("string"), "source": F.coalesce(F.col(s.source).cast("string"), F.lit(s.no_source)), "title": F.col(s.title).cast("string"), "content": F.col(s.text)}
    rows = spark.read.parquet(s.corpus).select(*(c.alias(n) for n, c in columns.items()))
    able = rows.filter(F.col("id").isNotNull() & (T.strip(F.col("content")) != ""))
    drawn = sampling.balanced_topped(able.select("id", "source").distinct(), s.size, "source", "id", s.seed)
    taken = scratch.stage(drawn, "study-ids")  # `size` ids at most
    full = able.join(taken.select("id", "source"), ["id", "source"], "left_semi").groupBy("id", "source").agg(F.min(F.struct("content", "title")).alias("d"))
    title = F.concat_ws(" -- ", "source", "d.title")
    raw = full.select("id", title.alias("title"), F.col("d.content").alias("content"), T.join_title(title, F.col("d.content")).alias("contents"), "source")
    records = chunking.normalize(raw, "statpearls", keep=("source",)).drop("source_type")
    out = records.repartition("source").sortWithinPartitions("source", "chunk_id")
    out.write.partitionBy("source").mode("overwrite").json(f"{s.output}/chunks")
    counts = able.groupBy("source").agg(F.count_distinct("id").alias("available")).join(taken.groupBy("source").agg(F.count("*").alias("drawn")), "source", "left")
    report = counts.select("source", "available", F.coalesce("drawn", F.lit(0)).cast("long").alias("drawn"), F.lit(s.seed).alias("seed"), F.lit(s.size).alias("requested"))
    report.coalesce(1).write.mode("overwrite").json(f"{s.output}/manifest")
    got = taken.agg(F.count("*").alias("n"), F.count_distinct("source").alias("k")).first()
    done = {"read": rows.count(), "drawn": got["n"], "sources": got["k"]}
    log.info("%s: %d documents read, %d chunks of %d sources written to %s", s.corpus, done["read"], done["drawn"], done["sources"], s.output)
    return done


def output(spark: SparkSession, s: Settings) -> DataFrame:
    """The records as they stand, with their source and what the manifest says of it."""
    said = spark.read.schema("source string, available long, drawn long, seed int, requested int").json(f"{s.output}/manifest")
    return spark.read.schema(RECORD).json(f"{s.output}/chunks").join(F.broadcast(said.select("source", "available", "drawn")), "source")


if __name__ == "__main__":
    main(Settings, study_corpus, ("corpus", "output"))
