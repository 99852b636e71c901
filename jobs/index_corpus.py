"""Keep the lexical index of a growing corpus up to date.

A file stream takes what is new among the corpus's files since the last run (its checkpoint remembers) and adds each batch to the
index as a segment under the batch's number: postings by segment and bucket of the term, term counts, document lengths, totals.
A batch that is run again, after a crash, writes the same segment again. Documents whose id another segment holds are left
out, so a file delivered twice changes nothing, and an index whose checkpoint was lost is completed, not doubled.

    spark-submit --py-files skeinwork.zip jobs/index_corpus.py jobs/index_corpus.json --corpus DIR --output DIR --checkpoint DIR

Cases: null texts are documents without terms; a null id is an id; empty files and an empty corpus add no segment; rows with
one id in one batch count once; further columns are not read.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs._run import main
from skeinwork.functions import stem
from skeinwork.functions import text as T
from skeinwork.operators import lexical

log = logging.getLogger("jobs.index_corpus")


@dataclass(frozen=True)
class Settings:
    corpus: str = ""  # folder, file or glob of Parquet files
    output: str = ""
    checkpoint: str = ""
    key: str = "doc_id"
    text: str = "text"
    stop_words: bool = False
    stemming: str = ""  # "", "plural" or "porter"
    buckets: int = 64
    files_per_batch: int = 1000


def _glob(path: str) -> str:
    """The path as a pattern that only it fits: file streams take patterns, and single files only by one."""
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def index_corpus(spark: SparkSession, s: Settings) -> dict:
    """Add the corpus's new documents to its index. Gives what was read and written by this run."""
    if s.stemming not in ("", "plural", "porter"):
        raise ValueError(f"stemming must be '', 'plural' or 'porter', not {s.stemming!r}")
    analyze = T.analyzer(T.STOP_WORDS if s.stop_words else (), T.s_stem if s.stemming == "plural" else None, stem_all=stem.stems if s.stemming == "porter" else None)
    corpus = s.corpus.rstrip("/")
    schema = spark.read.parquet(corpus).select(s.key, s.text).schema
    done = {"batches": 0, "read": 0, "added": 0}

    def add(batch: DataFrame, number: int) -> None:
        added = lexical.add_documents(batch, s.output, number, s.key, s.text, analyze, identity=corpus, buckets=s.buckets)
        read = batch.count()
        for name, n in (("batches", 1), ("read", read), ("added", added)):
            done[name] += n
        log.info("batch %d: %d documents read from %s, %d new ones written as segment %d of %s", number, read, corpus, added, number, s.output)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", s.files_per_batch).parquet(_glob(corpus))
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", s.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d batches, %d documents read, %d added", corpus, done["batches"], done["read"], done["added"])
    return done


def output(spark: SparkSession, s: Settings) -> DataFrame:
    """term, id, tf, length, bucket of the whole segments of the index."""
    return lexical.open_index(spark, s.output).postings.select("term", F.col("id").alias(s.key), "tf", "length", "bucket")


if __name__ == "__main__":
    main(Settings, index_corpus, ("corpus", "output", "checkpoint"))
