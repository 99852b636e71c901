"""Reading and writing chunk files, vectors, manifests, caches and logs, with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_CHUNK = "id string, title string, content string, contents string"
CHUNK = "chunk_id string, text string, source_type string, document string, section string, token_estimate int"
VECTOR = "chunk_id string, document string, embedding array<float>"
MESSAGE = "question_id string, step int, role string, content string"
CACHE = "question_id string, round int, context string"
JUDGED = "user_input string, response string, retrieved_contexts array<string>, reference_contexts array<string>, reference string"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def state(spark: SparkSession, path: str) -> str:
    """What a folder or file holds, in short: path, bytes, files, time of change."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    total = fs.getContentSummary(p)
    return f"{path} {total.getLength()} {total.getFileCount()} {fs.getFileStatus(p).getModificationTime()}"


def read_raw_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Raw chunks of the *.jsonl files of a folder with source_file; blank lines and empty files give no rows, bad lines are errors."""
    rows = spark.read.schema(RAW_CHUNK).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(path)
    return rows.withColumn("source_file", F.col("_metadata.file_name"))


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """source_file, line_no (from 0), value: the lines of text files by their place; a file is read by one task."""
    rows = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("source_file"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("line_no", "value"))


def lines_of(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """Raw chunks to hits (source_file, line_no): the line at that place, parsed."""
    record = F.from_json("value", RAW_CHUNK)
    return hits.join(lines, ["source_file", "line_no"]).withColumn("record", record).drop("value").select("*", "record.*").drop("record")


def read_encyclopedia(spark: SparkSession, path: str) -> DataFrame:
    """id, title, text of a local copy of an encyclopedia data set in Parquet; null texts are empty."""
    rows = spark.read.parquet(path)
    return rows.select(F.col("id").cast("string").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def read_index(spark: SparkSession, path: str, chunks: DataFrame, identity: dict | None = None) -> DataFrame:
    """Stored vectors with the metadata of their chunks; a vector without a chunk is an error when the row is read."""
    from skeinwork.operators.fusion import lookup

    return lookup(read_vectors(spark, path, identity), chunks, "chunk_id")


def read_judged(spark: SparkSession, path: str) -> DataFrame:
    """Samples for external judges: a JSON array of objects or JSON lines."""
    return spark.read.schema(JUDGED).option("multiLine", "true").json(path)


def read_chat_style(spark: SparkSession, path: str) -> dict[str, str]:
    """A chat style from a small JSON file with start, user and assistant (see text.chat_template); indentation and line ends of
    the file are left out of its strings, \\n in them stays."""
    return {k: "".join(line.strip() for line in v.splitlines()) if "\n" in v.strip("\n") else v for k, v in read_json(spark, path).items()}


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: write it with write_chunks() after sampling")
    return spark.read.schema(CHUNK).json(path)


def write_chunks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_chunk_files(df: DataFrame, path: str, existing: str = "skip") -> None:
    """Chunks by source file, a folder each (column source_file). Files that are there already are skipped or overwritten,
    the others stay as they are; a file without chunks makes no folder."""
    spark = df.sparkSession
    if existing not in ("skip", "overwrite"):
        raise ValueError("existing must be 'skip' or 'overwrite'")
    if existing == "skip" and exists(spark, path):
        df = df.join(spark.read.json(path).select("source_file").distinct(), "source_file", "left_anti")
    mode = {"skip": "append", "overwrite": "overwrite"}[existing]
    df.write.partitionBy("source_file").option("partitionOverwriteMode", "dynamic").mode(mode).json(path)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, size of the *.jsonl files, without reading them; none is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path).select("path", F.col("length").alias("size"))
    if not found.limit(1).count():
        raise FileNotFoundError(f"{path} holds no *.jsonl file")
    return found


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """title (the file's name without .txt), text of whole text files."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return rows.select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("title"), F.col("value").alias("text"))


def read_whole_xml(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """name, xml of whole files (compressed ones are unpacked)."""
    rows = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.regexp_replace("_metadata.file_name", r"\.(nxml|xml)(\.gz)?$", "").alias("name"), F.col("value").alias("xml"))


def read_xml_records(spark: SparkSession, path: str, glob: str, end: str = "</PubmedArticle>") -> DataFrame:
    """name, xml of the records of large files: a record is what stands up to and with its end tag, so no row holds a file, and
    uncompressed files are read by many tasks. What is behind the last record is a row too."""
    rows = spark.read.option("pathGlobFilter", glob).option("lineSep", end).text(path)
    return rows.select(F.regexp_replace("_metadata.file_name", r"\.(nxml|xml)(\.gz)?$", "").alias("name"), F.concat("value", F.lit(end)).alias("xml"))


def write_batches(df: DataFrame, path: str, per_file: int = 10_000) -> None:
    """JSON lines of at most per_file rows a file."""
    df.write.option("maxRecordsPerFile", per_file).mode("overwrite").json(path)


def write_numbered(df: DataFrame, path: str, order: str, per_file: int = 10_000, digits: int = 4) -> None:
    """JSON lines in batches of per_file rows by the numeric column `order`, in folders with zero-padded numbers; the last may be short."""
    from skeinwork.operators.chunking import batch_number

    numbered = batch_number(df, order, per_file)
    numbered.withColumn("batch", F.lpad(F.col("batch").cast("string"), digits, "0")).repartition("batch").write.partitionBy("batch").mode("overwrite").json(path)


def write_results(df: DataFrame, path: str, run: str, key: str = "question_id") -> None:
    """Results of a run (snippets, replies), a row a question; questions that the run has already stay as they are."""
    spark = df.sparkSession
    rows = df.withColumn("run", F.lit(run))
    if exists(spark, path):
        had = spark.read.parquet(path).filter(F.col("run") == run).select(key)
        rows = rows.join(had, key, "left_anti")
    rows.write.partitionBy("run").mode("append").parquet(path)


def write_missing(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key is not there yet (resumable output)."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df.write.mode("append").parquet(path)


def write_vectors(df: DataFrame, path: str, identity: dict) -> None:
    """Vectors, and the identity of what they were built from beside them."""
    df.write.mode("overwrite").parquet(f"{path}/vectors")
    write_json(df.sparkSession, {"index": identity}, f"{path}/manifest")


def read_vectors(spark: SparkSession, path: str, identity: dict | None = None) -> DataFrame:
    """Vectors; with an identity, only if they were built from that."""
    from skeinwork.operators.sampling import check_fresh

    if identity is not None:
        check_fresh(read_json(spark, f"{path}/manifest")["index"], json.loads(json.dumps(identity, default=str)))
    return spark.read.parquet(f"{path}/vectors")


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small document, such as a manifest."""
    spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def merge_json(spark: SparkSession, value: dict, path: str) -> dict:
    """Add keys to a saved document; what is there under other keys stays."""
    now = (read_json(spark, path) if exists(spark, path) else {}) | value
    write_json(spark, now, path)
    return now


def write_text_cache(chunks: DataFrame, path: str) -> None:
    """id -> title, content; of equal ids the last line of the last file wins."""
    from skeinwork.operators.fusion import last_per_key

    at = F.concat_ws("#", "source_file", F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")) if "source_file" in chunks.columns else F.monotonically_increasing_id()
    last_per_key(chunks.withColumn("__order", at), "id", "__order").select("id", "title", "content").write.mode("overwrite").parquet(path)


def resume(cache: DataFrame, n_rounds: int) -> DataFrame:
    """question_id, context, left: the last of each question's first n_rounds cached contexts and the rounds left."""
    held = cache.filter(F.col("round") < n_rounds).groupBy("question_id").agg(F.max_by("context", "round").alias("context"), F.count("*").alias("n"))
    return held.select("question_id", "context", (F.lit(n_rounds) - F.col("n")).alias("left"))


def append_log(df: DataFrame, path: str) -> None:
    """Append-only event table (messages, errors, caches)."""
    df.write.mode("append").parquet(path)


def judge_samples(answers: DataFrame, question: str, answer: str, contexts: str, references: str, reference: str) -> DataFrame:
    """Rows in the exchange form of external judges."""
    columns: dict[str, Column] = {"user_input": F.col(question), "response": F.col(answer), "retrieved_contexts": F.col(contexts), "reference_contexts": F.col(references), "reference": F.col(reference)}
    return answers.select(*(c.alias(n) for n, c in columns.items()))
