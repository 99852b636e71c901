import gzip
import json

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import models
from skeinwork.operators import chunking
from skeinwork.sources import tables
from skeinwork.streaming import ingest


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "chunk"
    folder.mkdir()
    rows = [{"id": f"d_{i}", "title": "T", "content": f"text {i}", "contents": f"T. text {i}"} for i in range(5)]
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, rows[:3])) + "\n\n")
    (folder / "b.jsonl").write_text("\n".join(map(json.dumps, rows[3:])))
    (folder / "c.jsonl").write_text("")
    (folder / "skip.txt").write_text("no")
    return str(folder)


def test_raw_chunks(spark, raw):
    rows = tables.read_raw_chunks(spark, raw).collect()
    assert len(rows) == 5 and {r["source_file"] for r in rows} == {"a.jsonl", "b.jsonl"}
    assert tables.file_sizes(spark, raw).count() == 2  # an empty file has no weight


def test_chunks_round_trip(spark, raw, tmp_path):
    records = chunking.normalize(tables.read_raw_chunks(spark, raw).drop("source_file"), "textbook")
    tables.write_chunks(records, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_chunks(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, records.collect()))
    with pytest.raises(FileNotFoundError):
        tables.read_chunks(spark, str(tmp_path / "none"))


def test_books_and_xml(spark, tmp_path):
    (tmp_path / "text.txt").write_text("one\ntwo")
    with gzip.open(tmp_path / "p.xml.gz", "wt") as f:
        f.write("<PMID>1</PMID><Article><ArticleTitle>T</ArticleTitle><AbstractText>a</AbstractText></Article>")
    assert tuple(tables.read_books(spark, str(tmp_path)).first()) == ("text", "one\ntwo")
    assert chunking.citation_chunks(tables.read_whole_xml(spark, str(tmp_path), "*.xml.gz")).first()["id"] == "PMID:1"


def test_vectors_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", "d", [1.0])], tables.VECTOR)
    path = str(tmp_path / "index")
    tables.write_vectors(df, path, {"count": 1})
    assert tables.read_vectors(spark, path, {"count": 1}).count() == 1
    with pytest.raises(ValueError, match="stale"):
        tables.read_vectors(spark, path, {"count": 999})
    assert tables.merge_json(spark, {"x": 1}, f"{path}/manifest") == {"index": {"count": 1}, "x": 1}


def test_resumable(spark, raw, tmp_path):
    df, path = tables.read_raw_chunks(spark, raw), str(tmp_path / "done")
    tables.write_missing(df.filter("id < 'd_2'"), path, "id")
    tables.write_missing(df, path, "id")
    assert spark.read.parquet(path).count() == 5
    tables.write_text_cache(df.unionByName(df.withColumn("title", F.lit("new"))), str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 5
    tables.write_batches(df, str(tmp_path / "batches"), 2)
    assert spark.read.json(str(tmp_path / "batches")).count() == 5
    cache = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b"), ("q", 5, "c")], tables.CACHE)
    assert tuple(tables.resume(cache, 4).first()) == ("q", "b", 2)


def test_stream(spark, raw, tmp_path):
    encode = models.encoder(lambda: models.hashing_encoder(8))
    query = ingest.ingest(ingest.stream_chunks(spark, raw), str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: df.select("id", encode(F.col("contents")).alias("embedding")))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("id").distinct().count() == 5


def test_encoder_is_unit(spark):
    v = spark.createDataFrame([("a b a",)], "t string").select(models.encoder(lambda: models.hashing_encoder(16))(F.col("t")).alias("v")).first()["v"]
    assert sum(x * x for x in v) == pytest.approx(1, abs=1e-6)
