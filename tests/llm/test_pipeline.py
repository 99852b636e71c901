"""The pipeline against plain Python over the same rows, and the registered queries against their SQL."""

import glob
import os
import zlib

import duckdb
import numpy as np
import pytest
from conftest import *  # noqa: F403
from pyspark.sql import functions as F
from test_dedup import repeated_words, similar_classes
from test_text_models import edit_distance_within

import corpus_pipeline
from skeinwork.llm import decontam, queries
from skeinwork.llm._shared import stage, table
from skeinwork.llm.quality import judge

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, columns = table(spark, SF, "documents"), table(spark, SF, "documents").columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "packing"]
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    first = {(r["doc_id"], r["cleaned"]) for r in judge(table(spark, SF, "documents")).filter("kept").collect()}
    assert {(r["doc_id"], r["text"]) for r in kept["quality_rules"]} == first and all(r["n_chars"] == len(r["text"]) for r in kept["quality_rules"])
    rows = sorted((r["doc_id"], r["text"]) for r in kept["quality_rules"])
    # one document of each class stays, no more and no fewer
    assert sorted(r["doc_id"] for r in kept["near_dedup"]) == sorted(min(ids) for ids in similar_classes(rows))
    near = {(r["doc_id"], r["text"]) for r in kept["near_dedup"]}
    removed = {r[0]: r[2] for r in repeated_words(sorted(near))}
    for r in kept["substring_dedup"]:
        words = (r["text"] or "").split()
        source = dict(near)[r["doc_id"]]
        assert len(words) == len(source.split()) - removed[r["doc_id"]] and r["n_chars"] == len(r["text"])
    items = [decontam.normal(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    for r in kept["substring_dedup"][:40]:
        t = decontam.normal(r["text"])
        bad = any(i in t for i in items) or any(edit_distance_within(i, t) <= decontam.edits_allowed(len(i)) for i in items if i[:12] in t)
        assert not bad or r["doc_id"] not in {k["doc_id"] for k in kept["decontamination"]}
    assert not any(i in decontam.normal(r["text"]) for r in kept["decontamination"] for i in items)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    pieces = {}
    for p in kept["packing"]:
        pieces.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"]))
    for r in kept["decontamination"]:
        ids = np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for start, length, crc in sorted(pieces.pop(r["doc_id"])):
            assert start == at and zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)
    assert not pieces


def test_stages_on_odd_rows(spark, docs, no_docs):
    for start in (docs, no_docs):
        rows = start
        for name, function in corpus_pipeline.STAGES:
            rows = function(spark, rows, SF)
            assert name == "packing" or rows.columns == start.columns
        rows.collect()


def test_stages_keep_columns_of_any_name(spark, docs):
    clashes = ["__row", "__kept", "__matches", "__quality", "__lang", "q_kept", "matches", "key", "row", "fp", "node", "class_id", "digest", "a.b", "kept", "cleaned"]
    rows = spark.createDataFrame([(900, "Home | About | Contact\n" + " ".join(f"word{i} goes" for i in range(60)), "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = docs.select(*rows.columns).unionByName(rows).select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in clashes))
    for name, function in corpus_pipeline.STAGES[:-1]:
        rows = stage(function(spark, rows, SF), f"test-{name}")
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", *clashes]
        for r in rows.collect():
            assert all(r[c] == (None if r["doc_id"] is None else f"{c}:{r['doc_id']}") for c in clashes)
    last = rows.filter("doc_id = 900").first()
    assert last["text"].startswith("word0 goes") and last["n_chars"] == len(last["text"])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cursor = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, cursor.fetchall()))
