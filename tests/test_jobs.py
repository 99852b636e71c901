"""The jobs on growing and odd inputs, and their registered queries against SQL."""

import glob
import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from test_queries import plain

from jobs import index_corpus, queries, study_corpus
from jobs._run import settings
from skeinwork.operators import lexical

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=str)
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names) and want
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str) == want


def postings(spark, s):
    return sorted(map(str, index_corpus.output(spark, s).drop("bucket").collect()))


def test_index_takes_only_what_is_new(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(900001, None), (900002, "")]
    corpus = f"{tmp_path}/corpus"
    add = lambda some: spark.createDataFrame(some, "doc_id long, text string").coalesce(1).write.mode("append").parquet(corpus)
    s = index_corpus.Settings(corpus=corpus, output=f"{tmp_path}/index", checkpoint=f"{tmp_path}/checkpoint")
    add(rows[:100])
    first = index_corpus.index_corpus(spark, s)
    assert first == {"batches": 1, "read": 100, "added": 100}
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{s.output}/**/*.parquet", recursive=True)}
    add(rows[100:])
    add(rows[:30])  # a file delivered twice
    second = index_corpus.index_corpus(spark, s)
    assert second == {"batches": 1, "read": len(rows) - 100 + 30, "added": len(rows) - 100}
    assert all(os.stat(p).st_mtime_ns == t for p, t in before.items())  # what was there is not written again
    assert index_corpus.index_corpus(spark, s) == {"batches": 0, "read": 0, "added": 0}
    grown = postings(spark, s)
    whole = index_corpus.Settings(corpus=corpus, output=f"{tmp_path}/again", checkpoint=f"{tmp_path}/again-checkpoint")
    index_corpus.index_corpus(spark, whole)
    assert postings(spark, whole) == grown and lexical.open_index(spark, whole.output).n == len(rows)
    # the checkpoint is lost: everything is read, nothing is added
    lost = index_corpus.Settings(corpus=corpus, output=s.output, checkpoint=f"{tmp_path}/new-checkpoint")
    assert index_corpus.index_corpus(spark, lost)["read"] == len(rows) + 30
    assert postings(spark, s) == grown


def test_a_batch_that_failed_is_run_again(spark, tmp_path, monkeypatch):
    corpus = f"{tmp_path}/corpus"
    spark.createDataFrame([(1, "red dog"), (2, "blue dog")], "doc_id long, text string").write.parquet(corpus)
    s = index_corpus.Settings(corpus=corpus, output=f"{tmp_path}/index", checkpoint=f"{tmp_path}/checkpoint")
    whole = lexical.add_documents

    def breaks(*args, **kwargs):
        whole(*args, **kwargs)
        raise RuntimeError("lost driver")

    monkeypatch.setattr(index_corpus.lexical, "add_documents", breaks)
    with pytest.raises(Exception, match="lost driver"):
        index_corpus.index_corpus(spark, s)
    monkeypatch.setattr(index_corpus.lexical, "add_documents", whole)
    index_corpus.index_corpus(spark, s)
    assert len(postings(spark, s)) == 4 and lexical.open_index(spark, s.output).n == 2


def test_study_corpus_on_odd_rows(spark, tmp_path):
    rows = [(i, f"text number {i} [3].", "a" if i < 40 else "b" if i < 44 else None, "en") for i in range(50)]
    rows += [(3, "text number 3 again", "a", "en"), (None, "no id", "a", "en"), (60, None, "a", "en"), (61, " \n", "b", "en"), (62, "untitled", "b", None)]
    spark.createDataFrame(rows, "doc_id int, text string, source string, lang string").write.parquet(f"{tmp_path}/in")
    s = study_corpus.Settings(corpus=f"{tmp_path}/in", output=f"{tmp_path}/out", size=24)
    done = study_corpus.study_corpus(spark, s)
    assert done == {"read": 55, "drawn": 24, "sources": 3}
    got = study_corpus.output(spark, s).collect()
    counts = {r["source"]: (r["available"], r["drawn"]) for r in got}
    assert sum(d for _, d in counts.values()) == 24 == len({r["chunk_id"] for r in got})
    assert counts["b"] == (5, 5) and counts["none"] == (6, 6) and counts["a"] == (40, 13)
    assert all("[3]" not in r["text"] for r in got) and {r["section"] for r in got if r["chunk_id"] == "62"} == {None}
    again = study_corpus.study_corpus(spark, s)
    assert again == done and sorted(map(str, study_corpus.output(spark, s).collect())) == sorted(map(str, got))
    spark.read.parquet(f"{tmp_path}/in").limit(0).write.parquet(f"{tmp_path}/none")
    empty = study_corpus.Settings(corpus=f"{tmp_path}/none", output=f"{tmp_path}/out")
    assert study_corpus.study_corpus(spark, empty)["drawn"] == 0 and study_corpus.output(spark, empty).count() == 0


def test_settings(spark, tmp_path):
    s = settings(spark, str(ROOT / "jobs/index_corpus.json"), index_corpus.Settings, {"corpus": "x", "output": None})
    assert s.corpus == "x" and s.output == "index/lexical" and s.buckets == 64
    assert settings(spark, str(ROOT / "jobs/study_corpus.json"), study_corpus.Settings, {}).size == 2000
    (tmp_path / "bad.json").write_text(json.dumps({"corpse": "x"}))
    with pytest.raises(ValueError, match="corpse"):
        settings(spark, str(tmp_path / "bad.json"), index_corpus.Settings, {})


def test_command_line(tmp_path):
    command = [sys.executable, "-m", "jobs.study_corpus", "jobs/study_corpus.json", "--corpus", f"{DATA}/documents.parquet", "--output", f"{tmp_path}/out"]
    done = subprocess.run(command, cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "documents read" in done.stderr and glob.glob(f"{tmp_path}/out/chunks/source=*/*.json")
