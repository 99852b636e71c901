import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skeinwork.functions import models, vectors
from skeinwork.functions import text as T
from skeinwork.operators import citations, dense, evaluate, fusion, lexical, quantized, sampling
from skeinwork.plans import answer, registry
from skeinwork.sources import tables

ROWS = [("a1", "A", 1.0, 0.0), ("a2", "A", 0.98, 0.2), ("a3", "A", 0.95, 0.31), ("a4", "A", 0.89, 0.45), ("b1", "B", 0.45, 0.89), ("c1", "C", 0.0, 1.0)]


@pytest.fixture
def corpus(spark):
    df = spark.createDataFrame([(i, d, [x, y, 0.0]) for i, d, x, y in ROWS], "id string, document string, embedding array<float>")
    return df.withColumn("embedding", vectors.normalize(F.col("embedding")))


@pytest.fixture
def query(spark):
    return spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, embedding array<float>")


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_floor_cap_truncate(corpus, query):
    assert ids(dense.search(corpus, query, 8, 0.9, 3)) == ["a1", "a2", "a3"]
    assert ids(dense.search(corpus, query, 3, -1.0, 2)) == ["a1", "a2", "b1"]
    assert ids(dense.search(corpus, query, 8, 1.5, 3)) == []
    assert dense.max_scores(corpus.limit(0), query).first()["score"] == 0.0


def test_metrics_and_centering(spark, corpus, query):
    assert ids(dense.search(corpus, query, 2, metric="l2")) == ["a1", "a2"] == ids(dense.search(corpus, query, 2, metric="cosine"))
    center = vectors.mean_vector(spark.createDataFrame([([1.0, 3.0],), ([3.0, 5.0],)], "embedding array<float>"))
    assert center.first()["center"] == [2.0, 4.0]
    same = spark.createDataFrame([([2.0, 4.0],)], "embedding array<float>")
    assert dense.centered(same, center).first()["embedding"] == [0.0, 0.0]
    with pytest.raises(ValueError):
        dense.candidates(corpus, query, 1, "hamming")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quantised_recall(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("document"), "embedding")
    q = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    n = e.count()
    book = quantized.fit(e)
    coded = quantized.index(e, book)
    assert coded.count() == n and {len(r["codes"]) for r in coded.select("codes").collect()} == {16}
    exact = {(r["query_id"], r["id"]) for r in dense.search(e, q, 8).collect()}
    found = [tuple(r) for r in quantized.search(e, coded, book, q, 8, probes=48, read=40).select("query_id", "id").collect()]
    assert len(found) == len(set(found)) == len(exact) and len(exact & set(found)) / len(exact) >= 0.9
    assert 40 <= 0.1 * n  # vectors read for a query


def test_quantised_on_odd_rows(spark):
    rows = [(1, "a", [1.0, 0.0, 0.0]), (2, "a", None), (3, "b", [0.0, 0.0, 0.0]), (4, "b", [1.0, 0.0, 0.0])]
    c = spark.createDataFrame(rows, "id long, document string, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0, 0.0]), (8, None)], "query_id long, embedding array<float>")
    book = quantized.fit(c)
    got = quantized.search(c, quantized.index(c, book), book, q, 2).orderBy("rank").collect()
    assert [(r["query_id"], r["id"], r["score"]) for r in got] == [(9, 1, 1.0), (9, 4, 1.0)]
    assert quantized.fit(c.limit(0)) is None and quantized.search(c, c, None, q).count() == 0


@pytest.mark.parametrize("metric", dense.METRICS)
def test_large_question_sets_meet_the_corpus_in_blocks(spark, metric, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = [[round(float(v), 3) for v in row] for row in rng.normal(size=(230, 5))]
    rows = [(i, f"d{i % 7}", v) for i, v in enumerate(vecs)] + [(900, "d0", None), (901, "d1", vecs[0])]
    c = spark.createDataFrame(rows, "id long, document string, embedding array<float>")
    q = c.filter("id % 3 = 0").select(F.col("id").alias("query_id"), "document", "embedding")
    small = dense.search(c, q, 6, metric=metric, per_document=2).collect()
    sums = "same boolean, n long, total double, squares double, top double"
    counted = lambda: sorted((r["same"], r["n"]) for r in dense.tally(c, q, dense.moments, sums).groupBy("same").agg(F.sum("n").alias("n")).collect())
    few = counted()
    monkeypatch.setattr(dense, "BLOCK_NUMBERS", 60)
    monkeypatch.setattr(dense, "CORPUS_NUMBERS", 200)
    plans = {n: dense.candidates(c, q.limit(n), 6, metric)._jdf.queryExecution().analyzed().toString().count("\n") for n in (20, 70)}
    assert plans[20] == plans[70] or max(plans.values()) - min(plans.values()) < 3
    large = dense.search(c, q, 6, metric=metric, per_document=2).collect()
    assert sorted(map(str, large)) == sorted(map(str, small)) and {r["query_id"] for r in large} == {i for i in range(0, 230, 3)}
    assert counted() == few and sum(n for _, n in few) == 77 * 231


def test_bm25_against_formula(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("red blue green dog cat fish".split()) for _ in range(rng.randint(1, 20)))) for i in range(28)] + [(28, ""), (29, None)]
    df = spark.createDataFrame(docs, "id long, text string")
    lexical.write_index(df, f"{tmp_path}/i", identity="v1")
    index = lexical.open_index(spark, f"{tmp_path}/i", "v1")
    with pytest.raises(ValueError, match="stale index"):
        lexical.open_index(spark, f"{tmp_path}/i", "v2")
    asked = spark.createDataFrame([(1, "red dog dog")], "query_id int, query string")
    got = lexical.bm25(index, asked, 5).orderBy("rank").collect()
    texts = [(i, t or "") for i, t in docs]
    mean = sum(len(t.split()) for _, t in texts) / 30
    counts = sorted((w, i, t.split().count(w), len(t.split())) for i, t in texts for w in set(t.split()))
    assert sorted(map(tuple, index.postings.select("term", "id", "tf", "length").collect())) == counts and index.n == 30 and index.mean == pytest.approx(mean)

    def score(t):
        w, s = t.split(), 0
        for term in {"red", "dog"}:
            n, tf = sum(term in x.split() for _, x in texts), w.count(term)
            s += math.log(1 + (30 - n + 0.5) / (n + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len(w) / mean)) if tf else 0
        return s

    want = sorted(((-round(score(t), 9), i) for i, t in texts if score(t)))[:5]
    assert [r["id"] for r in got] == [i for _, i in want]
    lexical.write_index(df.limit(0), f"{tmp_path}/none")
    assert lexical.bm25(lexical.open_index(spark, f"{tmp_path}/none"), asked).count() == 0


def test_analyzer(spark):
    analyze = T.analyzer(T.STOP_WORDS, T.s_stem)
    got = spark.createDataFrame([("The ponies and the horses, classes of cats: bus, is",)], "t string").select(analyze(F.col("t"))).first()[0]
    assert got == ["pony", "horse", "classe", "cat", "bus"]


def test_fusion(spark):
    hits = spark.createDataFrame([("q", 0, "a", 0), ("q", 0, "b", 1), ("q", 1, "b", 0), ("q", 1, "c", 1)], "query_id string, retriever int, id string, rank int")
    got = fusion.reciprocal_rank_fusion(hits, 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "a", "c"] and got[0]["score"] == pytest.approx(1 / 102 + 1 / 101)
    tie = spark.createDataFrame([("q", 1, "x", 0), ("q", 0, "y", 0)], "query_id string, retriever int, id string, rank int")
    assert [r["id"] for r in fusion.reciprocal_rank_fusion(tie, 2).orderBy("rank").collect()] == ["y", "x"]
    lists = {n: spark.createDataFrame([("q", i, s) for i, s in rows], "query_id string, id string, score double") for n, rows in {"bm25": [("a", 2.0), ("b", 1.0)], "specter": [("b", 0.1), ("a", 0.9)]}.items()}
    assert ids(answer.retrieve({"specter": lists["specter"]}, frozenset({"specter"}), 2)) == ["b", "a"]
    assert ids(answer.retrieve(lists, frozenset({"specter"}), 2)) == ["a", "b"]
    with pytest.raises(Exception, match="no chunk"):
        fusion.lookup(lists["bm25"], spark.createDataFrame([("a", "t")], "id string, text string")).collect()


def test_metrics(spark):
    gold = spark.createDataFrame([(1, "c3"), (2, "c1"), (3, "zz")], "query_id int, id string")
    hits = spark.createDataFrame([(q, f"c{k + 1}", k) for q in (1, 2, 3) for k in range(3)], "query_id int, id string, rank int")
    m = evaluate.recall_and_mrr(evaluate.first_ranks(gold, hits)).first()
    assert (m["recall_at_1"], m["recall_at_3"], m["mrr"]) == pytest.approx((1 / 3, 2 / 3, (1 / 3 + 1) / 3))
    c = evaluate.context_metrics(spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, True), (2, None, None)], "query_id int, rank int, relevant boolean"))
    assert {r["query_id"]: (round(r["precision"], 6), r["recall"]) for r in c.collect()} == {1: (round((1 / 2 + 2 / 3) / 2, 6), 1.0), 2: (0.0, 0.0)}
    s = spark.createDataFrame([(0.8, True)] * 3 + [(0.2, False)] * 3, "score double, positive boolean")
    assert evaluate.auc(s).first()["auc"] == 1.0 and tuple(evaluate.best_threshold(s).first()) == (0.8, 1.0)
    assert math.isnan(evaluate.auc(s.filter("positive")).first()["auc"])


def test_gold_set(spark):
    rows = [(f"c{i:02d}", "t", "statpearls", f"Doc{i // 2}", "Etiology") for i in range(24)] + [("x", "t", "textbook", "T", "Etiology"), ("y", "t", "statpearls", "Y", "Etiology -- Sub")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, source_type string, document string, section string")
    got = evaluate.gold_set(chunks).collect()
    assert len(got) == 12 and got[0]["question"] == "What causes doc0?" and got[0]["chunk_id"] == "c00"
    with pytest.raises(ValueError):
        evaluate.gold_set(chunks, limit=5)


def test_citations(spark):
    df = spark.createDataFrame([("The drug clearly lowers blood pressure [S1]. It is also known elsewhere as X [S9]. [S01]", ["a", "b"])], "answer string, hits array<string>")
    r = citations.validate(df).first()
    assert r["dropped"] == ["[S9]", "[S01]"] and "[S9]" not in r["cleaned"] and list(r["citations"]) == ["[S1]"] and len(r["unsupported"]) == 1
    s = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, -1.0])], "answer_id int, sentence_no int, vector array<double>")
    p = spark.createDataFrame([(1, 0, [0.9, 0.1]), (1, 1, [0.1, 0.9])], "answer_id int, rank int, vector array<double>")
    got = {r["sentence_no"]: r["marker"] for r in citations.attribute(s, p).collect()}
    assert got[0] == "[S1]"


def test_sampling(spark):
    rows = spark.range(300).select(F.col("id").alias("k"), F.concat(F.lit("f"), F.col("id") % 5).alias("file"))
    files = rows.groupBy(F.col("file").alias("path")).agg((F.count("*") * 10).alias("size"))
    assert sampling.size_slots(files, 50).agg(F.sum("slots")).first()[0] == 50
    got = [r["k"] for r in sampling.sample_source(rows, files, 40, "file", "k").collect()]
    assert len(got) == len(set(got)) == 40 and got == sorted(got)
    assert got == [r["k"] for r in sampling.sample_source(rows.repartition(7), files, 40, "file", "k").collect()]
    assert sampling.sample_source(rows, files, 1000, "file", "k").count() == 300
    f = sampling.fingerprint(rows, "k", {"query": "x"}, 1)
    sampling.check_fresh(f, dict(f))
    with pytest.raises(ValueError, match="stale"):
        sampling.check_fresh(f | {"count": 999}, f)


def _spy(path):
    def make():
        def reply(chat):
            with open(path, "a") as f:
                f.write("x\n")
            return "The finding is supported by the passage [S1]."

        return reply

    return make


def test_gate_keeps_the_model_out(spark, corpus, query, tmp_path):
    chunks = corpus.select("id", F.lit("textbook").alias("source_type"), "document", F.lit(None).cast("string").alias("section"), F.lit("some text").alias("text"))
    asked = [("ok", "What is known of it?", [1.0, 0.0, 0.0]), ("far", "What else is there?", [0.0, 0.0, 1.0]), ("own", "Should I take it?", [1.0, 0.0, 0.0])]
    questions = spark.createDataFrame(asked, "question_id string, question string, embedding array<float>")
    log = tmp_path / "calls"
    got = {r["question_id"]: r for r in answer.gated_answers(questions, corpus, chunks, models.generator(_spy(str(log)))).collect()}
    assert len(log.read_text().split()) == 1
    assert got["own"]["refused"] and got["far"]["abstained"] and got["ok"]["grounded"] and list(got["ok"]["citations"]) == ["[S1]"]
    assert all("reference only" in r["answer"] for r in got.values())


def _rounds():
    def reply(chat):
        last = chat[-1]["content"]
        if last.startswith("List the queries"):
            return '{"output": ["1. first thing", ""]}'
        if "Give the answer alone" in last:
            return '{"answer": "B"}'
        return "## Answer\nIt is B" if "Answer now" in last else "## Queries\n1. first thing"

    return reply


def test_iterate(spark, tmp_path):
    count = iter(range(1000))

    def save(df, name):
        path = str(tmp_path / f"{name}-{next(count)}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    questions = spark.createDataFrame([(1, "What?", {"A": "x", "B": "y"})], "question_id long, question string, options map<string,string>")
    got = answer.iterate(questions, models.generator(_rounds), lambda q: q.select("query_id", F.lit("found").alias("answer")), save, n_rounds=2).first()
    assert got["answer"] == '{"answer": "B"}' and got["rounds"] == 3 and got["context"].count("Query: first thing\nAnswer: found") == 2


def test_context_answers(spark):
    questions = spark.createDataFrame([(1, "What?", {"A": "x"})], "question_id long, question string, options map<string,string>")
    snippets = spark.createDataFrame([(1, 0, "t", "c  d")], "question_id long, rank int, title string, content string")
    echo = models.generator(lambda: lambda chat: chat[-1]["content"])
    assert "Document [0] (Title: t) c d" in answer.context_answers(questions, snippets, echo).first()["answer"]
    assert "A. x" in answer.context_answers(questions, None, echo).first()["answer"]


def _plain_bm25(texts, asked, k, k1=0.9, b=0.4):
    words = {i: (t or "").split() for i, t in texts}
    mean = sum(map(len, words.values())) / len(words)
    df = {}
    for w in words.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for q, text in asked:
        scores = {}
        for i, w in words.items():
            for t in set(text.split()):
                if tf := w.count(t):
                    idf = math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5))
                    scores[i] = scores.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
        out += [(q, i, r) for r, (_, i) in enumerate(sorted((-round(s, 9), i) for i, s in scores.items())[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def zipf():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for i in range(900)]
    asked = [(q, " ".join(rng.choices(vocabulary, weights, k=6) + rng.sample(vocabulary[100:], 4))) for q in range(12)] + [(90, "nothing here"), (91, "w0"), (92, None)]
    return texts, asked


@pytest.mark.parametrize("at_once", [lexical.AT_ONCE, 0])
def test_bm25_in_segments_and_bounded(spark, zipf, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(lexical, "AT_ONCE", at_once)
    texts, asked = zipf
    queries = spark.createDataFrame(asked, "query_id int, query string")
    want = {k: _plain_bm25(texts, [(q, t or "") for q, t in asked], k) for k in (1, 10)}
    path = f"{tmp_path}/grown"
    rows = lambda some: spark.createDataFrame(some, "id long, text string")
    assert lexical.add_documents(rows(texts[:200]), path) == 200
    first = lexical.segments(spark, path)
    assert lexical.add_documents(rows(texts[150:]), path) == 700  # 50 were there
    assert lexical.segments(spark, path)[:1] == first and lexical.add_documents(rows(texts), path) == 0
    with pytest.raises(FileExistsError):
        lexical.write_index(rows(texts), path)
    lexical.compact(spark, path, f"{tmp_path}/one")
    for folder in (path, f"{tmp_path}/one"):
        index = lexical.open_index(spark, folder)
        assert index.n == 900 and index.postings.count() == sum(len(set(t.split())) for _, t in texts)
        for k in (1, 10):
            got = lexical.bm25(index, queries, k).select("query_id", "id", F.col("rank").cast("int")).collect()
            assert sorted(map(tuple, got)) == want[k]
    asked_terms = queries.select(F.explode(T.tokens(F.col("query"))).alias("term"))
    few = lexical.index_of_terms(rows(texts), asked_terms)
    assert sorted(map(tuple, lexical.bm25(few, queries, 10).select("query_id", "id", "rank").collect())) == want[10] and few.n == 900
    other = lexical.bm25(lexical.open_index(spark, path), queries, 10, k1=1.2, b=0.75).select("query_id", "id", "rank").collect()
    assert sorted(map(tuple, other)) == _plain_bm25(texts, [(q, t or "") for q, t in asked], 10, 1.2, 0.75)


def test_a_broken_build_leaves_the_index(spark, zipf, tmp_path):
    texts, _ = zipf
    path = f"{tmp_path}/i"
    rows = spark.createDataFrame(texts[:50], "id long, text string")
    lexical.write_index(rows, path)
    failing = spark.createDataFrame(texts[50:90], "id long, text string").withColumn("text", F.when(F.col("id") == 70, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        lexical.add_documents(failing, path)
    # postings of a segment without totals are not read either
    spark.createDataFrame([("x", 1, 1, 1)], "term string, id long, tf long, length long").write.parquet(f"{path}/postings/segment=1/bucket=3")
    index = lexical.open_index(spark, path)
    assert index.n == 50 and index.postings.filter("term = 'x'").count() == 0
    assert lexical.add_documents(spark.createDataFrame(texts[50:90], "id long, text string"), path) == 40
    assert lexical.open_index(spark, path).postings.filter("term = 'x'").count() == 0


def test_same_ids_count_once(spark, tmp_path):
    rows = [(1, "a b"), (1, "a b"), (1, "a"), (2, "c"), (None, "d"), (None, "d e")]
    lexical.write_index(spark.createDataFrame(rows, "id long, text string"), f"{tmp_path}/i")
    index = lexical.open_index(spark, f"{tmp_path}/i")
    assert sorted(map(tuple, index.postings.select("id", "term").na.fill(-1).collect())) == [(-1, "d"), (1, "a"), (2, "c")] and index.n == 3


def test_a_search_opens_the_folders_of_its_terms(spark, zipf, tmp_path):
    texts, _ = zipf
    lexical.write_index(spark.createDataFrame(texts, "id long, text string"), f"{tmp_path}/i", buckets=16)
    index = lexical.open_index(spark, f"{tmp_path}/i")
    asked = spark.createDataFrame([("w3",), ("w50",), ("w399",)], "term string")
    part = lexical.narrowed(index, asked)
    buckets = {r[0] for r in asked.select(lexical.bucket(F.col("term"), 16)).collect()}
    read = {r[0] for r in part.postings.select(F.regexp_extract("_metadata.file_path", r"bucket=(\d+)", 1).cast("int")).distinct().collect()}
    assert read <= buckets and len(read) < 16
    plan = part.postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term" in plan or "EqualTo(term" in plan


def test_gate_attributes_uncited_claims(spark, corpus):
    ids = [r["id"] for r in corpus.orderBy("id").collect()]
    said = {i: f"passage about topic number {n}" for n, i in enumerate(ids)}
    chunks = spark.createDataFrame([(i, "textbook", "d", None, t) for i, t in said.items()], f"id {corpus.schema['id'].dataType.simpleString()}, source_type string, document string, section string, text string")
    questions = spark.createDataFrame([("ok", "What is known of it?", [1.0, 0.0, 0.0]), ("own", "Should I take it?", [1.0, 0.0, 0.0])], "question_id string, question string, embedding array<float>")

    def encode(texts):  # topics by number; anything else points away from all
        return np.array([[float(t.count(str(n))) for n in range(10)] + [0.0 if any(c.isdigit() for c in t) else 1.0] for t in texts])

    def replies(text):
        return models.generator(lambda: lambda chat: text)

    def ask(text, **given):
        return {r["question_id"]: r for r in answer.gated_answers(questions, corpus, chunks, replies(text), floor=-1.0, per_document=9, **given).collect()}

    both = "One claim about topic number 1. Something else is claimed here too. It is said of topic 0 indeed [S1]."
    plain = ask(both)["ok"]
    assert plain["attributions"] == [] and len(plain["unsupported"]) == 2 and not plain["grounded"]
    got = ask(both, encode=models.encoder(lambda: encode))
    r = got["ok"]
    place = {h["id"]: h["rank"] for h in r["hits"]}
    assert len(place) > 1
    assert [(a["sentence"], a["id"], a["marker"]) for a in r["attributions"]] == [("One claim about topic number 1.", ids[1], f"[S{place[ids[1]] + 1}]")]
    assert r["unsupported"] == ["Something else is claimed here too."] and not r["grounded"] and r["attributions"][0]["score"] >= 0.2
    assert got["own"]["refused"] and got["own"]["attributions"] == []
    whole = ask("One claim about topic number 1.", encode=models.encoder(lambda: encode))["ok"]
    assert whole["grounded"] and whole["unsupported"] == [] and whole["citations"] == {}
    fixed = spark.createDataFrame([([0.0] * 11,)], "center array<double>")
    assert ask("One claim about topic number 1.", encode=models.encoder(lambda: encode), center=fixed)["ok"]["attributions"][0]["score"] == pytest.approx(1.0, abs=1e-6)


def _talk(fail=()):
    def make():
        def reply(chat):
            last = chat[-1]["content"]
            for mark in fail:
                if mark in last:
                    raise RuntimeError(f"no service for {mark}")
            if last.startswith("List the queries"):
                return "nothing to read" if "unreadable" in last else '{"output": ["1. first thing", "bad thing", ""]}'
            if "Give the answer alone" in last:
                return '{"answer": "B"}'
            if "Answer now" in last:
                return "## Answer\nIt is B"
            return "## Queries\n1. unreadable" if "Unreadable?" in last else "## Queries\n1. first thing"

        return reply

    return models.attempts(make)


QUESTIONS = [("a", "What?", {"A": "x", "B": "y"}), ("b", "Cursed?", {}), ("c", "Unreadable?", {})]


def _searched(q):
    bad = F.col("question") == "bad thing"
    return q.select("query_id", F.when(~bad, F.lit("found")).alias("answer"), F.when(bad, F.lit("ValueError: no hits")).alias("error"))


def test_failing_calls_cost_their_own_question_only(spark, tmp_path):
    questions = spark.createDataFrame(QUESTIONS, "question_id string, question string, options map<string,string>")
    ask = lambda name, *fail: (r := answer.Rounds(spark, f"{tmp_path}/{name}"), {x["question_id"]: x for x in answer.iterate(questions, _talk(fail), _searched, n_rounds=2, run=r).collect()})
    run, got = ask("one", "Cursed?")
    clean, whole = ask("two")
    assert got["a"] == whole["a"] and got["c"] == whole["c"] and got["a"]["answer"] == '{"answer": "B"}' and got["a"]["rounds"] == 3
    assert got["a"]["context"].count("Query: first thing\nAnswer: found") == 2 and "bad thing" not in got["a"]["context"]
    assert got["b"]["answer"] == "" and got["b"]["rounds"] == 5 and whole["b"]["answer"] == '{"answer": "B"}'
    errors = sorted((r["question_id"], r["round"], r["place"], r["error"]) for r in run.errors().collect())
    assert [e for e in errors if e[0] == "b"] == [("b", i, "reply", "RuntimeError: no service for Cursed?") for i in range(5)]
    assert {e[1:] for e in errors if e[0] == "c"} == {(i, "queries", "the reply holds no list of queries") for i in range(2)}
    assert [e[1:] for e in errors if e[0] == "a"] == [(i, "answer", "ValueError: no hits") for i in range(2)]
    said = [(r["role"], r["content"][:10]) for r in run.messages().filter("question_id = 'a'").orderBy("step").collect()]
    assert [role for role, _ in said] == ["system", *["user", "assistant"] * 4] and said[-1][1] == '{"answer":'
    cache = run.cache().filter("question_id = 'a'").orderBy("round").collect()
    assert [r["round"] for r in cache] == [0, 1] and cache[1]["context"] == got["a"]["context"]
    # what the cache holds takes a new run to its last rounds
    left = tables.resume(run.cache(), 2)
    again = {r["question_id"]: r for r in answer.iterate(questions, _talk(), _searched, answer.Rounds(spark, f"{tmp_path}/three").save, n_rounds=2, cached=left).collect()}
    assert again["a"]["rounds"] == 1 and again["a"]["context"] == got["a"]["context"]


def test_a_stopped_run_goes_on_behind_its_last_round(spark, tmp_path):
    questions = spark.createDataFrame(QUESTIONS[:1], "question_id string, question string, options map<string,string>")
    run, rounds = answer.Rounds(spark, f"{tmp_path}/run"), []

    def stops(q):
        rounds.append(1)
        if len(rounds) == 2:
            raise KeyboardInterrupt("killed in the second round")
        return _searched(q)

    with pytest.raises(KeyboardInterrupt):
        answer.iterate(questions, _talk(), stops, n_rounds=2, run=run)
    number, state = run.last()
    assert number == 1 and state.first()["context"].count("first thing") == 1
    # round 0 is not asked again: a model that would fail there is not called for it
    got = answer.iterate(questions, _talk(), stops, n_rounds=2, run=run).first()
    assert got["answer"] == '{"answer": "B"}' and got["rounds"] == 3 and got["context"].count("first thing") == 2 and len(rounds) == 4
    assert run.messages().filter("role = 'system'").count() == 1
    done = answer.iterate(questions, _talk(["What?"]), stops, n_rounds=2, run=run).first()
    assert done == got and len(rounds) == 4


def test_from_question_texts_to_results(spark, tmp_path):
    docs = [(1, "red fox jumps"), (2, "blue whale swims"), (3, "red whale and fox"), (4, "green tree")]
    df = spark.createDataFrame(docs, "id long, text string")
    for name, part in (("a", df.filter("id < 3")), ("b", df.filter("id >= 3"))):
        lexical.write_index(part, f"{tmp_path}/{name}")
    words = answer.lexical_retriever([lexical.open_index(spark, f"{tmp_path}/{n}") for n in "ab"])
    encode = models.encoder(lambda: models.hashing_encoder(64))
    corpus = df.select("id", F.lit("d").alias("document"), encode(F.col("text")).alias("embedding"))
    vectors_of = answer.dense_retriever([corpus.filter("id < 3"), corpus.filter("id >= 3")], encode)
    asked = spark.createDataFrame([(7, "red fox"), (8, " "), (9, None)], "query_id long, query string")
    one = answer.find(asked, {"words": words}, k=2).orderBy("rank").collect()
    assert {r["query_id"] for r in one} == {7} and {r["id"] for r in one} == {1, 3} and [r["rank"] for r in one] == [0, 1]
    both = answer.find(asked, {"words": words, "vectors": vectors_of}, df, k=3).orderBy("rank").collect()
    assert {r["id"] for r in both[:2]} == {1, 3} and both[0]["text"] in dict(docs).values() and len(both) == 3
    lists = {"words": words(asked.filter("query_id = 7"), 100), "vectors": vectors_of(asked.filter("query_id = 7"), 100)}
    assert [r["id"] for r in answer.retrieve(lists, k=3).orderBy("rank").collect()] == [r["id"] for r in both]


def test_evidence_precedence(spark):
    questions = spark.createDataFrame([(i, f"q{i}", {"A": "x"}) for i in range(4)], "question_id int, question string, options map<string,string>")
    snippets = spark.createDataFrame([(0, 0, "t", "own snippet")], "question_id int, rank int, title string, content string")
    ids = spark.createDataFrame([(0, 0, 5), (1, 0, 5)], "question_id int, rank int, id int")
    texts = spark.createDataFrame([(5, "t", "text by id")], "id int, title string, content string")
    seen = []

    def search(open_):
        seen.extend(r["question_id"] for r in open_.collect())
        return open_.filter("question_id = 2").select("question_id", F.lit(0).alias("rank"), F.lit("t").alias("title"), F.lit("found text").alias("content"))

    echo = models.batched(lambda: lambda chats: [c[-1]["content"] for c in chats], batch=2)
    got = {r["question_id"]: r["answer"] for r in answer.context_answers(questions, snippets, echo, ids=ids, texts=texts, search=search).collect()}
    assert sorted(set(seen)) == [2, 3]
    said = ("own snippet", "text by id", "found text")
    for i, words in enumerate(said):
        assert words in got[i] and not any(w in got[i] for w in said if w != words)
    assert not any(w in got[3] for w in said) and "q3" in got[3]
    assert "Documents" not in answer.context_answers(questions, None, echo).first()["answer"]
    with pytest.raises(ValueError):
        answer.context_answers(questions, None, echo, ids=ids)


def _parts(vecs, batch):
    """A corpus as a task gets it."""
    for at in range(0, len(vecs), batch):
        yield pd.DataFrame({"id": range(at, at + len(vecs[at : at + batch])), "document": np.arange(at, at + len(vecs[at : at + batch])) % 3, "embedding": list(vecs[at : at + batch])})


@pytest.mark.parametrize("make", ["ip", "cosine", "l2", "within", "tally", "codes"])
def test_memory_of_a_task_does_not_grow_with_the_queries(spark, make, monkeypatch):
    rng = np.random.default_rng(5)
    vecs, got = rng.normal(size=(6_000, 8)), {}
    works = []
    monkeypatch.setattr(dense, "pairwise", lambda c, q, work, *a: works.append(work) or c)
    c = spark.createDataFrame([(1, 0, [1.0] * 8)], "id long, document long, embedding array<double>")
    q = c.withColumnRenamed("id", "query_id")
    book = quantized.fit(c.union(c)) if make == "codes" else None
    if make == "codes":
        quantized.near(quantized.index(c, book), book, q, 5, 1)
    elif make == "tally":
        dense.tally(c, q, dense.moments, "same boolean, n long, total double, squares double, top double")
    else:
        dense.candidates(c, q, 5, "ip" if make == "within" else make, make == "within")
    monkeypatch.setattr(dense, "TILE", 100_000)
    monkeypatch.setattr(dense, "GIVEN", 2_000)
    for n in (400, 3_200):
        asked = pd.DataFrame({"query_id": range(n), "document": np.arange(n) % 3, "embedding": list(vecs[:n])})
        parts = ((p.assign(cell=0, embedding=[bytes(len(book.words))] * len(p)) if make == "codes" else p) for p in _parts(vecs, 3_000))
        tracemalloc.start()
        rows = sum(len(x) for x in works[0](asked, parts))
        got[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows
    assert got[3_200] < 8_000_000 and got[3_200] < 2 * got[400]


def test_best_puts_few_numbers_in_order(monkeypatch):
    rng, sizes, partition = np.random.default_rng(6), [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *rest, **named: sizes.append(a.shape[1]) or partition(a, *rest, **named))
    wide = rng.normal(size=(5, 20_000))
    for about in (wide, np.sort(wide, axis=1), rng.integers(0, 3, wide.shape).astype(float), np.where(rng.random(wide.shape) < 0.9999, -np.inf, wide), wide[:, :9], wide[:, :41]):
        rows, columns = dense.best(about, 8, np.full(5, 1e-9))
        keep = dense.first(rows, columns, about[rows, columns], 8)
        want = [list(np.lexsort((np.arange(about.shape[1]), -a))[:8]) for a in about]
        assert [list(columns[keep][rows[keep] == n]) for n in range(5)] == want
    assert max(sizes) < 100


def test_bins_copy_no_matrix():
    s = np.round(np.random.default_rng(7).normal(0.3, 0.3, size=(200, 5_000)), 3)
    s[0, :70] = np.arange(-3, 67) * 0.0125
    s[1, :3] = -9.0, 9.0, -1e-7
    x = s.round(6).reshape(-1)
    want = np.bincount(np.where(x < 0, 0, np.where(x >= 0.8, 33, np.floor(x / 0.025) + 1)).astype(int))
    tracemalloc.start()
    got = dense.bins(s, s > 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(got["bin"]) == list(np.flatnonzero(want)) and list(got["n"]) == list(want[want > 0])
    assert peak < s.nbytes / 2


def test_scores_that_are_no_numbers_are_tallied(spark):
    c = spark.createDataFrame([(1, 0, [1.0, float("nan")]), (2, 0, [1.0, 2.0])], "id long, document long, embedding array<double>")
    q = c.filter("id = 2").withColumnRenamed("id", "query_id")
    got = dense.tally(c.coalesce(1), q, dense.moments, "same boolean, n long, total double, squares double, top double").collect()
    assert sum(r["n"] for r in got) == 2 and all(math.isnan(r[k]) for r in got for k in ("total", "squares", "top"))


def test_codes_are_scored_by_what_they_stand_for(spark):
    rng = np.random.default_rng(4)
    some = rng.normal(size=(40, 8)).round(3)
    c = spark.createDataFrame([(i, 0, [float(x) for x in some[i % 40]]) for i in range(400)], "id long, document long, embedding array<double>")
    q = c.filter("id < 5").select(F.col("id").alias("query_id"), "embedding")
    book = quantized.fit(c, cells=4, parts=4, words=8)
    cells, codes = book.encode(some)
    stands = book.decode(cells, codes)
    assert stands.shape == some.shape and np.allclose(stands, [np.concatenate([w[k] for w, k in zip(book.words, row)]) + book.centers[n] for n, row in zip(cells, codes)])
    got = {(r["query_id"], r["id"]): r["about"] for r in quantized.near(quantized.index(c, book).coalesce(1), book, q, 25, 4).collect()}
    assert len(got) == 125 and all(math.isclose(a, some[n] @ stands[i % 40], abs_tol=1e-9) for (n, i), a in got.items())
    for n in range(5):  # copies tie exactly: of those that are not all given, the least ids are
        at = [i for (m, i) in got if m == n]
        assert all(sorted(i for i in at if i % 40 == k) == list(range(k, k + 40 * sum(i % 40 == k for i in at), 40)) for k in {i % 40 for i in at})


def test_equal_vectors_tie_and_no_numbers_rank_first(spark):
    rng = np.random.default_rng(8)
    some = [[float(x) for x in v] for v in rng.normal(size=(7, 64))]
    rows = [(i, 0, some[i % 7]) for i in range(1_001)]
    c = spark.createDataFrame(rows, "id long, document long, embedding array<double>").repartition(3)
    q = c.filter("id < 7").select(F.col("id").alias("query_id"), "embedding")
    for metric in dense.METRICS:
        got = dense.search(c, q, 5, metric=metric).orderBy("query_id", "rank").collect()
        firsts = {r["query_id"]: r["id"] for r in got if r["rank"] == 0}
        assert all([r["id"] for r in got if r["query_id"] == n] == [firsts[n] + 7 * k for k in range(5)] for n in range(7))
    odd = c.unionByName(spark.createDataFrame([(5_000, 0, [float("nan")] * 64)], c.schema))
    assert [r["id"] for r in dense.search(odd, q.limit(1), 2).orderBy("rank").collect()][0] == 5_000


def test_snippets_shared_by_many_answers_are_not_copied(spark):
    rng = np.random.default_rng(9)
    rows = [(i, i % 3 if i != 4 else None, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(70, 9, [1.0, 0.0, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "rank long, document int, vector array<double>")
    center = vectors.mean_vector(e, "vector")
    asked = e.filter("rank % 5 = 0").withColumnRenamed("rank", "answer_id")
    each = asked.select("answer_id", "document").join(e, "document").filter("rank <> answer_id").drop("document")
    want = citations.attribute(asked.select("answer_id", F.lit(0).alias("sentence_no"), "vector"), each, 0.2, center).drop("sentence_no")
    v = dense.centered(e, center, "vector")
    found = citations.attribute_within(v.filter("rank % 5 = 0").withColumnRenamed("rank", "answer_id"), v, 0.2)
    plain = lambda df: sorted((r["answer_id"], r["rank"], round(r["score"], 9), r["marker"]) for r in df.collect())
    assert plain(found) == plain(want) and len(plain(found)) == 12
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_bm25_grow_with_the_matches(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("red blue green dog cat fish".split()) for _ in range(6))) for i in range(400)]
    lexical.write_index(spark.createDataFrame(docs, "id long, text string"), f"{tmp_path}/i")
    index = lexical.open_index(spark, f"{tmp_path}/i")
    asked = spark.createDataFrame([(1, "red dog"), (2, "red blue green dog cat fish"), (3, "cat")], "query_id int, query string")
    want = lexical.bm25(index, asked, 5).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(lexical, "MATCHES", 50)
    made, repartition = [], type(asked).repartition
    monkeypatch.setattr(type(asked), "repartition", lambda df, *a: made.append(a[0]) or repartition(df, *a))
    for at_once in (lexical.AT_ONCE, 0):
        monkeypatch.setattr(lexical, "AT_ONCE", at_once)
        got = lexical.bm25(index, asked, 5).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["id"], round(r["score"], 9)) for r in got] == [(r["query_id"], r["id"], round(r["score"], 9)) for r in want]
    assert min(made) == max(made) and 30 < min(made) < 60  # about 2,380 matches, 50 a task


def test_bm25_deals_postings_in_bounded_pieces(spark, monkeypatch):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("red blue green dog cat fish".split()) for _ in range(6))) for i in range(3_000)], "id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "red dog"), (2, "red blue green dog cat fish")], "query_id int, query string")
    key, held, repartition = "spark.sql.files.maxPartitionBytes", [], type(asked).repartition
    before = spark.conf.get(key)

    def dealt(df, *a):
        if "tf" in df.columns:
            held.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
        return repartition(df, *a)

    monkeypatch.setattr(type(asked), "repartition", dealt)
    got = []
    for piece in (lexical.PIECE, 4_000):
        monkeypatch.setattr(lexical, "PIECE", piece)
        index = lexical.index_of_terms(docs, asked.select(F.explode(T.tokens(F.col("query"))).alias("term")))
        got.append(lexical.bm25(index, asked, 5).orderBy("query_id", "rank").collect())
    assert got[0] == got[1] and len(got[0]) == 10 and spark.conf.get(key) == before
    assert len(held[0]) == 1 and sum(held[0]) == sum(held[1]) and max(held[1]) < sum(held[1]) / 4


@pytest.mark.parametrize("name, searches", [("rrf_fusion", 2), ("merge_across_corpora", 4), ("retrieve_fused", 6)])
def test_searches_do_not_share_the_tasks_that_rank_them(spark, name, searches):
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= searches


@pytest.mark.parametrize("metric", dense.METRICS)
def test_a_cap_sees_all_rows(spark, metric, monkeypatch):
    rng = np.random.default_rng(11)
    near = np.array([1.0, 0, 0, 0]) + rng.normal(size=(400, 4)).round(2) / 50
    vecs = np.concatenate([near, near[:40], rng.normal(size=(200, 4)).round(1)])
    documents = ["hot"] * 430 + [None] * 10 + [f"d{i % 60}" for i in range(200)]
    ids_ = rng.permutation(len(vecs))
    rows = [(int(i), d, [float(x) for x in v]) for i, d, v in zip(ids_, documents, vecs)] + [(9_000, "hot", None)]
    c = spark.createDataFrame(rows, "id long, document string, embedding array<double>").repartition(3)
    q = c.filter("id % 40 = 0 and embedding is not null").select(F.col("id").alias("query_id"), "embedding")
    asked = {r["query_id"]: np.array(r["embedding"]) for r in q.collect()}

    def plain(v, floor, cap):
        unit = (lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)) if metric == "cosine" else (lambda m: m)
        x, y = unit(v), unit(vecs)
        score = -((y - x) ** 2).sum(axis=1) if metric == "l2" else (x * y).sum(axis=1)
        taken, out = {}, []
        for n in sorted(range(len(vecs)), key=lambda n: (-score[n], ids_[n])):
            taken[documents[n]] = taken.get(documents[n], 0) + 1
            if (floor is None or score[n] >= floor) and taken[documents[n]] <= cap:
                out.append(int(ids_[n]))
        return out[:8]

    for tile, block, floor, cap in ((2_000_000, 2_000_000, None, 3), (4_000, 2_000_000, -0.5, 1), (4_000, 20, None, 3), (4_000, 2_000_000, 0.9, 20), (4_000, 2_000_000, None, 0)):
        monkeypatch.setattr(dense, "TILE", tile)
        monkeypatch.setattr(dense, "BLOCK_NUMBERS", block)
        monkeypatch.setattr(dense, "CORPUS_NUMBERS", 4_000_000 if block > 20 else 800)
        got = dense.search(c, q, 8, floor, cap, metric).orderBy("query_id", "rank").collect()
        for n, v in asked.items():
            assert [r["id"] for r in got if r["query_id"] == n] == plain(v, floor, cap)
    # as many as a bounded over-fetch gives, where that is asked for
    bounded = dense.search(c, q, 8, None, 3, metric, among=dense.over_fetch(8, 3)).groupBy("query_id").count()
    assert dense.over_fetch(8, 3) == 96 and (metric == "ip" or bounded.agg(F.min("count")).first()[0] < 8)


def test_capped_scores_few_numbers_again():
    rng = np.random.default_rng(12)
    codes = np.sort(np.r_[np.zeros(5_000, int), rng.integers(0, 40, 5_000)])
    about = rng.normal(size=(20, 10_000)) + 3 * (codes == 0)
    rows, columns = dense.capped(about, codes, 8, 3, np.full(20, 1e-9))
    assert len(rows) < 20 * 40 and sorted(set(rows)) == list(range(20))
    for n in range(20):
        taken, want = {}, []
        for i in np.argsort(-about[n]):
            taken[codes[i]] = taken.get(codes[i], 0) + 1
            want += [i] if taken[codes[i]] <= 3 else []
        assert set(want[:8]) <= set(columns[rows == n])
