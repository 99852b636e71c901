import pytest
from pyspark.sql import functions as F

from skeinwork.functions import models
from skeinwork.functions import text as T
from skeinwork.operators import chunking, evaluate
from skeinwork.plans import offline, prompts
from skeinwork.sources import tables


def test_evaluate_system(spark):
    gold = spark.createDataFrame(
        [("what is a", "c1", "alpha is a letter", ["alpha is a letter"]), ("what is b", "c2", "beta is a letter", ["beta is a letter"])],
        "question string, chunk_id string, reference string, reference_contexts array<string>",
    )
    off, advice = (spark.createDataFrame([(q,)], "question string") for q in ("who won", "should i"))

    def search(asked):
        texts = F.when(F.col("question") == "what is a", "alpha is a letter").when(F.col("question") == "what is b", "quite other words").when(F.col("question") == "who won", "x")
        rows = asked.withColumn("text", texts).filter("text is not null")
        return rows.select("query_id", F.when(F.col("question") == "what is a", "c1").otherwise("c9").alias("id"), F.lit(0).alias("rank"), "text")

    def answers(asked):
        return asked.select("query_id", F.lit("said").alias("answer"), F.lit(False).alias("abstained"), (F.col("question") == "should i").alias("refused"), F.lit(True).alias("grounded"), F.lit(2).alias("citations"), F.lit(0).alias("dropped"))

    metrics, notes = offline.evaluate_system(gold, off, advice, search, answers)
    got = {(r["metric_group"], r["metric"]): r["value"] for r in metrics.collect()}
    assert got["retrieval", "recall_at_1"] == got["retrieval", "mrr"] == got["contexts", "context_precision"] == got["contexts", "context_recall"] == 0.5
    assert got["behavioral", "false_answer_rate"] == 1.0 and got["behavioral", "refusal_accuracy"] == 1.0 and got["retrieval", "n"] == 2
    assert len(notes) == 2 and "who won" in notes[1]
    judged, notes = offline.evaluate_system(gold, off, advice, search, answers, {"faithfulness": lambda df: F.lit(0.5)})
    assert {(r["metric"], r["value"]) for r in judged.filter("metric_group = 'judged'").collect()} >= {("faithfulness", 0.5), ("n_samples", 2.0)} and len(notes) == 1
    assert "recall_at_1" in evaluate.report(metrics, notes)


def test_chunk_writers(spark, tmp_path):
    rows = [("a.jsonl", "1", "x"), ("b.jsonl", "2", "y")]
    df = spark.createDataFrame(rows, "source_file string, id string, content string")
    path = str(tmp_path / "chunks")
    tables.write_chunk_files(df.filter("id = '1'"), path)
    tables.write_chunk_files(df.withColumn("content", F.lit("new")), path)
    assert {(r["id"], r["content"]) for r in spark.read.json(path).collect()} == {("1", "x"), ("2", "new")}
    tables.write_chunk_files(df.filter("id = '1'").withColumn("content", F.lit("newer")), path, "overwrite")
    assert {(r["id"], r["content"]) for r in spark.read.json(path).collect()} == {("1", "newer"), ("2", "new")}
    tables.write_numbered(spark.range(25), str(tmp_path / "n"), "id", 10)
    assert sorted(p.name for p in (tmp_path / "n").glob("batch=*")) == ["batch=0000", "batch=0001", "batch=0002"]
    results = spark.createDataFrame([("q1", "r")], "question_id string, reply string")
    tables.write_results(results, str(tmp_path / "r"), "one")
    tables.write_results(results.withColumn("reply", F.lit("again")), str(tmp_path / "r"), "one")
    tables.write_results(results, str(tmp_path / "r"), "two")
    assert sorted((r["run"], r["reply"]) for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [("one", "r"), ("two", "r")]


def test_readers(spark, tmp_path):
    folder = tmp_path / "chunk"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id": "1", "title": "t", "content": "x"}\n{"id": "2", "title": "u", "content": "y"}\n')
    lines = tables.read_lines(spark, str(folder))
    hit = tables.lines_of(spark.createDataFrame([("a.jsonl", 1)], "source_file string, line_no int"), lines).first()
    assert (hit["id"], hit["title"], hit["content"]) == ("2", "u", "y")
    spark.createDataFrame([(1, "T", None)], "id long, title string, text string").write.parquet(str(tmp_path / "e"))
    assert tuple(tables.read_encyclopedia(spark, str(tmp_path / "e")).first()) == ("1", "T", "")
    vectors = spark.createDataFrame([("c1", "d", [1.0])], tables.VECTOR)
    tables.write_vectors(vectors, str(tmp_path / "v"), {"count": 1})
    chunks = spark.createDataFrame([("c1", "text")], "chunk_id string, text string")
    assert tables.read_index(spark, str(tmp_path / "v"), chunks, {"count": 1}).first()["text"] == "text"
    (tmp_path / "j.json").write_text('[{"user_input": "q", "retrieved_contexts": ["a"]}]')
    assert tables.read_judged(spark, str(tmp_path / "j.json")).first()["retrieved_contexts"] == ["a"]
    (tmp_path / "s.json").write_text('{"start": "^", "user": "U: {}|", "assistant": "A: {}|"}')
    style = tables.read_chat_style(spark, str(tmp_path / "s.json"))
    chat = spark.createDataFrame([([("user", "hi"), ("assistant", "yo")],)], "c array<struct<role:string,content:string>>")
    assert chat.select(T.chat_template(F.col("c"), style)).first()[0] == "^U: hi|A: yo|"
    assert chat.select(T.chat_template(F.col("c"), "sections")).first()[0] == "### User:\nhi\n### Assistant:\nyo\n"


def test_models(spark):
    import numpy as np

    hidden, mask = np.arange(12.0).reshape(1, 3, 4), np.array([[1, 1, 0]])
    assert models.pool(hidden, mask, "cls").tolist() == [[0, 1, 2, 3]] and models.pool(hidden, mask, "mean").tolist() == [[2, 3, 4, 5]]
    with pytest.raises(ValueError):
        models.pool(hidden, mask, "max")
    assert models.pooled(lambda texts: (hidden, mask), "mean")(["x"]).shape == (1, 4)
    say = models.generator(lambda: lambda chat, stop: chat[0]["content"] + stop, stop="!")
    df = spark.createDataFrame([([("user", "hi")],)], "c array<struct<role:string,content:string>>")
    assert df.select(say("c")).first()[0] == "hi!"


def test_prompt_forms():
    assert {prompts.form_for(m, c) for m in ("gpt", "Meditron-70b", "PMC_llama") for c in (False, True)} == set(prompts.FORMS)
    assert all("{{question}}" in user and "{{options}}" in user for _, user in prompts.FORMS.values())


def plain_chunks(text, size, overlap, separators):
    """The splitting rules once more, on lists of words between separators."""
    sep = next(s for s in separators if s == "" or s in text)
    parts = [p for p in (text.split(sep) if sep else list(text)) if p]
    out, run = [], []

    def close(parts):
        """Greedy windows over small parts: each starts with as many of the last one's parts as fit the overlap."""
        windows, first = [], 0
        while first < len(parts):
            last = first
            while last + 1 < len(parts) and len(sep.join(parts[first : last + 2])) <= size:
                last += 1
            windows.append((first, last))
            if last + 1 == len(parts):
                break
            first_next = first
            while first_next <= last and (len(sep.join(parts[first_next : last + 1])) > overlap or len(sep.join(parts[first_next : last + 2])) > size):
                first_next += 1
            first = first_next
        return [w for a, b in windows if (w := sep.join(parts[a : b + 1]).strip())]

    for p in parts:
        if len(p) < size:
            run.append(p)
        else:
            out += close(run)
            run = []
            rest = separators[separators.index(sep) + 1 :]
            out += plain_chunks(p, size, overlap, rest) if rest else [p]
    return out + close(run)


def test_recursive_chunks_against_plain_rules():
    import random

    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["word", "w", "longer-word-here", " ", " ", "\n", "\n\n", "x" * 40]) for _ in range(rng.randint(0, 60)))
        size = rng.choice([10, 30, 60])
        overlap = rng.choice([0, 5, 9])
        assert chunking.split_text(text, size, overlap) == (plain_chunks(text, size, overlap, chunking.SEPARATORS) if text else []), text


def test_pmids_far_up_are_found():
    xml = "<PMID Version='1'>77</PMID>" + "<x/>" * 10_000 + "<Article><ArticleTitle>T</ArticleTitle><AbstractText>A</AbstractText></Article>" + "<Article><AbstractText>B</AbstractText></Article><PMID>78</PMID><Article ><AbstractText>C</AbstractText><PMID>9</PMID></Article>"
    assert chunking.citation_records(xml) == [("77", "T", "A"), ("77", "", "B"), ("78", "", "C")]


def test_manifest_has_a_time(spark):
    from skeinwork.operators import sampling

    rows = spark.createDataFrame([(1, "s", "f")], "id int, source string, file string")
    made = sampling.manifest(rows, "source", "file", "id", 7, 5)
    assert made["created_at"].endswith("+00:00") and made["requested"] == 5 and made["sources"]["s"] == {"count": 1, "files": ["f"]}


def test_running_sums_in_many_ranges(spark, monkeypatch):
    from skeinwork.operators import ranges

    monkeypatch.setattr(ranges, "ROWS", 2)
    values = [(float(x), x % 3) for x in range(1000)]
    rows = spark.createDataFrame(values[::-1], "x double, n long").repartition(4)
    got = {r["x"]: r["s"] for r in ranges.running(rows, "x", s="n").collect()}
    assert got == {x: sum(n for _, n in values[: int(x) + 1]) for x, _ in values}
    bounds = [0.5, 2.0, 2.5, 7.0, 9.0]
    for count in range(6):
        some = bounds[:count]
        got = [r[0] for r in rows.filter("x < 12").orderBy("x").select(ranges.place(F.col("x"), some)).collect()]
        assert got == [sum(b <= x for b in some) for x in range(12)]
