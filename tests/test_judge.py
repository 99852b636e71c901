import math

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import models
from skeinwork.operators import evaluate, judge
from skeinwork.sources.tables import JUDGED


def test_scores(spark):
    rows = [("q", "a", ["abcd", "zzzz", "abcx"], ["abcd"], "r"), ("q", "a", [], ["abcd"], "r"), ("q", None, ["abcd"], ["abcd", "wxyz"], "r")]
    scored = judge.score(spark.createDataFrame(rows, JUDGED), {"faithfulness": lambda df: F.when(F.col("response").isNotNull(), 0.5)})
    got = scored.collect()
    assert got[0]["context_precision"] == pytest.approx((1 + 2 / 3) / 2) and got[0]["context_recall"] == 1.0 and got[0]["faithfulness"] == 0.5
    assert (got[1]["context_precision"], got[1]["faithfulness"]) == (0.0, 0.0)
    assert got[2]["context_recall"] is None  # its judge failed
    m = judge.means(scored, ["context_recall", "faithfulness"]).first()
    assert (m["context_recall"], m["faithfulness"], m["n_samples"]) == (0.5, 0.25, 2)
    long = evaluate.combine(judged=judge.means(scored, ["context_recall"]))
    assert "n_samples" in evaluate.report(long, ("two of three",)) and long.count() == 2


def _judge(fail=""):
    """Statements are sentences; one follows if its words stand in the text; the question made is the answer's first sentence."""

    def make():
        import json
        import re

        def reply(chat):
            text = chat[-1]["content"]
            if fail and fail in text:
                raise RuntimeError("no service")
            if text.startswith("Break"):
                answer = text.rsplit("Answer: ", 1)[1]
                return "no list" if "unreadable" in answer else "Here: " + json.dumps({"statements": [s for s in re.split(r"(?<=\.) ", answer) if s]})
            if text.startswith("For each"):
                evidence, statements = text.split("Text:\n", 1)[1].split("\n\nStatements:\n")
                return json.dumps({"verdicts": [int(set(s.split()[1:]) <= set(re.split(r"\s+", evidence))) for s in statements.split("\n")]})
            answer = text.rsplit("Answer: ", 1)[1]
            return json.dumps({"question": answer.split(".")[0], "noncommittal": int("evasive" in answer)})

        return reply

    return models.attempts(make)


SAMPLES = [
    (1, "what is it", "it is red. it is big.", ["it is red. so", "other"], ["it is red. so"], "it is red. it is round."),
    (2, "what is it", "evasive words only.", ["x"], ["x"], "it is red."),
    (3, "what is it", "unreadable.", ["x"], ["x"], "it is red."),
    (4, "what is it", "broken call.", ["x"], ["x"], "it is red."),
    (5, "what is it", "it is red.", [], ["x"], "it is red."),
    (6, None, None, ["x"], [], None),
    (7, "it is red", "it is red.", ["it is red. so"], ["it is red. so"], "it is red."),
]


def test_six_metrics_against_plain_rules(spark):
    schema = "id int, user_input string, response string, retrieved_contexts array<string>, reference_contexts array<string>, reference string"
    samples = spark.createDataFrame(SAMPLES, schema)
    encode = models.encoder(lambda: models.hashing_encoder(64))
    score = lambda rows, fail="": {r["id"]: r for r in judge.model_scores(rows, _judge(fail), encode, "id").collect()}
    got = score(samples, "broken call")

    def cosine(a, b):
        x, y = models.hashing_encoder(64)([a, b])
        return float(x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y))) if x.any() and y.any() else 0.0

    one = got[1]
    same = cosine("it is red. it is big.", "it is red. it is round.")
    want = {"context_precision": 1.0, "context_recall": 1.0, "faithfulness": 0.5, "answer_relevancy": cosine("it is red", "what is it"), "answer_similarity": same, "answer_correctness": 0.75 * 0.5 + 0.25 * same}
    assert one["note"] is None and {n: one[n] for n in judge.SIX} == pytest.approx(want, abs=1e-6)
    assert got[2]["answer_relevancy"] == 0 and got[2]["faithfulness"] == 0 and got[2]["note"] is None
    assert got[3]["note"] == "statements: the reply cannot be read" and got[4]["note"] == "questions: RuntimeError: no service"
    assert got[5]["note"] == "no retrieved contexts" and got[6]["note"].startswith("statements: the answer has none")
    assert all(got[i][n] is None for i in (3, 4, 6) for n in judge.SIX) and all(got[5][n] == 0 for n in judge.SIX)
    assert got[7]["answer_correctness"] == pytest.approx(1.0) and got[7]["answer_relevancy"] == pytest.approx(1.0, abs=1e-6) and got[7]["faithfulness"] == 1
    clean = score(samples.filter("id in (1, 2, 7)"))
    assert all(str(clean[i]) == str(got[i]) for i in clean)
    means = judge.means(judge.model_scores(samples, _judge("broken call"), encode, "id"), list(judge.SIX)).first()
    assert means["n_samples"] == 4
