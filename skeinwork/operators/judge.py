"""Scores of judged samples: string overlap natively, model judges as injected columns, and their means."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import models, vectors
from skeinwork.functions import text as T
from skeinwork.sources.scratch import stage

#: Scorers that need a model or an encoder; each is a function of the sample's columns.
MODEL_METRICS = ("faithfulness", "answer_relevancy", "answer_correctness", "answer_similarity")


#: An edit distance of two texts, no less than the difference of their numbers of characters.
Distance = Callable[[Column, Column], Column]


def byte_distance(a: Column, b: Column) -> Column:
    """Edits between the texts' UTF-8 bytes, as DuckDB's levenshtein counts them. They are no fewer than those between the characters:
    each character that is not kept has a byte of its own that is not."""
    a, b = (F.decode(x.cast("binary"), "ISO-8859-1") for x in (a, b))  # a character for each byte
    return F.levenshtein(a, b)


def similarity(a: Column, b: Column, distance: Distance = F.levenshtein) -> Column:
    """1 less the edit distance by the longer text's length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - distance(a, b) / longest)


def close(a: Column, b: Column, threshold: float, distance: Distance = F.levenshtein) -> Column:
    """Whether the similarity reaches the threshold, without measuring distances beyond it where the lengths alone tell."""
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    return F.when(shortest < threshold * longest - 1e-9, False).otherwise(similarity(a, b, distance) >= threshold)


def context_scores(retrieved: Column, references: Column, threshold: float = 0.5, distance: Distance = F.levenshtein) -> Column:
    """struct<precision, recall> of contexts that are close to a reference, each pair compared once.

    precision: mean precision at the ranks of close contexts, 0 if none is; recall: share of references
    close to a retrieved context, 0 without references. Contexts that cannot be compared (nulls) have no rank.
    """
    met = F.transform(retrieved, lambda c: F.transform(references, lambda r: close(c, r, threshold, distance)))

    def step(acc: Column, hit: Column) -> Column:
        n, found = acc["n"] + 1, acc["found"] + hit
        return F.struct(n.alias("n"), found.alias("found"), (acc["sum"] + hit * found / n).alias("sum"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("found"), F.lit(0.0).alias("sum"))

    def both(m: Column) -> Column:
        hits = F.filter(F.transform(m, lambda row: F.exists(row, lambda x: x).cast("int")), lambda hit: hit.isNotNull())
        precision = F.aggregate(hits, start, step, lambda acc: F.when(acc["found"] > 0, acc["sum"] / acc["found"]).otherwise(0.0))
        covered = F.size(F.filter(references, lambda _, i: F.exists(m, lambda row: F.get(row, i))))
        recall = F.when(F.size(references) > 0, covered / F.greatest(F.size(references), F.lit(1))).otherwise(0.0)
        return F.struct(precision.alias("precision"), recall.alias("recall"))

    return F.element_at(F.transform(F.array(met), both), 1)


def score(samples: DataFrame, judges: dict[str, Callable[[DataFrame], Column]] | None = None, distance: Distance = F.levenshtein) -> DataFrame:
    """Samples (see sources.tables.JUDGED) with a column for each metric. Samples without contexts score 0
    everywhere; a judge gives null where it fails, and such a sample's scores are all null."""
    both = samples.withColumn("__both", context_scores(F.col("retrieved_contexts"), F.col("reference_contexts"), distance=distance))
    scored = both.withColumns({"context_precision": F.col("__both.precision"), "context_recall": F.col("__both.recall")})
    for name, judge in (judges or {}).items():
        scored = scored.withColumn(name, judge(scored))
    names = ["context_precision", "context_recall", *(judges or {})]
    bare = F.coalesce(F.size("retrieved_contexts"), F.lit(0)) <= 0
    failed = F.lit(False)
    for n in names:
        failed = failed | F.col(n).isNull()
    verdicts = {n: F.when(bare, 0.0).when(~failed, F.col(n)) for n in names}
    return scored.select(*(F.col(c) for c in samples.columns), *(v.alias(n) for n, v in verdicts.items()))


def means(scored: DataFrame, names: list[str]) -> DataFrame:
    """One row: the mean of each metric over samples that did not fail, and n_samples, how many those are."""
    return scored.agg(*(F.avg(n).alias(n) for n in names), F.count(names[0]).alias("n_samples"))


#: What a model is asked; slots are {{question}}, {{text}}, {{evidence}}, {{statements}} and {{n}}.
STATEMENTS = 'Break this answer to the question into short statements that each stand alone. Reply as JSON {"statements": ["..."]}.\n\nQuestion: {{question}}\n\nAnswer: {{text}}'
VERDICTS = 'For each numbered statement reply 1 if it follows from the text, else 0, as JSON {"verdicts": [0, 1]}.\n\nText:\n{{evidence}}\n\nStatements:\n{{statements}}'
ASKED = 'Write question {{n}} that this answer answers. Reply as JSON {"question": "...", "noncommittal": 0}, with 1 if the answer is evasive.\n\nAnswer: {{text}}'

SIX = ("context_precision", "context_recall", *MODEL_METRICS)


def model_scores(samples: DataFrame, ask: Callable[[Column], Column], encode: Callable[[Column], Column], key: str, questions: int = 3, weight: float = 0.75) -> DataFrame:
    """Samples (sources.tables.JUDGED, with a unique `key`) with the SIX metrics and note.

    In stages, each a table of model calls that is written once: answers and references are broken into statements; statements are judged
    against the contexts (faithfulness: the share that follows), the answer's against the reference and the reference's against the
    answer (correct, wrong and missing ones make an F score); questions are made from the answer and compared with the one that was asked, by
    cosine (relevancy: their mean, 0 if all are evasive); answer and reference are compared by cosine (similarity). Correctness is `weight`
    times the F score and the rest similarity.

    A call that fails, or a reply that cannot be read, gives its sample a note and null scores; other samples are as they would be without it.
    A sample without contexts scores 0 throughout, and has a note too.
    """
    base = samples.withColumn("__bare", F.coalesce(F.size("retrieved_contexts"), F.lit(0)) <= 0)
    able = base.filter("not __bare").select(F.col(key).alias("k"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("user_input", "response", "reference")), "retrieved_contexts")

    texts = able.select("k", "user_input", F.explode(F.create_map(F.lit("response"), "response", F.lit("reference"), F.col("reference"))).alias("part", "text"))
    broken = _called(texts, ask, T.fill(STATEMENTS, question=F.col("user_input"), text=F.col("text")), "struct<statements:array<string>>", "judge-statements")
    said = broken.groupBy("k").agg(*(F.any_value(F.when(F.col("part") == p, F.col("got.statements")), True).alias(p) for p in ("response", "reference")))
    joined = F.array_join("retrieved_contexts", "\n")
    judged = able.select("k", F.col("response").alias("answer"), F.col("reference").alias("truth"), joined.alias("contexts")).join(said, "k")
    jobs = (("faithful", "response", "contexts"), ("right", "response", "truth"), ("covered", "reference", "answer"))
    rows = judged.select("k", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(s).alias("statements"), F.col(e).alias("evidence")) for kind, s, e in jobs))).alias("j")).select("k", "j.*")
    numbered = F.array_join(F.transform("statements", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    asked = rows.filter(F.size("statements") > 0)
    verdicts = _called(asked, ask, T.fill(VERDICTS, evidence=F.col("evidence"), statements=numbered), "struct<verdicts:array<int>>", "judge-verdicts")
    fits = F.size("got.verdicts") == F.size("statements")
    verdicts = verdicts.withColumn("error", F.coalesce("error", F.when(~fits, F.lit("as many verdicts as statements are needed"))))
    yes = F.size(F.filter("got.verdicts", lambda v: v == 1))
    counts = verdicts.groupBy("k").agg(
        *(F.max(F.when(F.col("kind") == kind, x)).alias(n) for kind, x, n in (("faithful", yes / F.size("statements"), "faithfulness"), ("right", yes, "tp"), ("right", F.size("statements") - yes, "fp"), ("covered", F.size("statements") - yes, "fn")))
    )
    f = F.coalesce(F.try_divide(F.coalesce("tp", F.lit(0)), F.coalesce("tp", F.lit(0)) + 0.5 * (F.coalesce("fp", F.lit(0)) + F.coalesce("fn", F.lit(0)))), F.lit(0.0))

    wanted = able.select("k", "user_input", "response", F.explode(F.sequence(F.lit(1), F.lit(questions))).alias("n"))
    made = _called(wanted, ask, T.fill(ASKED, n=F.col("n").cast("string"), text=F.col("response")), "struct<question:string,noncommittal:int>", "judge-questions")
    pairs = made.filter("error is null").select("k", "got.noncommittal", encode(F.col("got.question")).alias("a"), encode(F.col("user_input")).alias("b"))
    relevancy = pairs.groupBy("k").agg((F.avg(_cosine("a", "b")) * F.when(F.min("noncommittal") == 1, 0.0).otherwise(1.0)).alias("answer_relevancy"))
    vectors_of = able.select("k", encode(F.col("response")).alias("a"), encode(F.col("reference")).alias("b"))
    similar = vectors_of.select("k", _cosine("a", "b").alias("answer_similarity"))

    stages = (("statements", broken), ("verdicts", verdicts), ("questions", made))
    errors = [df.filter(F.col("error").isNotNull()).select("k", F.concat(F.lit(f"{name}: "), "error").alias("error")) for name, df in stages]
    none = judged.filter(F.coalesce(F.size("response"), F.lit(-1)) == 0).select("k", F.lit("statements: the answer has none").alias("error"))
    notes = reduce(DataFrame.unionByName, [*errors, none]).groupBy("k").agg(F.min("error").alias("note"))
    found = able.select("k").join(counts, "k", "left").join(relevancy, "k", "left").join(similar, "k", "left").join(notes, "k", "left")
    scored = found.select("k", "faithfulness", "answer_relevancy", (weight * f + (1 - weight) * F.col("answer_similarity")).alias("answer_correctness"), "answer_similarity", "note")
    both = base.withColumn("__both", context_scores(F.col("retrieved_contexts"), F.col("reference_contexts"))).join(scored, F.col(key) == F.col("k"), "left")
    whole = both.withColumns({"context_precision": F.col("__both.precision"), "context_recall": F.col("__both.recall")})
    values = {n: F.when(F.col("__bare"), 0.0).when(F.col("note").isNull(), F.col(n)) for n in SIX}
    note = F.when(F.col("__bare"), "no retrieved contexts").otherwise(F.col("note"))
    return whole.select(*(F.col(c) for c in samples.columns), *(v.alias(n) for n, v in values.items()), note.alias("note"))


def _called(rows: DataFrame, ask: Callable[[Column], Column], prompt: Column, form: str, name: str) -> DataFrame:
    """rows with `got`, the reply read as JSON of the form, and error; written, so that a model is asked once."""
    replied = models.told(rows, "reply", ask(T.messages(("user", prompt))))
    got = F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), form)
    field = form.split("<")[1].split(":")[0]
    unread = F.when(got[field].isNull(), F.lit("the reply cannot be read"))
    return stage(replied.withColumns({"got": got, "error": F.coalesce("reply_error", unread)}).drop("reply", "reply_error"), name)


def _cosine(a: str, b: str) -> Column:
    x, y = F.col(a), F.col(b)
    return F.coalesce(F.try_divide(vectors.dot(x, y), vectors.norm(x) * vectors.norm(y)), F.lit(0.0))
