"""Offline metrics of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import text as T
from skeinwork.operators.ranges import running
from skeinwork.sources.scratch import stage


def first_ranks(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """gold (query_id, id) with the rank of the gold id among the query's hits, or null."""
    found = hits.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    return gold.join(found, ["query_id", "id"], "left")


def recall_and_mrr(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 8)) -> DataFrame:
    """One row: recall_at_k for each k, mrr, n. A missing rank counts as no hit."""
    at = [F.avg(F.when(F.col("rank") < k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks]
    return ranked.agg(*at, F.avg(F.coalesce(1 / (F.col("rank") + 1.0), F.lit(0.0))).alias("mrr"), F.count("*").alias("n"))


def context_metrics(hits: DataFrame) -> DataFrame:
    """query_id, precision, recall of hits (query_id, rank, relevant boolean; a query without hits has one row with null rank)."""
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.coalesce(F.col("relevant"), F.lit(False)).cast("int")
    rows = hits.withColumn("hit", hit).withColumn("p", F.sum("hit").over(so_far) / F.count("*").over(so_far))
    return rows.groupBy("query_id").agg(F.coalesce(F.avg(F.when(F.col("hit") == 1, F.col("p"))), F.lit(0.0)).alias("precision"), F.max("hit").cast("double").alias("recall"))


def relevant(hit_text: Column, references: Column, threshold: float = 0.4) -> Column:
    """Whether any reference's token overlap with the text reaches the threshold."""
    return F.exists(references, lambda r: T.jaccard(T.token_set(hit_text), T.token_set(r)) >= threshold)


def _by_score(scores: DataFrame) -> DataFrame:
    """score, p, n: positives and negatives of each distinct score, written once."""
    return stage(scores.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n")), "scores")


def auc(scores: DataFrame) -> DataFrame:
    """One row: auc of scores (score, positive boolean), ties half; NaN if a side is empty.

    By ranks of distinct scores, so neither pairs nor a single sorted list of rows is needed.
    """
    by = _by_score(scores)
    wins = running(by, "score", upto="n").withColumn("w", F.col("p") * (F.col("upto") - 0.5 * F.col("n")))
    total = wins.agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).otherwise(F.lit(float("nan"))).alias("auc"))


def best_threshold(scores: DataFrame) -> DataFrame:
    """One row: threshold, accuracy: the observed score that best parts positives (at or above) from negatives; ties: the lowest."""
    by = _by_score(scores)
    total = by.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()  # two numbers
    right = total["p"] - F.col("ps") + F.col("p") + F.col("ns") - F.col("n") if total["p"] is not None else F.lit(0)
    swept = running(by, "score", ps="p", ns="n").select(F.col("score").alias("threshold"), F.try_divide(right, F.lit((total["p"] or 0) + (total["n"] or 0))).alias("accuracy"))
    return swept.orderBy(F.desc("accuracy"), "threshold").limit(1)


def behaviour(answers: DataFrame) -> DataFrame:
    """One row of rates over answers (kind: 'gold' | 'off' | 'advice', abstained, refused, grounded, citations, dropped).

    Off-domain questions answered (0 without any), gold questions not answered, advice refused, gold
    refused; over answered gold questions: share grounded, mean citations, dropped markers of all markers.
    """
    answered = ~F.col("abstained") & ~F.col("refused")
    gold, off, advice = (F.col("kind") == k for k in ("gold", "off", "advice"))
    good = gold & answered

    def rate(of: Column, among: Column) -> Column:
        return F.avg(F.when(among, of.cast("double")))

    return answers.agg(
        F.coalesce(rate(answered, off), F.lit(0.0)).alias("false_answer_rate"),
        rate(F.col("abstained"), gold).alias("false_abstention_rate"),
        rate(F.col("refused"), advice).alias("refusal_accuracy"),
        F.count_if(gold & F.col("refused")).alias("gold_questions_wrongly_refused"),
        rate(F.col("grounded"), good).alias("groundedness_rate"),
        F.avg(F.when(good, F.col("citations"))).alias("mean_citations_per_answer"),
        F.try_divide(F.sum(F.when(good, F.col("dropped"))), F.sum(F.when(good, F.col("dropped") + F.col("citations")))).alias("dropped_marker_rate"),
    )


#: Sections that make a question, by the section's exact name.
QUESTIONS = {
    "Etiology": "What causes {}?",
    "Epidemiology": "How common is {}?",
    "Pathophysiology": "What is the pathophysiology of {}?",
    "Treatment / Management": "How is {} managed?",
    "Prognosis": "What is the prognosis for {}?",
    "Complications": "What are the complications of {}?",
    "Differential Diagnosis": "What is the differential diagnosis for {}?",
    "Evaluation": "How is {} evaluated?",
    "History and Physical": "What are the history and physical findings in {}?",
}


def gold_set(chunks: DataFrame, templates: dict[str, str] = QUESTIONS, limit: int = 40, least: int = 10) -> DataFrame:
    """Questions from chunks (chunk_id, text, source_type, document, section): the first chunk by id of each document and section
    whose section has a template, the first `limit` of them; fewer than `least` is an error."""
    spark = chunks.sparkSession
    rules = F.broadcast(spark.createDataFrame(list(templates.items()), "section string, template string"))
    fit = chunks.filter(F.col("source_type") == "statpearls").join(rules, "section")
    first = Window.partitionBy("document", "section").orderBy("chunk_id")
    items = fit.withColumn("__at", F.row_number().over(first)).filter("__at = 1").orderBy("chunk_id").limit(limit)
    made = items.select(
        F.replace("template", F.lit("{}"), F.lower("document")).alias("question"), "chunk_id", F.col("text").alias("reference"), F.array("text").alias("reference_contexts"), "document", "section"
    )
    n = made.count()
    if n < least:
        raise ValueError(f"only {n} gold questions can be made, {least} are needed")
    return made


def report(metrics: DataFrame, notes: tuple[str, ...] = ()) -> str:
    """Text of metrics (metric_group, metric, value), a few rows, by group."""
    lines: list[str] = []
    for group, rows in _grouped(metrics):
        lines.append(group)
        width = max(len(m) for m, _ in rows)
        lines += [f"  {m.ljust(width)}  {v:.3f}" if isinstance(v, float) else f"  {m.ljust(width)}  {v}" for m, v in rows]
    return "\n".join([*lines, *(f"note: {n}" for n in notes)])


def _grouped(metrics: DataFrame):
    found: dict[str, list] = {}
    for r in metrics.orderBy("metric_group", "metric").collect():
        found.setdefault(r["metric_group"], []).append((r["metric"], r["value"]))
    return found.items()


def combine(**groups: DataFrame) -> DataFrame:
    """One long table (metric_group, metric, value) of one-row tables of numbers, by group."""
    out = None
    for group, row in groups.items():
        numbers = row.select(*(F.col(c).cast("double").alias(c) for c in row.columns))
        long = numbers.unpivot([], row.columns, "metric", "value").select(F.lit(group).alias("metric_group"), "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out
