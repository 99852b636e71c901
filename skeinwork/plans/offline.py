"""The whole offline evaluation of an answering system in one call."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators import evaluate, judge

#: At most so many questions are spelled out in a note.
NAMED = 10


def evaluate_system(
    gold: DataFrame,
    off: DataFrame,
    advice: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    answers: Callable[[DataFrame], DataFrame],
    judges: dict | None = None,
    ks: tuple[int, ...] = (1, 3, 8),
    overlap: float = 0.4,
) -> tuple[DataFrame, tuple[str, ...]]:
    """(metric_group, metric, value) and notes.

    gold: see evaluate.gold_set; off, advice: question. `search` gives query_id, id, rank, text for rows
    query_id, question; `answers` gives query_id, answer, abstained, refused, grounded, citations, dropped (numbers).
    With `judges` (see judge.score) the answers to gold questions are judged too; without, a note says so.
    """
    asked = reduce(
        DataFrame.unionByName,
        [df.select(F.concat(F.lit(f"{kind}:"), F.md5(F.col("question").cast("binary"))).alias("query_id"), "question", F.lit(kind).alias("kind")) for kind, df in (("gold", gold), ("off", off), ("advice", advice))],
    ).dropDuplicates(["query_id"])
    hits = search(asked.select("query_id", "question"))
    known = gold.withColumn("query_id", F.concat(F.lit("gold:"), F.md5(F.col("question").cast("binary"))))
    ranked = evaluate.first_ranks(known.select("query_id", F.col("chunk_id").alias("id")), hits.select("query_id", "id", "rank"))
    judged_hits = known.select("query_id", "reference_contexts").join(hits, "query_id", "left")
    relevance = evaluate.context_metrics(judged_hits.withColumn("relevant", evaluate.relevant(F.col("text"), F.col("reference_contexts"), overlap)))
    means = relevance.agg(F.avg("precision").alias("context_precision"), F.avg("recall").alias("context_recall"))
    replies = answers(asked.select("query_id", "question"))
    groups = {
        "retrieval": evaluate.recall_and_mrr(ranked, ks),
        "contexts": means,
        "behavioral": evaluate.behaviour(replies.join(asked.select("query_id", "kind"), "query_id")),
    }
    notes = []
    if judges:
        texts = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]).alias("contexts"))
        rows = known.join(texts, "query_id", "left").join(replies.select("query_id", "answer"), "query_id")
        none = F.coalesce("contexts", F.array().cast("array<string>"))
        samples = rows.select(F.col("question").alias("user_input"), F.col("answer").alias("response"), none.alias("retrieved_contexts"), "reference_contexts", "reference")
        scored = judge.score(samples, judges)
        groups["judged"] = judge.means(scored, [c for c in scored.columns if c not in samples.columns])
    else:
        notes.append("no judge was given: overlap metrics only")
    found = asked.filter("kind = 'off'").join(hits.select("query_id").distinct(), "query_id", "left_semi").orderBy("question")
    n = found.count()
    if n:
        names = ", ".join(r["question"] for r in found.limit(NAMED).collect())
        notes.append(f"{n} off-domain question(s) found evidence above the floor and count as false answers if answered: {names}")
    return evaluate.combine(**groups), tuple(notes)
