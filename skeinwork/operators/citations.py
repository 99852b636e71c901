"""Checks of the markers in answers, and attribution of claims without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import text as T
from skeinwork.functions import vectors
from skeinwork.operators import dense


def dropped_markers(answer: Column, n_hits: Column) -> Column:
    """Markers in the answer that name none of the n hits [S1] .. [Sn], in order, repeats kept."""
    valid = F.transform(F.when(n_hits > 0, F.sequence(F.lit(1), n_hits)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("[S"), i.cast("string"), F.lit("]")))
    return F.filter(F.regexp_extract_all(answer, F.lit(r"(\[S\d+\])"), 1), lambda m: ~F.array_contains(valid, m))


def without_markers(answer: Column, dropped: Column) -> Column:
    """The answer without the dropped markers, single-spaced."""
    left = F.aggregate(F.array_distinct(dropped), answer, lambda t, m: F.replace(t, m, F.lit("")))
    return T.strip(F.regexp_replace(left, " +", " "))


def validate(df: DataFrame, answer: str = "answer", hits: str = "hits") -> DataFrame:
    """df with cleaned, citations (map marker -> hit), dropped and unsupported; hits is an array of structs by rank."""
    n = F.size(hits)
    with_dropped = df.withColumn("dropped", dropped_markers(F.col(answer), n))
    cleaned = with_dropped.withColumn("cleaned", without_markers(F.col(answer), F.col("dropped")))
    marked = F.map_from_entries(F.transform(hits, lambda h, i: F.struct(F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("]")).alias("k"), h.alias("v"))))
    return cleaned.withColumn("citations", F.map_filter(marked, lambda k, _: F.contains(F.col("cleaned"), k))).withColumn("unsupported", T.uncited_claims(F.col("cleaned")))


def attribute(sentences: DataFrame, snippets: DataFrame, floor: float = 0.20, center: DataFrame | None = None) -> DataFrame:
    """Best snippet of each uncited sentence in centered space; marker is null below the floor (inclusive).

    sentences: answer_id, sentence_no, vector; snippets: answer_id, rank, vector. Without a center of
    the same width the mean of the answer's snippets is the center. Ties: the first snippet.
    """
    given = center.first() if center is not None else None  # one vector
    fixed = F.array(*map(F.lit, given["center"])) if given is not None and given["center"] is not None else None
    # means are made only of answers that need them
    needed = snippets if fixed is None else snippets.join(snippets.filter(F.size("vector") != F.size(fixed)).select("answer_id").distinct(), "answer_id", "left_semi")
    middle = needed.select("answer_id", F.posexplode("vector").alias("i", "x")).groupBy("answer_id", "i").agg(F.avg("x").alias("m"))
    own = middle.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    pairs = sentences.join(own, "answer_id", "inner" if fixed is None else "left").join(snippets.select("answer_id", "rank", F.col("vector").alias("v")), "answer_id")
    c = F.col("c") if fixed is None else F.when(F.size(fixed) == F.size("v"), fixed).otherwise(F.col("c"))
    score = vectors.dot(vectors.normalize(vectors.subtract(F.col("vector"), c)), vectors.normalize(vectors.subtract(F.col("v"), c)))
    best = Window.partitionBy("answer_id", "sentence_no").orderBy(F.desc("score"), "rank")
    top = pairs.select("answer_id", "sentence_no", "rank", score.alias("score")).withColumn("__at", F.row_number().over(best)).filter("__at = 1")
    return top.select("answer_id", "sentence_no", "rank", "score", _marker(floor).alias("marker"))


def attribute_within(sentences: DataFrame, snippets: DataFrame, floor: float = 0.20) -> DataFrame:
    """answer_id, rank, score, marker as of `attribute`, for answers whose snippets are all vectors of their document, other than their own.

    sentences: answer_id, document, vector; snippets: rank, document, vector; vectors are centered and of unit length. Documents are shared
    by many answers, so pairs are scored where the snippets lie and only the best of each task leaves it.
    """
    asked = sentences.filter(F.col("document").isNotNull()).select(F.col("answer_id").alias("query_id"), "document", F.col("vector").alias("embedding"))
    held = snippets.filter(F.col("document").isNotNull()).select(F.col("rank").alias("id"), "document", F.col("vector").alias("embedding"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = dense.candidates(held, asked, 1, within=True).withColumn("__at", F.row_number().over(best)).filter("__at = 1")
    return top.select(F.col("query_id").alias("answer_id"), F.col("id").alias("rank"), "score").withColumn("marker", _marker(floor))


def _marker(floor: float) -> Column:
    return F.when(F.col("score") >= floor, F.concat(F.lit("[S"), (F.col("rank") + 1).cast("string"), F.lit("]")))
