"""Queries on the embeddings table: vec_id is the chunk, label the document; every vec_id divisible by 20 is a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import vectors
from skeinwork.operators import dense, fusion, quantized
from skeinwork.plans import answer
from skeinwork.plans.registry import query, table

K, FLOOR, CAP = 8, 0.1, 3


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("document"), "embedding")


def _queries(corpus: DataFrame) -> DataFrame:
    return corpus.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


_DOT = "list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"
_L2 = "list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(q.embedding::DOUBLE[], c.embedding::DOUBLE[])])"
_COS = f"({_DOT} / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))))"


def _top_sql(score: str, order: str = "DESC") -> str:
    return f"""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label AS document, {score} AS score
           FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) - 1 AS rank FROM s)
SELECT query_id, id, document, round(score, 6) AS score, rank FROM r WHERE rank < {K}"""


CENTERED = """
WITH m AS (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i),
c0 AS (SELECT list(m ORDER BY i) AS c FROM m),
v0 AS (SELECT vec_id, label, [x[1] - x[2] for x in list_zip(embedding::DOUBLE[], c)] AS e FROM embeddings, c0),
v AS (SELECT vec_id, label, [x / CASE WHEN list_inner_product(e, e) = 0 THEN 1 ELSE sqrt(list_inner_product(e, e)) END for x in e] AS embedding FROM v0)"""


def _table(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "document", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""
SELECT i - 1 AS i, round(avg(x), 9) AS m FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i""")
def vec_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    center = vectors.mean_vector(table(spark, sf_dir, "embeddings"))
    return center.select(F.posexplode("center").alias("i", "m")).select(F.col("i").cast("long").alias("i"), F.round("m", 9).alias("m"))


@query(_top_sql(_DOT))
def vec_topk_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return _table(dense.search(c, _queries(c), K, metric="ip"))


@query(_top_sql(_COS))
def vec_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return _table(dense.search(c, _queries(c), K, metric="cosine"))


@query(_top_sql(_L2, "ASC"))
def vec_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distances, least first."""
    c = _corpus(spark, sf_dir)
    return _table(dense.search(c, _queries(c), K, metric="l2").withColumn("score", -F.col("score")))


def _centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return dense.centered(c, vectors.mean_vector(c))


@query(f"""{CENTERED},
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label AS document, list_inner_product(q.embedding, c.embedding) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, document ORDER BY score DESC, id) AS within FROM s WHERE score >= {FLOOR}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM f WHERE within <= {CAP})
SELECT query_id, id, document, round(score, 6) AS score, rank FROM r WHERE rank < {K}""")
def vec_topk_centered_floor_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _centered(spark, sf_dir)
    return _table(dense.search(c, _queries(c), K, FLOOR, CAP))


@query("""
SELECT q.vec_id AS query_id, round(max(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])), 6) AS score
FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 GROUP BY 1""")
def vec_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return dense.max_scores(c, _queries(c)).select("query_id", F.round("score", 6).alias("score"))


@query(f"""{CENTERED},
s AS (SELECT list_inner_product(q.embedding, c.embedding) AS score, q.label = c.label AS same FROM v q, v c WHERE q.vec_id % 20 = 0)
SELECT same, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(max(score), 6) AS top, count(*) AS n FROM s GROUP BY same""")
def vec_score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score distribution of pairs with and without a document in common."""
    c = _centered(spark, sf_dir)
    parts = dense.tally(c, _tagged(c), dense.moments, "same boolean, n long, total double, squares double, top double").groupBy("same").agg(*(F.sum(x).alias(x) for x in ("n", "total", "squares")), F.max("top").alias("top"))
    mean = F.col("total") / F.col("n")
    return parts.select("same", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean)), 6).alias("sd"), F.round("top", 6).alias("top"), "n")


@query(f"""{CENTERED},
s AS (SELECT round(list_inner_product(q.embedding, c.embedding), 6) AS score FROM v q, v c WHERE q.vec_id % 20 = 0)
SELECT CASE WHEN score < 0 THEN 0 WHEN score >= 0.8 THEN 33 ELSE floor(score / 0.025)::BIGINT + 1 END AS bin, count(*) AS n FROM s GROUP BY 1""")
def vec_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in 32 bins from 0 to 0.8, those below in bin 0 and above in bin 33."""
    c = _centered(spark, sf_dir)
    return dense.tally(c, _tagged(c), dense.bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def _tagged(corpus: DataFrame) -> DataFrame:
    """The query set with its documents."""
    return corpus.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "document", "embedding")


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_DOT} AS ip, {_L2} AS l2 FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, id, 0 AS retriever, row_number() OVER (PARTITION BY query_id ORDER BY ip DESC, id) - 1 AS rank FROM s
      UNION ALL SELECT query_id, id, 1, row_number() OVER (PARTITION BY query_id ORDER BY l2, id) - 1 FROM s),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (100 + rank + 1)) AS score, count(*) AS lists, min(retriever * 1000000 + rank) AS seen FROM r WHERE rank < 100 GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) - 1 AS rank FROM f)
SELECT query_id, id, round(score, 9) AS score, lists, rank FROM t WHERE rank < 32""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of the inner-product and the distance ranking."""
    c = _corpus(spark, sf_dir)
    q = _queries(c)
    wide = fusion.over_fetch(32)
    lists = [dense.search(c, q, wide, metric=m).select(F.lit(i).alias("retriever"), "query_id", "id", "rank") for i, m in enumerate(("ip", "l2"))]
    fused = fusion.reciprocal_rank_fusion(fusion.together(lists), 32)
    return fused.select("query_id", "id", F.round("score", 9).alias("score"), "lists", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label % 4 AS corpus, {_DOT} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus ORDER BY score DESC, id) AS pos FROM s),
r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM p WHERE pos <= {K})
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank < {K}""")
def merge_across_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top lists of four corpora (document modulo 4) merged into one."""
    c = _corpus(spark, sf_dir)
    q = _queries(c)
    parts = [dense.search(c.filter(F.col("document") % 4 == n), q, K) for n in range(4)]
    merged = fusion.merge_corpora(fusion.together([p.select("query_id", "id", "score") for p in parts])).filter(F.col("rank") < K)
    return merged.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised search: codes of the best cells are looked up, a few vectors a query are read; recall against exact search is tested."""
    c = _corpus(spark, sf_dir)
    book = quantized.fit(c)
    return _table(quantized.search(c, quantized.index(c, book), book, _queries(c), K, probes=48, read=100))


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label % 3 AS corpus, {_DOT} AS ip, {_L2} AS l2 FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
p AS (SELECT query_id, id, 0 AS retriever, ip AS score, row_number() OVER (PARTITION BY query_id, corpus ORDER BY ip DESC, id) AS pos FROM s
      UNION ALL SELECT query_id, id, 1, -l2, row_number() OVER (PARTITION BY query_id, corpus ORDER BY l2, id) FROM s),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id, retriever ORDER BY score DESC, id) - 1 AS rank FROM p WHERE pos <= 100),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (100 + rank + 1)) AS score, count(*) AS lists, min(retriever * 1000000 + rank) AS seen FROM m WHERE rank < 100 GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) - 1 AS rank FROM f)
SELECT query_id, id, round(score, 9) AS score, lists, rank FROM t WHERE rank < 32""")
def retrieve_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several retrievers, each over three corpora (document modulo 3): merged over corpora, then fused over retrievers."""
    c = _corpus(spark, sf_dir)
    q, wide = _queries(c), fusion.over_fetch(32)
    lists = {}
    for metric in ("ip", "l2"):
        parts = [dense.search(c.filter(F.col("document") % 3 == n), q, wide, metric=metric).select("query_id", "id", "score") for n in range(3)]
        lists[metric] = fusion.together(parts)
    fused = answer.retrieve(lists, k=32)
    return fused.select("query_id", "id", F.round("score", 9).alias("score"), "lists", F.col("rank").cast("long").alias("rank"))
