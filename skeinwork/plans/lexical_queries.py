"""Queries of lexical retrieval: documents are the corpus, benchmark items the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import text as T
from skeinwork.operators import evaluate, fusion, lexical
from skeinwork.plans import answer
from skeinwork.plans.registry import query, table

_TOKENS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_BM25 = f"""
WITH d AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS ts FROM documents),
tot AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d),
p AS (SELECT id, len(ts) AS length, unnest(ts) AS term FROM d),
tf AS (SELECT term, id, length, count(*) AS tf FROM p GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark),
s AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 1.9::DOUBLE / (tf + 0.9::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * length / mean))) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), tot GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM s)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def asked_index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """What an index of the documents holds of the questions' terms."""
    terms = _questions(spark, sf_dir).select(F.explode(T.tokens(F.col("query"))).alias("term"))
    return lexical.index_of_terms(_docs(spark, sf_dir), terms)


@query(f"{_BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank < 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical.bm25(asked_index(spark, sf_dir), _questions(spark, sf_dir), 10)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (
  SELECT term, id, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY 1, 2) GROUP BY term""")
def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency of every term, from the postings."""
    return lexical.postings(_docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT count(*) AS n, round(avg(l), 6) AS mean, max(l) AS longest FROM (SELECT len({_TOKENS.format('text')}) AS l FROM documents)")
def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lengths(_docs(spark, sf_dir)).agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean"), F.max("length").alias("longest"))


@query(f"""{_BM25}
SELECT query_id, rank, id, source, md5(text) AS text_md5 FROM r JOIN documents d ON d.doc_id = r.id WHERE rank < 10""")
def late_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are joined to the few hits at the end."""
    hits = lexical.bm25(asked_index(spark, sf_dir), _questions(spark, sf_dir), 10)
    texts = fusion.lookup(hits, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text"))
    return texts.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


#: An item's gold documents are those that hold it word for word.
_GOLD = "g AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold(spark: SparkSession, sf_dir: str, index: lexical.Index | None = None) -> DataFrame:
    """query_id, id of documents that hold an item word for word: candidates have the item's rarest inner word in the stored
    postings, then the texts are compared. Items without an inner word are compared with every document."""
    items, docs, index = _questions(spark, sf_dir), _docs(spark, sf_dir), index or asked_index(spark, sf_dir)
    tokens = T.tokens(F.col("query"))
    asked = items.select("query_id", F.explode(F.array_distinct(F.slice(tokens, 2, 1 << 30))).alias("term"), F.try_element_at(tokens, F.lit(-1)).alias("last"))
    inner = asked.filter("term <> last").select("query_id", "term")
    index = lexical.narrowed(index, inner)
    # an inner word that no document has leaves its item without any
    rarest = inner.join(index.terms, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("term"))
    pairs = index.postings.select("term", "id").join(F.broadcast(rarest) if items.count() <= lexical.FEW_TERMS else rarest, "term").select("query_id", "id")
    found = docs.join(pairs.join(items, "query_id"), "id").filter(F.contains("text", "query")).select("query_id", "id")
    short = items.filter(F.size(F.array_remove(F.slice(tokens, 2, 1 << 30), F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit("")))) == 0)
    if short.isEmpty():
        return found
    return found.unionByName(short.join(docs, F.contains("text", "query")).select("query_id", "id"))


@query(f"""{_BM25}, {_GOLD},
h AS (SELECT g.*, r.rank FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.id = g.id AND r.rank < 8)
SELECT round(avg(CASE WHEN rank < 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank < 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3,
       round(avg(CASE WHEN rank < 8 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_8, round(avg(coalesce(1.0::DOUBLE / (rank + 1), 0)), 6) AS mrr, count(*) AS n FROM h""")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = asked_index(spark, sf_dir)
    hits = lexical.bm25(index, _questions(spark, sf_dir), 8)
    m = evaluate.recall_and_mrr(evaluate.first_ranks(gold(spark, sf_dir, index), hits))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns if c != "n"), "n")


@query(f"""{_BM25}, {_GOLD},
h AS (SELECT b.item_id AS query_id, r.rank, g.id IS NOT NULL AS rel FROM benchmark b LEFT JOIN r ON r.query_id = b.item_id AND r.rank < 8 LEFT JOIN g ON g.query_id = r.query_id AND g.id = r.id),
w AS (SELECT query_id, rel, avg(rel::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS p FROM h)
SELECT query_id, round(coalesce(avg(CASE WHEN rel THEN p END), 0), 6) AS precision, max(rel::INT)::DOUBLE AS recall FROM w GROUP BY query_id""")
def context_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = asked_index(spark, sf_dir)
    hits = lexical.bm25(index, _questions(spark, sf_dir), 8).select("query_id", "id", "rank")
    rows = _questions(spark, sf_dir).select("query_id").join(hits, "query_id", "left").join(gold(spark, sf_dir, index).withColumn("relevant", F.lit(True)), ["query_id", "id"], "left")
    return evaluate.context_metrics(rows).select("query_id", F.round("precision", 6).alias("precision"), "recall")


@query(f"""{_BM25}, {_GOLD},
m AS (SELECT query_id, max(round(score, 6)) AS top FROM r GROUP BY 1)
SELECT item_id AS query_id, item_id IN (SELECT query_id FROM g) AS present, coalesce(top, 0) >= 20 AS found FROM benchmark LEFT JOIN m ON query_id = item_id""")
def off_corpus_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with and without a hit at the floor, beside whether the corpus holds them."""
    index = asked_index(spark, sf_dir)
    top = lexical.bm25(index, _questions(spark, sf_dir), 1).select("query_id", F.round("score", 6).alias("top"))
    present = gold(spark, sf_dir, index).select("query_id").distinct().withColumn("present", F.lit(True))
    rows = _questions(spark, sf_dir).join(top, "query_id", "left").join(present, "query_id", "left")
    return rows.select("query_id", F.coalesce("present", F.lit(False)).alias("present"), (F.coalesce("top", F.lit(0.0)) >= 20).alias("found"))


_SCORES = f"""{_BM25}, {_GOLD},
m AS (SELECT item_id AS query_id, coalesce(max(round(score, 6)), 0) AS score, item_id IN (SELECT query_id FROM g) AS positive FROM benchmark LEFT JOIN r ON query_id = item_id GROUP BY item_id)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = asked_index(spark, sf_dir)
    top = lexical.bm25(index, _questions(spark, sf_dir), 1).select("query_id", F.round("score", 6).alias("score"))
    present = gold(spark, sf_dir, index).select("query_id").distinct().withColumn("positive", F.lit(True))
    rows = _questions(spark, sf_dir).select("query_id").join(top, "query_id", "left").join(present, "query_id", "left")
    return rows.select(F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("positive", F.lit(False)).alias("positive"))


@query(f"""{_SCORES}
SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM m a, m b WHERE a.positive AND NOT b.positive""")
def auc_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.auc(_scores(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@query(f"""{_SCORES},
t AS (SELECT DISTINCT score AS threshold FROM m),
a AS (SELECT threshold, avg(CASE WHEN (score >= threshold) = positive THEN 1.0 ELSE 0.0 END) AS accuracy FROM t, m GROUP BY 1)
SELECT threshold, round(accuracy, 6) AS accuracy FROM a ORDER BY accuracy DESC, threshold LIMIT 1""")
def calibrate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_threshold(_scores(spark, sf_dir)).select("threshold", F.round("accuracy", 6).alias("accuracy"))


@query(f"""
WITH d AS (SELECT doc_id AS id, doc_id % 2 AS c, {_TOKENS.format('text')} AS ts FROM documents),
tot AS (SELECT c, count(*) AS n, avg(len(ts)) AS mean FROM d GROUP BY c),
p AS (SELECT id, c, len(ts) AS length, unnest(ts) AS term FROM d),
tf AS (SELECT term, id, c, length, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, c, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark),
s AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 1.9::DOUBLE / (tf + 0.9::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * length / mean))) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term, c) JOIN tot USING (c) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, rank, source, lang FROM r JOIN documents ON doc_id = id WHERE rank < 8""")
def find_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From question texts to results in one call, over two corpora with an index each (documents of even and odd number)."""
    terms = _questions(spark, sf_dir).select(F.explode(T.tokens(F.col("query"))).alias("term"))
    indexes = [lexical.index_of_terms(_docs(spark, sf_dir).filter(F.col("id") % 2 == n), terms) for n in range(2)]
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    got = answer.find(_questions(spark, sf_dir), {"words": answer.lexical_retriever(indexes)}, texts, 8)
    return got.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "source", "lang")
