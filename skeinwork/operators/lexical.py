"""Lexical retrieval: a stored index of ordinary tables, grown by segments, and BM25 on it.

An index is a folder of Parquet tables, each partitioned by segment:

* postings (term, id, tf, length), within a segment by bucket, a hash of the term, and sorted by term, so that a search opens
  only the folders of its terms' buckets, and in them only the row groups that hold the terms;
* terms (term, bucket, df, cf, top): `top` is the greatest weight that any posting of the term has;
* documents (id, length): every document, also those without a term;
* totals, a row a segment, written last. A segment counts once it has this row: a build that broke off leaves the index as it was,
  and is overwritten by the next one of its number.

Documents are added without touching what is there; `compact` writes all segments as one into a new folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.functions import text as T
from skeinwork.sources import scratch, tables

#: Text -> array of terms; T.tokens, or T.analyzer(...) with stop words and a stemmer, or any other.
Analyze = Callable[[Column], Column]

#: A table of terms is sent to all tasks only if it has no more rows than this.
FEW_TERMS = 200_000

#: So many terms of a question set are also pushed to the scan by name.
NAMED_TERMS = 256

#: Documents that a query's strongest terms name before its k-th score is first bounded, as a multiple of k.
SEEDS = 10

#: Question sets that meet no more postings than this are scored at once; so are questions of more terms than SHORT, whose weak terms add up
#: to so much that hardly a document is ruled out, and those of which the bound would spare less than a half.
AT_ONCE, SHORT = 50_000_000, 12

#: A task sums about so many matches of a question's term and a document.
MATCHES = 1_000_000

#: Postings are written in row groups and read in pieces of about so many bytes, as a task that deals its piece by document holds it unpacked.
PIECE = 16 << 20

TOTALS = "identity string, buckets int, n long, total long, mean double, k1 double, b double, segment int"


def postings(docs: DataFrame, key: str = "id", text: str = "text", analyze: Analyze = T.tokens) -> DataFrame:
    """term, id, tf, length (terms of the document). Terms are counted within their row, so nothing is shuffled.

    A null text has no terms; a document given twice under one id has its postings twice.
    """
    # outer, as for plain inline the optimizer counts every array once more, ahead of it, to leave out empty ones
    return _entries(docs, key, text, analyze).select("id", F.inline_outer("entries"), "length").filter("term is not null").select("term", "id", "tf", "length")


def _entries(docs: DataFrame, key: str, text: str, analyze: Analyze) -> DataFrame:
    """id, length, entries (array of term, tf) of every document."""

    def counted(ts: Column) -> Column:
        n = F.size(ts)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(ts, i - 1) != F.get(ts, i - 2)))

        def runs(all_: Column) -> Column:
            return F.transform(all_, lambda s, k: F.struct(F.get(ts, s - 1).alias("term"), (F.coalesce(F.get(all_, k + 1), n + 1) - s).cast("long").alias("tf")))

        found = F.when(n > 0, F.element_at(F.transform(F.array(starts), runs), 1))
        return F.struct(found.alias("entries"), n.cast("long").alias("length"))

    bound = F.element_at(F.transform(F.array(F.sort_array(analyze(F.coalesce(F.col(text), F.lit(""))))), counted), 1)
    return docs.select(F.col(key).alias("id"), bound.alias("e")).select("id", "e.length", "e.entries")


def lengths(docs: DataFrame, key: str = "id", text: str = "text", analyze: Analyze = T.tokens) -> DataFrame:
    """id, length (terms) of every document."""
    return docs.select(F.col(key).alias("id"), F.size(analyze(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("length"))


@dataclass
class Index:
    """postings (term, id, tf, length, bucket), terms (term, bucket, df, cf, top), documents (id, length), their number and mean length."""

    postings: DataFrame
    terms: DataFrame
    documents: DataFrame
    n: int
    mean: float
    buckets: int
    k1: float
    b: float

    def of_buckets(self, buckets: list[int]) -> Index:
        """The part of the index that holds the terms of some buckets; other folders are not opened."""
        wanted = F.col("bucket").isin(buckets)
        return replace(self, postings=self.postings.filter(wanted), terms=self.terms.filter(wanted))


def index_of_terms(docs: DataFrame, terms: DataFrame, key: str = "id", text: str = "text", analyze: Analyze = T.tokens, k1: float = 0.9, b: float = 0.4) -> Index:
    """What an index of the documents holds of some terms (column term), for one question set: nothing else is written or sorted."""
    size = lengths(docs, key, text, analyze)
    got = size.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
    mean = got["total"] / got["n"] if got["n"] else 0.0
    held = scratch.stage(postings(docs, key, text, analyze).join(_few(terms.select("term").distinct()), "term", "left_semi").withColumn("bucket", F.lit(0)), "lexical-postings", **{"parquet.block.size": PIECE})
    by_term = held.groupBy("term", "bucket").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max(weight(mean, k1, b)).alias("top"))
    return Index(held, by_term, size, got["n"], mean, 1, k1, b)


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def weight(mean: float, k1: float, b: float) -> Column:
    """BM25's weight of a posting, without the term's idf."""
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * (F.col("length") / (mean or 1.0))))


def segments(spark: SparkSession, path: str) -> list:
    """The totals of the segments that are whole."""
    if not tables.exists(spark, f"{path}/totals"):
        return []
    return spark.read.schema(TOTALS).parquet(f"{path}/totals").orderBy("segment").collect()  # a row a segment


def write_index(
    docs: DataFrame, path: str, key: str = "id", text: str = "text", analyze: Analyze = T.tokens, identity: str = "", buckets: int = 64, k1: float = 0.9, b: float = 0.4
) -> None:
    """Build an index in a new folder. `identity` names what it was built from. An index that is there already is an error: build beside it,
    then open the new one."""
    if segments(docs.sparkSession, path):
        raise FileExistsError(f"{path} holds an index: build in a new folder, or add documents to it")
    add_documents(docs, path, 0, key, text, analyze, identity, buckets, k1, b)


def add_documents(
    docs: DataFrame, path: str, segment: int | None = None, key: str = "id", text: str = "text", analyze: Analyze = T.tokens,
    identity: str = "", buckets: int = 64, k1: float = 0.9, b: float = 0.4,
) -> int:
    """Add documents as a segment and give their number. Ids that other segments hold are left out, and of rows with one id the
    shortest is taken, then the one of the least terms, so adding the same documents again adds nothing, and writing a segment again gives the same segment."""
    spark = docs.sparkSession
    whole = segments(spark, path)
    others = [s for s in whole if s["segment"] != segment]
    number = segment if segment is not None else max((s["segment"] for s in whole), default=-1) + 1
    if others:
        buckets, k1, b = others[0]["buckets"], others[0]["k1"], others[0]["b"]
        held = _read(spark, path, "documents", [s["segment"] for s in others], docs.select(F.col(key).alias("id")).schema["id"].dataType.simpleString()).select("id")
        docs = docs.join(held.select(F.col("id").alias(key)), key, "left_anti")
    raw = scratch.fresh(spark, "lexical-entries")
    _entries(docs, key, text, analyze).write.option("compression", "zstd").parquet(raw)
    rows = _one_each(spark.read.parquet(raw))
    got = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
    n, total = got["n"] + sum(s["n"] for s in others), got["total"] + sum(s["total"] for s in others)
    mean = total / n if n else 0.0
    flat = rows.select(F.inline("entries"), "id", "length").withColumn("bucket", bucket(F.col("term"), buckets)).select("term", "id", "tf", "length", "bucket")
    # partitions of the advised size, each of few buckets; one that a frequent term fills is split
    spread = flat.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
    spread.write.partitionBy("bucket").mode("overwrite").options(**{"compression": "zstd", "parquet.block.size": PIECE}).parquet(f"{path}/postings/segment={number}")
    rows.select("id", "length").write.mode("overwrite").parquet(f"{path}/documents/segment={number}")
    stored = _read(spark, path, "postings", [number], rows.schema["id"].dataType.simpleString())
    by_term = stored.groupBy("term", "bucket").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max(weight(mean, k1, b)).alias("top"))
    by_term.sortWithinPartitions("bucket", "term").write.mode("overwrite").parquet(f"{path}/terms/segment={number}")
    scratch.remove(spark, raw)
    done = spark.createDataFrame([(identity, buckets, got["n"], got["total"], mean, k1, b)], TOTALS.rsplit(",", 1)[0])
    done.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals/segment={number}")
    return got["n"]


def _one_each(rows: DataFrame) -> DataFrame:
    """Rows with one row an id. Only ids are shuffled, and the rows of those that stand more than once."""
    again = scratch.stage(rows.groupBy("id").count().filter("count > 1").select("id"), "lexical-again")
    if again.isEmpty():
        return rows
    same = F.col("id").eqNullSafe(F.col("again"))
    known = again.withColumnRenamed("id", "again")
    one = rows.join(known, same, "left_semi").groupBy("id").agg(F.min(F.struct("length", "entries")).alias("e")).select("id", "e.length", "e.entries")
    return rows.join(known, same, "left_anti").unionByName(one)


def _read(spark: SparkSession, path: str, table: str, numbers: list[int], id_type: str) -> DataFrame:
    schema = {
        "postings": f"term string, id {id_type}, tf long, length long, segment int, bucket int",
        "terms": "term string, bucket int, df long, cf long, top double, segment int",
        "documents": f"id {id_type}, length long, segment int",
    }[table]
    return spark.read.schema(schema).parquet(f"{path}/{table}").filter(F.col("segment").isin(numbers))


def open_index(spark: SparkSession, path: str, identity: str | None = None) -> Index:
    """The whole segments of a stored index; with an identity, only if the last one was built from that."""
    whole = segments(spark, path)
    if not whole:
        raise FileNotFoundError(f"{path} holds no whole index: build it with write_index()")
    if identity is not None and whole[-1]["identity"] != identity:
        raise ValueError(f"stale index: built from {whole[-1]['identity']!r}, the corpus is now {identity!r}; build it again")
    numbers, n, total = [s["segment"] for s in whole], sum(s["n"] for s in whole), sum(s["total"] for s in whole)
    mean = total / n if n else 0.0
    id_type = spark.read.parquet(f"{path}/documents/segment={numbers[0]}").schema["id"].dataType.simpleString()
    terms = _read(spark, path, "terms", numbers, id_type)
    if len(whole) > 1:
        # a weight grows with the mean length, at most in proportion
        least = min((s["mean"] for s in whole if s["n"]), default=0.0)
        terms = terms.groupBy("term", "bucket").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), (F.max("top") * max(1.0, mean / (least or 1.0))).alias("top"))
    return Index(
        _read(spark, path, "postings", numbers, id_type).drop("segment"), terms.drop("segment"), _read(spark, path, "documents", numbers, id_type).drop("segment"),
        n, mean, whole[0]["buckets"], whole[0]["k1"], whole[0]["b"],
    )


def compact(spark: SparkSession, path: str, target: str, identity: str = "") -> None:
    """All segments of an index as one, in a new folder; the old one stays as it is."""
    if segments(spark, target):
        raise FileExistsError(f"{target} holds an index")
    old = open_index(spark, path)
    spread = old.postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
    spread.write.partitionBy("bucket").mode("overwrite").options(**{"compression": "zstd", "parquet.block.size": PIECE}).parquet(f"{target}/postings/segment=0")
    old.documents.write.mode("overwrite").parquet(f"{target}/documents/segment=0")
    stored = _read(spark, target, "postings", [0], old.documents.schema["id"].dataType.simpleString())
    by_term = stored.groupBy("term", "bucket").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max(weight(old.mean, old.k1, old.b)).alias("top"))
    by_term.sortWithinPartitions("bucket", "term").write.mode("overwrite").parquet(f"{target}/terms/segment=0")
    total = old.documents.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    done = spark.createDataFrame([(identity, old.buckets, old.n, total, old.mean, old.k1, old.b)], TOTALS.rsplit(",", 1)[0])
    done.coalesce(1).write.mode("overwrite").parquet(f"{target}/totals/segment=0")


def _few(df: DataFrame) -> DataFrame:
    """df, to be sent to all tasks if it was measured to be small."""
    return F.broadcast(df) if df.limit(FEW_TERMS + 1).count() <= FEW_TERMS else df


def narrowed(index: Index, terms: DataFrame) -> Index:
    """The index without the folders, and where the terms (column term) are few the row groups, that hold none of them."""
    asked = terms.select("term").distinct().withColumn("bucket", bucket(F.col("term"), index.buckets))
    part = index.of_buckets([r["bucket"] for r in asked.select("bucket").distinct().collect()])  # `buckets` numbers at most
    named = [r["term"] for r in asked.select("term").limit(NAMED_TERMS + 1).collect()]
    if len(named) > NAMED_TERMS:
        return part
    wanted = F.col("term").isin(named)
    return replace(part, postings=part.postings.filter(wanted), terms=part.terms.filter(wanted))


def bm25(index: Index, queries: DataFrame, k: int = 10, k1: float = 0.9, b: float = 0.4, analyze: Analyze = T.tokens) -> DataFrame:
    """query_id, id, score, rank (from 0) of the best k documents of every query (query_id, query), without scoring all. Ties: least id.

    1. The documents of each query's strongest terms are scored in full; the k-th of them bounds the k-th score from below.
    2. Terms whose greatest weights together stay under that bound cannot bring a document in: only postings of the other terms make
       candidates, and of these only those stay whose score so far and the weak terms' greatest weights reach the bound.
    3. Candidates that are left get their weights of the weak terms, and the best k of each query are taken.

    Small question sets and long questions are scored at once, in a pass over their postings.
    """
    with scratch.pieces(queries.sparkSession, PIECE):
        return scratch.stage(_hits(index, queries, k, k1, b, analyze), "lexical-hits")


def _hits(index: Index, queries: DataFrame, k: int, k1: float, b: float, analyze: Analyze) -> DataFrame:
    asked = queries.select("query_id", F.explode(F.array_distinct(analyze(F.col("query")))).alias("term"))
    part = narrowed(index, asked)
    idf = F.ln(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    top = F.col("top") if (k1, b) == (index.k1, index.b) else F.lit(k1 + 1)  # other parameters: the weight's own limit
    known = scratch.stage(asked.join(part.terms, "term").select("query_id", "term", "df", idf.alias("idf"), (idf * top).alias("most")), "lexical-terms")
    by_strength = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
    scored = weight(index.mean, k1, b) * F.col("idf")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")

    def ranked(scores: DataFrame) -> DataFrame:
        return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)

    def matched(terms: DataFrame) -> DataFrame:
        """query_id, id, score: the weights of `terms` in all documents that have any of them. Postings are dealt by document first, so the
        many more (query, document) pairs are summed where they are made; the tasks are as many as the matches ask for, and none grows with the corpus."""
        return part.postings.repartition(tasks, "id").join(_few(terms.select("query_id", "term", "idf")), "term").groupBy("query_id", "id").agg(F.sum(scored).alias("score"))

    size = Window.partitionBy("query_id")
    known = known.withColumn("short", F.count("*").over(size) <= SHORT)
    met = known.agg(F.sum("df").alias("df"), F.bool_or("short").alias("short")).first()
    tasks = max(-(-(met["df"] or 0) // MATCHES), part.postings.sparkSession.sparkContext.defaultParallelism)
    if (met["df"] or 0) <= AT_ONCE or not met["short"]:
        return ranked(matched(known))
    placed = known.withColumns({"named": F.sum("df").over(by_strength) - F.col("df"), "rest": F.sum("most").over(by_strength.rowsBetween(Window.currentRow, Window.unboundedFollowing))})

    def complete(pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """query_id, id, more: the weights of `terms` in the documents of the pairs."""
        places = pairs.select("query_id", "id").join(terms.select("query_id", "term", "idf"), "query_id")
        met = part.postings.join(places, ["term", "id"]).select("query_id", "id", scored.alias("more"))
        return dealt(met).groupBy("query_id", "id").agg(F.sum("more").alias("more"))

    def dealt(pairs: DataFrame) -> DataFrame:
        return pairs.repartition(tasks, "query_id", "id")

    seeds = placed.filter(F.col("short") & (F.col("named") < SEEDS * k))
    strong = matched(seeds).withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("at") <= 3 * k)
    in_full = complete(strong, known).withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("more"), "id")))
    bounds = in_full.filter(F.col("at") == k).select("query_id", (F.col("more") - 1e-6).alias("bound"))
    needed = F.col("rest") >= F.coalesce("bound", F.lit(0.0))
    spared = F.sum(F.when(~needed, F.col("df")).otherwise(0)).over(size) / F.sum("df").over(size)
    judged = scratch.stage(placed.join(bounds, "query_id", "left").withColumn("weak", ~needed & (spared >= 0.5)), "lexical-bounds")
    limits = judged.groupBy("query_id").agg(F.coalesce(F.max("bound"), F.lit(0.0)).alias("bound"), F.coalesce(F.sum(F.when(F.col("weak"), F.col("most"))), F.lit(0.0)).alias("open"))
    candidates = matched(judged.filter("not weak")).join(_few(limits), "query_id")
    left = scratch.stage(candidates.filter(F.col("score") + F.col("open") >= F.col("bound")).select("query_id", "id", "score"), "lexical-candidates")
    more = complete(left, judged.filter("weak"))
    return ranked(dealt(left).join(more, ["query_id", "id"], "left").select("query_id", "id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")))
