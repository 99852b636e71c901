"""Exact dense retrieval: one scan of the corpus for all queries, local top lists, one final ranking.

Matrices of scores are made a tile of at most TILE numbers at a time, so a task's memory does not grow with queries or corpus.

`quantized` has the approximate search.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import vectors

#: Query vectors are sent to all tasks if they have no more numbers than this.
BLOCK_NUMBERS = 2_000_000

#: Where there are more, the corpus is dealt to blocks of about so many numbers. Tasks also gather so many before they score.
CORPUS_NUMBERS = 4_000_000

#: A task makes at most about so many scores at once, and gives its rows in tables of at most about so many.
TILE, GIVEN = 2_000_000, 500_000

#: Queries and batches of the corpus to rows.
Work = Callable[[pd.DataFrame, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

METRICS = ("ip", "cosine", "l2")


def centered(df: DataFrame, center: DataFrame, column: str = "embedding") -> DataFrame:
    """df with the column moved by the center (a table of one row, `center`) and brought to unit length."""
    row = center.first()  # one vector
    if row is None or row["center"] is None:
        return df.withColumn(column, vectors.normalize(F.col(column)))
    middle = F.array(*map(F.lit, row["center"]))
    return df.withColumn(column, vectors.normalize(vectors.subtract(F.col(column), middle)))


def scores(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """Scores, higher is better; squared distances are negated."""
    if metric == "l2":
        return -np.stack([((corpus - q) ** 2).sum(axis=1) for q in queries])
    if metric == "cosine":
        queries, corpus = ((m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)) for m in (queries, corpus))
    return queries @ corpus.T


def pairwise(corpus: DataFrame, queries: DataFrame, work: Work, schema: str, given: int = 1) -> DataFrame:
    """Rows that `work` makes of all queries and all rows of the corpus; every pair is seen once.

    A question set of at most BLOCK_NUMBERS numbers goes to all tasks, and the corpus is read where it lies. A larger one is
    dealt to blocks by hash, the corpus too, and each pair of blocks meets in a task by a shuffle: nothing passes through the
    driver, the corpus is scanned once, and the plan does not grow with the queries.
    Both have a column embedding; rows without one are left out. `given` is how many rows of a query work gives for a tile: blocks
    keep to about 2 * GIVEN of them.
    """
    queries, corpus = (df.filter(F.col("embedding").isNotNull()) for df in (queries, corpus))
    first = queries.select(F.size("embedding")).first()
    if first is None:
        return corpus.sparkSession.createDataFrame([], schema)
    width = max(first[0], 1)
    most = max(BLOCK_NUMBERS // width, 1)
    rows = queries.limit(most + 1).collect()  # bounded by BLOCK_NUMBERS
    if len(rows) <= most:
        few = pd.DataFrame(rows, columns=queries.columns)
        few["embedding"] = [np.array(v, float) for v in few["embedding"]]  # lists of numbers take four times the room
        shared = corpus.sparkSession.sparkContext.broadcast(few)
        del rows

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from work(shared.value, parts)

        return numbers(corpus.mapInPandas(run, schema))
    left, right = -(-queries.count() // max(min(most, 2 * GIVEN // given), 1)), -(-corpus.count() * width // CORPUS_NUMBERS)
    asked = queries.withColumns({"__left": F.pmod(F.xxhash64("query_id"), F.lit(left)), "__right": F.explode(F.sequence(F.lit(0), F.lit(max(right, 1) - 1)).cast("array<long>"))})
    held = corpus.withColumns({"__right": F.pmod(F.xxhash64("id", "embedding"), F.lit(max(right, 1))), "__left": F.explode(F.sequence(F.lit(0), F.lit(left - 1)).cast("array<long>"))})

    names, own = [f.split()[0] for f in schema.split(",")], queries.columns
    # queries may be rows of the corpus: their columns get names of their own
    asked = asked.select(F.col("__left").alias("a"), F.col("__right").alias("b"), *(F.col(c).alias(f"q_{c}") for c in own))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        q = q.rename(columns={f"q_{c}": c for c in own})
        made = list(work(q, iter([c]))) if len(q) and len(c) else []
        return pd.concat(made) if made else pd.DataFrame(columns=names)

    return numbers(asked.groupBy("a", "b").cogroup(held.groupBy("__left", "__right")).applyInPandas(meet, schema))


def numbers(df: DataFrame) -> DataFrame:
    """df as pandas made it: what is no number comes back as null."""
    return df.withColumns({f.name: F.coalesce(f.name, F.lit(float("nan"))) for f in df.schema.fields if f.dataType.simpleString() == "double"})


def gathered(parts: Iterator[pd.DataFrame], numbers: int) -> Iterator[pd.DataFrame]:
    """Batches joined to tables of about `numbers` numbers in column embedding, and cut to these where they are larger."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in parts:
        if not len(pdf):
            continue
        step = max(numbers // max(len(pdf["embedding"].iloc[0]), 1), 1)
        for at in range(0, len(pdf), step):
            piece = pdf.iloc[at : at + step]
            if held and n + len(piece) > step:
                yield pd.concat(held)
                held, n = [], 0
            held.append(piece)
            n += len(piece)
    if held:
        yield pd.concat(held)


def best(about: np.ndarray, most: int, slack: float | np.ndarray = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's `most` greatest numbers, with others that may stand beside them: all that are no more than `slack`
    below the last of the `most`, and a few below these.

    Only the greatest of each group of columns are put in order: the last of the `most` among these is no greater than that of all columns.
    """
    n = about.shape[1]
    if n <= most:
        return np.nonzero(np.ones(about.shape, bool))
    groups = max(n // max(n // (4 * most), 1), most)
    tops = about[:, : n // groups * groups].reshape(len(about), -1, groups).max(axis=1)
    last = np.partition(tops, groups - most, axis=1)[:, groups - most]
    rows, columns = np.divmod(np.flatnonzero(about >= (last - slack)[:, None]), n)
    return rows, columns


def capped(about: np.ndarray, codes: np.ndarray, most: int, cap: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`best` where at most `cap` columns of a document count; `codes` are the columns' documents, 0 and up, ascending.

    Each document's greatest number counts, so the last of the `most` among these is no greater than the row's. Of what reaches it each
    document's greatest are taken out `cap` times, equal ones together, and what is below the last is left out.
    """
    n, found = about.shape[1], []
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    step = max(TILE // (8 * n), 1)
    for at in range(0, len(about), step):
        some, room = about[at : at + step], slack[at : at + step]
        tops = np.maximum.reduceat(some, starts, axis=1)
        bar = np.partition(tops, -most, axis=1)[:, -most] if len(starts) >= most else np.full(len(some), -np.inf)
        flat = np.flatnonzero(some >= (bar - room)[:, None])
        rows, columns = np.divmod(flat, n)
        groups = rows * len(starts) + codes[columns]
        begins = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        sizes = np.diff(np.r_[begins, len(groups)])
        left = some.ravel()[flat]
        for _ in range(cap):
            last = np.repeat(np.maximum.reduceat(left, begins), sizes)
            left[left == last] = -np.inf
        keep = some.ravel()[flat] >= last - room[rows]
        found.append((at + rows[keep], columns[keep]))
    return tuple(map(np.concatenate, zip(*found)))


def candidates(corpus: DataFrame, queries: DataFrame, most: int, metric: str = "ip", within: bool = False, per_document: int | None = None) -> DataFrame:
    """query_id, id, document, score: for each query the `most` best of each tile of the corpus, a superset of the best of all.

    With `per_document` they are the best of which no more than so many share a document. A row that is among the `most` of the whole
    corpus under this cap is among those of its tile: of each document no more rows that count stand before it there.

    corpus: id, document, embedding; queries: query_id, embedding. Ties: least id. Null embeddings are nobody's hit and have none.
    With `within` only vectors of the query's document (queries have a column document too), other than itself, are hits.

    A matrix product names the candidates; those near its last place are scored again one by one, as a product's last bits
    differ with the place in the matrix, and equal vectors have to tie.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    fields = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
    query_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, id {fields['id']}, document {fields['document']}, score double"
    cap = per_document if per_document is not None and per_document < most else None  # a larger one never binds

    def work(q: pd.DataFrame, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, block = q["query_id"].to_numpy(), _prepared(np.array(q["embedding"].to_list(), float), metric)
        places = q["document"].to_numpy() if within else None
        for pdf in gathered(parts, CORPUS_NUMBERS):
            pdf = pdf.sort_values("id", kind="stable")
            if cap is not None:
                codes = pd.factorize(pdf["document"], use_na_sentinel=False)[0]
                order = np.argsort(codes, kind="stable")  # by document; a column's number here is its place by id
                pdf, codes = pdf.iloc[order], codes[order]
            ids, documents = pdf["id"].to_numpy(), pdf["document"].to_numpy()
            vecs = _prepared(np.stack(pdf["embedding"].to_numpy()).astype(float), metric)
            del pdf
            squares = (vecs * vecs).sum(axis=1)
            longest = math.sqrt(squares[np.isfinite(squares)].max(initial=0.0))
            step = max(min(TILE // len(ids), GIVEN // min(most, len(ids))), 1)
            made: list[pd.DataFrame] = []
            n = 0
            for at in range(0, len(names), step):
                some = block[at : at + step]
                about, slack = products(some, vecs, squares, longest, metric)
                if within:
                    about[(places[at : at + step, None] != documents[None, :]) | (names[at : at + step, None] == ids[None, :])] = -np.inf
                rows, columns = best(about, most, slack) if cap is None else capped(about, codes, most, cap, slack)
                if within:
                    fit = about[rows, columns] > -np.inf
                    rows, columns = rows[fit], columns[fit]
                del about
                if cap is None:
                    rows, columns, score = cut(some, vecs, rows, columns, most, metric)
                else:
                    score = exact(some, vecs, rows, columns, metric)
                    keep = np.sort(first(rows * (codes[-1] + 1) + codes[columns], order[columns], score, cap))
                    rows, columns, score = rows[keep], columns[keep], score[keep]
                    keep = first(rows, order[columns], score, most)
                    rows, columns, score = rows[keep], columns[keep], score[keep]
                made.append(pd.DataFrame({"query_id": names[at + rows], "id": ids[columns], "document": documents[columns], "score": score}))
                n += len(rows)
                if n > GIVEN // 2:
                    yield pd.concat(made)
                    made, n = [], 0
            if n:
                yield pd.concat(made)

    asked = queries.select("query_id", "document", "embedding") if within else queries.select("query_id", "embedding")
    return pairwise(corpus.select("id", "document", "embedding"), asked, work, schema, most)


def _prepared(m: np.ndarray, metric: str) -> np.ndarray:
    """Vectors whose inner product (or distance) is the score."""
    if metric != "cosine":
        return m
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def products(queries: np.ndarray, vecs: np.ndarray, squares: np.ndarray, longest: float, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the order of the scores, and by how much they may be wrong. A score that is no number is the greatest, as in Spark's order."""
    about, length = queries @ vecs.T, np.sqrt((queries * queries).sum(axis=1))
    if metric == "l2":  # the query's own square is the same for all
        about = 2 * about - squares
    slack = 1e-12 * (length + longest) ** 2
    about[np.isnan(about)] = np.inf
    return about, np.where(np.isfinite(slack), slack, 0.0)


def cut(queries: np.ndarray, vecs: np.ndarray, rows: np.ndarray, columns: np.ndarray, most: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of named pairs, by row, the `most` best of each row (columns are in the order of ids), with their scores."""
    score = exact(queries, vecs, rows, columns, metric)
    keep = first(rows, columns, score, most)
    return rows[keep], columns[keep], score[keep]


def exact(queries: np.ndarray, vecs: np.ndarray, rows: np.ndarray, columns: np.ndarray, metric: str) -> np.ndarray:
    """Scores of named pairs, one by one."""
    score = np.empty(len(rows))
    step = max(TILE // max(vecs.shape[1], 1), 1)
    for a in range(0, len(rows), step):
        x, y = queries[rows[a : a + step]], vecs[columns[a : a + step]]
        score[a : a + step] = -((y - x) ** 2).sum(axis=1) if metric == "l2" else (x * y).sum(axis=1)
    return score


def first(rows: np.ndarray, columns: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best of each row; rows are ascending, ties go to the least column."""
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    order = np.lexsort((columns, np.where(np.isnan(score), -np.inf, -score), rows))
    return order[np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)])) < most]


def over_fetch(k: int, per_document: int | None) -> int:
    """How many of a query's best rows a bounded search with a cap looks at; k without a cap."""
    return max(4 * k * max(per_document, 1), k) if per_document is not None else k


def search(
    corpus: DataFrame, queries: DataFrame, k: int = 8, floor: float | None = None, per_document: int | None = None, metric: str = "ip", among: int | None = None
) -> DataFrame:
    """query_id, id, document, score, rank (from 0): score floor, then cap per document, then the best k.

    The floor and the cap see all rows of the corpus, or with `among` only so many of a query's best, as a bounded over-fetch gives.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    if per_document is None or among is not None:
        wide = k if among is None else among
        # each task ranks its own rows before they are shuffled
        rows = candidates(corpus, queries, wide, metric).withColumn("__at", F.row_number().over(order)).filter(F.col("__at") <= wide)
    else:
        rows = candidates(corpus, queries, k, metric, per_document=max(per_document, 1)).repartition("query_id")  # both windows lie in it
    if floor is not None:
        rows = rows.filter(F.col("score") >= floor)
    if per_document is not None:
        inside = Window.partitionBy("query_id", "document").orderBy(F.desc("score"), "id")
        rows = rows.withColumn("__in", F.row_number().over(inside)).filter(F.col("__in") <= per_document)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1).select("query_id", "id", "document", "score", "rank")


def tally(corpus: DataFrame, queries: DataFrame, count: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str, metric: str = "ip") -> DataFrame:
    """Rows of `count` (scores, whether query and vector share their document; matrices of queries by vectors) for each tile of
    corpus and queries: every pair is seen once, and a few rows a tile are all that leaves a task.

    corpus: id, document, embedding; queries: query_id, document, embedding.
    """

    def work(q: pd.DataFrame, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        documents, block = q["document"].to_numpy(), np.array(q["embedding"].to_list(), float)
        for pdf in gathered(parts, min(CORPUS_NUMBERS, TILE)):
            places, vecs = pdf["document"].to_numpy(), np.stack(pdf["embedding"].to_numpy()).astype(float)
            step = max(TILE // len(places), 1)
            for at in range(0, len(block), step):
                yield count(scores(block[at : at + step], vecs, metric), documents[at : at + step, None] == places[None, :])

    return pairwise(corpus.select("id", "document", "embedding"), queries.select("query_id", "document", "embedding"), work, schema)


def moments(s: np.ndarray, same: np.ndarray) -> pd.DataFrame:
    """same, n, total, squares, top of scores, for pairs with and without a document in common."""
    kinds = [(bool(k), s[same == k]) for k in (False, True)]
    return pd.DataFrame([(k, len(x), x.sum(), (x * x).sum(), x.max()) for k, x in kinds if len(x)], columns=["same", "n", "total", "squares", "top"])


def bins(s: np.ndarray, same: np.ndarray) -> pd.DataFrame:
    """bin, n of scores rounded to six places: 32 bins from 0 to 0.8, those below in bin 0 and above in bin 33.

    Rows are binned one by one, so that no copy of the matrix is made.
    """
    n = np.zeros(34, int)
    for row in s:
        x = row.round(6)
        x /= 0.025
        np.floor(x, out=x)
        x += 1
        np.clip(x, 0, 33, out=x)
        n += np.bincount(x.astype(int), minlength=34)
    return pd.DataFrame({"bin": np.flatnonzero(n), "n": n[n > 0]})


def max_scores(corpus: DataFrame, queries: DataFrame, metric: str = "ip") -> DataFrame:
    """query_id, score: the best score of each query whatever the filters; 0 without a corpus."""
    top = candidates(corpus, queries, 1, metric).groupBy("query_id").agg(F.max("score").alias("score"))
    return queries.select("query_id").join(top, "query_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
