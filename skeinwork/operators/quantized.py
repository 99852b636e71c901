"""Approximate dense retrieval: product-quantised residuals in cells, and exact scores of the few best.

A vector is kept as its cell and one byte for each of `parts` stretches of what the cell's center leaves: the nearest of up to 256
code words of that stretch. A query's score of a vector is about its score of the center and code words that stand for the vector, put
together a tile at a time; only the best of these are read as vectors and scored exactly.

Centers and code words are fitted by k-means on at most `sample` vectors, by hash of the id; every vector is indexed.

Cases: null vectors are not indexed and have no hits; fewer vectors than cells or code words: as many of these as vectors;
an empty corpus: no hits; equal vectors: ties by least id, as in exact search; a zero vector is like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import vectors
from skeinwork.operators import dense


@dataclass(frozen=True)
class Codebook:
    """centers: cells x width; words: for each part its code words; borders: where the parts begin and end."""

    centers: np.ndarray
    words: list[np.ndarray]
    borders: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and codes (vectors x parts)."""
        cells = _nearest(x, self.centers)
        left = x - self.centers[cells]
        codes = [_nearest(left[:, a:z], w) for a, z, w in zip(self.borders, self.borders[1:], self.words)]
        return cells.astype(np.int32), np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What cells and codes stand for: centers and code words."""
        return self.centers[cells] + np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], axis=1)


def _nearest(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *((x[k : k + 8192] @ middle.T * 2 - (middle**2).sum(axis=1)).argmax(axis=1) for k in range(0, len(x), 8192))])


def _kmeans(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    middle = x[rng.permutation(len(x))[:n]]
    for _ in range(rounds):
        near = _nearest(x, middle)
        count = np.bincount(near, minlength=len(middle))
        total = np.zeros_like(middle)
        np.add.at(total, near, x)
        middle = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], middle)
    return middle


def fit(corpus: DataFrame, cells: int = 64, parts: int = 16, words: int = 256, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> Codebook | None:
    """Centers and code words; None if there is no vector."""
    able = corpus.filter(F.col("embedding").isNotNull())
    n = able.count()
    share = min(1.0, 1.2 * sample / max(n, 1))
    some = able.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("embedding").limit(sample).collect()
    if not some:
        return None
    x = np.array([r[0] for r in some], float)
    rng = np.random.default_rng(seed)
    centers = _kmeans(x, min(cells, len(x)), rounds, rng)
    left = x - centers[_nearest(x, centers)]
    borders = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    return Codebook(centers, [_kmeans(left[:, a:z], min(words, 256, len(x)), rounds, rng) for a, z in zip(borders, borders[1:])], borders)


def index(corpus: DataFrame, book: Codebook) -> DataFrame:
    """id, cell, codes (binary, a byte a part) of every vector."""
    shared = corpus.sparkSession.sparkContext.broadcast(book)  # centers and code words, whatever the corpus

    @F.pandas_udf("struct<cell:int,codes:binary>")
    def coded(vs: pd.Series) -> pd.DataFrame:
        cells, codes = shared.value.encode(np.stack(vs.to_numpy()).astype(float))
        return pd.DataFrame({"cell": cells, "codes": [c.tobytes() for c in codes]})

    rows = corpus.filter(F.col("embedding").isNotNull()).select("id", coded("embedding").alias("coded"))
    return rows.select("id", "coded.cell", "coded.codes")


def near(coded: DataFrame, book: Codebook, queries: DataFrame, most: int, probes: int) -> DataFrame:
    """query_id, id, about: for each query the `most` best by the scores of their codes in each tile of these, within its `probes` best cells."""
    shared = coded.sparkSession.sparkContext.broadcast(book)
    id_type, query_type = coded.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def work(q: pd.DataFrame, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, names, block = shared.value, q["query_id"].to_numpy(), np.array(q["embedding"].to_list(), float)
        for pdf in dense.gathered(parts, dense.TILE // 4):
            pdf = pdf.sort_values("id", kind="stable")
            ids, cells = pdf["id"].to_numpy(), pdf["cell"].to_numpy()
            # one matrix product is several times faster than a number looked up for each byte of each pair
            stands = book.decode(cells, np.frombuffer(b"".join(pdf["embedding"]), np.uint8).reshape(len(pdf), -1))
            squares = (stands * stands).sum(axis=1)
            longest = math.sqrt(squares[np.isfinite(squares)].max(initial=0.0))
            made: list[pd.DataFrame] = []
            n = 0
            step = max(min(dense.TILE // len(ids), dense.GIVEN // min(most, len(ids))), 1)
            for at in range(0, len(names), step):
                some = block[at : at + step]
                by_cell = some @ book.centers.T
                limit = np.sort(by_cell, axis=1)[:, -min(probes, by_cell.shape[1])]
                about, slack = dense.products(some, stands, squares, longest, "ip")
                about[~(by_cell >= limit[:, None])[:, cells]] = -np.inf
                rows, columns = dense.best(about, most, slack)
                fit = about[rows, columns] > -np.inf
                rows, columns = rows[fit], columns[fit]
                del about, fit
                rows, columns, score = dense.cut(some, stands, rows, columns, most, "ip")
                made.append(pd.DataFrame({"query_id": names[at + rows], "id": ids[columns], "about": score}))
                n += len(rows)
                if n > dense.GIVEN // 2:
                    yield pd.concat(made)
                    made, n = [], 0
            if n:
                yield pd.concat(made)

    # codes stand where exact search has vectors
    return dense.pairwise(coded.withColumnRenamed("codes", "embedding"), queries.select("query_id", "embedding"), work, f"query_id {query_type}, id {id_type}, about double", most)


def search(corpus: DataFrame, coded: DataFrame, book: Codebook | None, queries: DataFrame, k: int = 8, probes: int = 32, read: int = 100) -> DataFrame:
    """query_id, id, document, score, rank (from 0): the best k by inner product of the `read` vectors that look best by their codes.

    corpus: id, document, embedding. Vectors are read by id for the candidates only.
    """
    exact = F.col("score")
    best = Window.partitionBy("query_id").orderBy(F.desc(exact), "id")
    if book is None:
        types = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
        return corpus.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {types['id']}, document {types['document']}, score double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("about"), "id")
    found = near(coded, book, queries, read, probes).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= read).select("query_id", "id")
    asked = queries.select("query_id", F.col("embedding").alias("q"))
    rows = found.join(corpus.select("id", "document", "embedding"), "id").join(asked, "query_id")
    scored = rows.select("query_id", "id", "document", vectors.dot(F.col("q"), F.col("embedding")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
