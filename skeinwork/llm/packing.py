"""Sequence packing by cutting-stock column generation.

Documents are tokenized, closed by an end id and cut at multiples of the sequence length; what is
left over is a piece shorter than that. Pieces fall into classes by length, ``step`` tokens wide, and
only the histogram of classes (a fixed number of rows) goes to the driver. There a linear program
over patterns (how many pieces of each class share a sequence) is solved by column generation: the
simplex method's prices go to a knapsack, solved by dynamic programming over the capacity, which
yields the next pattern. Pattern counts are rounded down, what remains is packed first-fit by falling
length, and the patterns are dealt to the pieces by their rank within their class: a join on class
and range of ranks with a table of a few hundred rows.

Cases: null and empty texts are the end id alone; repeated rows are packed each by itself; ties in
length are ranked by id, start and place in the input; an empty table gives an empty result; very
long texts are tokenized word run by word run and cut into as many pieces as needed; other columns
are ignored. Null ids are kept.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from skeinwork.llm._shared import CACHES, maybe_broadcast, stage

LENGTH = 2048
END_ID = 1
CACHE_WORDS = 800_000
SPARE_WORDS = 200_000
RANKED = 200_000  # pieces ranked in one task, about


class WordTokens:
    """Ids of white-space separated words, each distinct word tokenized once.

    For tokenizers that fold case, drop white space and never join a letter or digit with the
    punctuation behind it, so that a text's ids are those of its words in order, and a word's those of
    its stem and its closing punctuation. Texts that may hold special tokens are tokenized whole. Up to
    CACHE_WORDS words are held for good, SPARE_WORDS more for a while.
    """

    _TAIL = b".,!#*$%&|<>;:?"
    _held: dict[str, WordTokens] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """The one of this process."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.at: dict[bytes, int] = {}
        self.starts, self.sizes, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1 << 16, np.uint32), 0

    def _put(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, total = len(self.at), self.used + len(ids)
        if n + len(words) > len(self.starts):
            room = 2 * (n + len(words))
            self.starts, self.sizes = np.resize(self.starts, room), np.resize(self.sizes, room)
        if total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * total)
        self.flat[self.used : total] = ids
        self.starts[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(words)] = sizes
        self.at.update(zip(words, range(n, n + len(words))))
        self.used = total

    def _ids(self, k: np.ndarray) -> np.ndarray:
        """Ids of the words at places k, one after the other."""
        sizes = self.sizes[k].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[k] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    @staticmethod
    def _parts(stem: bytes) -> bool:
        """Whether punctuation behind the stem is tokenized by itself."""
        if not stem or stem[-1] < 128:
            return stem[-1:].isalnum()
        return unicodedata.normalize("NFC", stem.decode("utf-8", "surrogatepass")).lower()[-1].isalnum()

    def _learn(self, new: set[bytes]) -> None:
        stems = {w: s for w in new if len(s := w.rstrip(self._TAIL)) < len(w) and self._parts(s)}
        plain = list(new.difference(stems).union(stems.values(), (w[len(s) :] for w, s in stems.items())).difference(self.at))
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in plain], add_special_tokens=False)]
        self._put(plain, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int32, len(found)))
        pairs = np.fromiter((self.at[x] for w, s in stems.items() for x in (s, w[len(s) :])), np.int64, 2 * len(stems))
        self._put(list(stems), self._ids(pairs), self.sizes[pairs].reshape(-1, 2).sum(axis=1, dtype=np.int32))

    def _forget(self) -> None:
        """Let go of the words learned last, down to CACHE_WORDS."""
        for _ in range(len(self.at) - CACHE_WORDS):
            self.at.popitem()
        self.used = int(self.starts[CACHE_WORDS])

    def __call__(self, text: str) -> np.ndarray:
        if "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        words, out = text.encode("utf-8", "surrogatepass").lower().split(), []
        for at in range(0, len(words), 100_000):
            run = words[at : at + 100_000]
            k = np.fromiter(map(self.at.get, run, repeat(-1)), np.int64, len(run))
            if len(missing := np.flatnonzero(k < 0)):
                self._learn({run[i] for i in missing})
                k[missing] = [self.at[run[i]] for i in missing]
            out.append(self._ids(k))
            if len(self.at) > CACHE_WORDS + SPARE_WORDS:
                self._forget()
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


CACHES.append(WordTokens._held)


def cut(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces of every row: key, start, length, ids_crc32, doc_tokens, place, and ids unless told not to."""
    fields = [df.schema[key], *(StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "place"))]
    fields += [StructField("ids", ArrayType(LongType()))] * with_ids
    schema = StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, row = WordTokens.of(tokenizer), 0
        for b in batches:
            rows: list[list] = [[] for _ in fields]
            for k, t in zip(b.column(0), b.column(1)):
                ids = np.append(tokens(t.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    made = [k.as_py(), start, len(part), zlib.crc32(part.tobytes()), len(ids), row]
                    for column, x in zip(rows, made + [part] * with_ids):
                        column.append(x)
                row += 1
            types = [b.column(0).type, *[pa.int64()] * 5, *[pa.list_(pa.int64())] * with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=[f.name for f in fields])

    return df.select(key, text).mapInArrow(run, schema)


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes 1..len(values) within the capacity, by dynamic programming."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = values[: min(c, len(values))] + best[c - 1 :: -1][: len(values)]
        k = int(np.argmax(gain))
        best[c], took[c] = (gain[k], k + 1) if gain[k] > best[c - 1] else (best[c - 1], 0)
    pattern, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def solve(counts: np.ndarray, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, for counts[i] pieces of size i + 1 and capacity len(counts)."""
    m = len(counts)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return []
    # start: sequences of one class each, as many pieces as fit
    basis = [np.eye(m, dtype=np.int64)[i] * (m // (i + 1)) for i in rows]
    inverse = np.diag([1 / (m // (i + 1)) for i in rows])
    x = inverse @ counts[rows]
    for _ in range(rounds):
        prices = np.zeros(m)
        prices[rows] = inverse.sum(axis=0)  # every pattern costs one sequence
        worth, pattern = knapsack(prices, m)
        pattern[counts == 0] = 0  # worth nothing
        if worth <= 1 + 1e-7:
            break
        d = inverse @ pattern[rows]
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        k = int(np.argmin(ratio))
        step = ratio[k]
        x = np.maximum(x - step * d, 0)
        x[k] = step
        inverse[k] /= d[k]
        others = np.arange(len(rows)) != k
        inverse[others] -= np.outer(d[others], inverse[k])
        basis[k] = pattern
    left, plan = counts.astype(np.int64).copy(), []
    for p, times in sorted(zip(basis, np.floor(x + 1e-6).astype(np.int64)), key=lambda q: -q[1]):
        times = min([int(times), *(int(left[i] // p[i]) for i in np.flatnonzero(p))])
        if times > 0:
            plan.append((p, times))
            left -= p * times
    while left.any():  # what rounding left: about a sequence for each class
        p, room = np.zeros(m, np.int64), m
        for i in np.flatnonzero(left)[::-1]:
            p[i] = min(left[i], room // (i + 1))
            room -= p[i] * (i + 1)
        times = max(1, min(int(left[i] // p[i]) for i in np.flatnonzero(p)))
        plan.append((p, times))
        left -= p * times
    return plan


def pack(pieces: DataFrame, key: str = "doc_id", length: int = LENGTH, step: int = 8) -> DataFrame:
    """Append sequence_id, offset and sequence_length to the pieces (columns key, start, length, place)."""
    spark = pieces.sparkSession
    classed = pieces.withColumn("class", F.ceil(F.col("length") / step).cast("int"))
    counts = np.zeros(length // step, np.int64)
    for r in classed.groupBy("class").count().collect():  # length / step rows at most
        counts[r["class"] - 1] = r["count"]
    rows, sequence = [], 0
    ranked = np.zeros(len(counts), np.int64)
    for pattern, times in solve(counts):
        slot = 0
        for i in np.flatnonzero(pattern):
            each = int(pattern[i])
            rows.append((int(i) + 1, int(ranked[i]), int(ranked[i]) + each * times, each, sequence, slot))
            ranked[i] += each * times
            slot += each
        sequence += times
    deal = F.broadcast(spark.createDataFrame(rows, "class int, from_rank long, to_rank long, each int, first_sequence long, slot int"))
    salts = max(1, int(counts.sum()) // RANKED + 1)
    salted = classed.withColumn("salt", F.pmod(F.xxhash64(key, "start", "place"), F.lit(salts)))
    sizes = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("class", "salt", (F.sum("n").over(Window.partitionBy("class").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("class", "salt").orderBy(key, "start", "place")
    numbered = salted.withColumn("rank", F.row_number().over(order) - 1)
    numbered = numbered.join(maybe_broadcast(before, 24), ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "salt")
    dealt = numbered.join(deal, (numbered["class"] == deal["class"]) & (numbered["rank"] >= deal["from_rank"]) & (numbered["rank"] < deal["to_rank"]))
    within = F.col("rank") - F.col("from_rank")
    placed = dealt.select(
        *(numbered[c] for c in pieces.columns),
        (F.col("first_sequence") + F.floor(within / F.col("each"))).alias("sequence_id"),
        (F.col("slot") + F.pmod(within, F.col("each"))).alias("slot"),
    )
    inside = Window.partitionBy("sequence_id")  # `length` pieces at most
    return placed.select(
        *pieces.columns,
        "sequence_id",
        (F.sum("length").over(inside.orderBy("slot")) - F.col("length")).alias("offset"),
        F.sum("length").over(inside).alias("sequence_length"),
    )


def pack_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces of all rows with their place in a sequence; ids stay out, `cut` gives them."""
    return pack(stage(cut(df, tokenizer, key, text, length, with_ids=False), "packing-pieces"), key, length)
