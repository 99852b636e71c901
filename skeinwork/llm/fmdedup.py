"""Repeated word sequences, found by backward search in FM-indexes.

A window is ``width`` consecutive words of a document. Each word covered by a window whose sequence
also starts earlier (smaller key, or the same document and an earlier start) is removed; windows are
judged on the input, so of each repeated sequence the first place stays whole.

Equal windows meet in one shard (see `_repeats`), whose texts are indexed in the order of their first
places: an FM-index with a wavelet matrix over the words of the shard. The documents' fragments are
streamed through it from their last word to their first, all fragments in step: a backward step
extends the match by a word, and when it is longer than the width its last word is dropped, which
leads to the stretch of suffixes that share one word less. That gives the matching statistics cut at
the width, and for each window the stretch of suffixes that start with it; the least place that asked for a
stretch says which windows start earlier. The index is packed: three sixteenths of a byte for each binary digit of a
word's number, and as much for the stretches; no suffix array is kept after its construction.

Cases: a null text has no words; texts shorter than the width lose nothing; of exact copies the one
with the least key is judged as if alone, the others lose all; rows with equal key and text are the
same document twice and are treated alike; null keys come last; an empty table gives an empty
result; other columns pass through `clean_texts` untouched and are ignored by `remove_repeats`. Very
long texts are handled in runs of `_repeats.PART` words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm._repeats import Spec, repeats
from skeinwork.llm._shared import WORD_SPLIT

WIDTH, GRAM = 20, 7


def _symbols(raw: bytes) -> np.ndarray:
    w = raw.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def _cut(raw: bytes) -> Callable[[int, int], bytes]:
    w = raw.split()
    return lambda start, end: b" ".join(w[start:end])


SPEC = Spec("substring", WIDTH, GRAM, _symbols, _cut, 6)


class _Bits:
    """A packed row of bits with the count of ones before each 64-bit word: an eighth and a sixteenth of a byte a bit."""

    _BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)

    def __init__(self, bit: np.ndarray):
        packed = np.packbits(bit, bitorder="little")
        self.words = np.append(packed, np.zeros(8 - len(packed) % 8, np.uint8)).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = at >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & self._BELOW[at & 63])


class WaveletMatrix:
    """Rank queries over a sequence of integers, a packed bit row for each binary digit."""

    def __init__(self, values: np.ndarray):
        self.rows: list[_Bits] = []
        self.zeros: list[int] = []
        top = int(values.max(initial=0))
        self.digits = max(1, top.bit_length())
        for d in range(self.digits - 1, -1, -1):
            bit = (values >> d) & 1 == 1
            self.rows.append(_Bits(bit))
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        every = np.arange(top + 1)
        self.base = self._descend(every, np.zeros_like(every))  # where each symbol starts in the last row

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for d, row, zeros in zip(range(self.digits - 1, -1, -1), self.rows, self.zeros):
            ones = row.rank(at)
            at = np.where((symbol >> d) & 1, ones + zeros, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` values are `symbol`, elementwise."""
        return self._descend(symbol, at) - self.base[symbol]


def _suffixes(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of s sorted by their first `depth` symbols at least, ties by place; and the ranks, equal for equal prefixes of that length."""
    rank, done = np.unique(s, return_inverse=True)[1].reshape(-1).astype(np.int64), 1
    levels = {1: rank}
    while 2 * done <= depth:
        next_ = np.concatenate([rank[done:], np.full(min(done, len(rank)), -1)])[: len(rank)]
        rank = np.unique(rank * (len(rank) + 2) + next_ + 1, return_inverse=True)[1].reshape(-1)
        done *= 2
        levels[done] = rank
    if done < depth:
        shift = depth - done
        next_ = np.concatenate([rank[shift:], np.full(min(shift, len(rank)), -1)])[: len(rank)]
        rank = np.unique(rank * (len(rank) + 2) + next_ + 1, return_inverse=True)[1].reshape(-1)
    return np.argsort(rank, kind="stable"), rank


class FMIndex:
    """Of a sequence of integers from 1 up; 0 parts documents. Matches up to `width` symbols. No suffix array is kept."""

    def __init__(self, s: np.ndarray, width: int):
        self.width = width
        full = np.append(s, 0)
        order, _ = _suffixes(full, width + 1)  # sorted deep enough for every match to be one stretch
        self.bwt = WaveletMatrix(full[order - 1])
        self.less = np.concatenate([[0], np.cumsum(np.bincount(full))])  # symbols below each symbol
        self.size = len(full)
        # stretches of suffixes that share width - 1 symbols: a bit for each start, and the starts
        shared = np.ones(self.size - 1, bool)
        for k in range(width - 1):
            a = full[np.minimum(order + k, self.size - 1)]
            shared &= a[1:] == a[:-1]
        start = np.concatenate([[True], ~shared])
        self.starts, self.first = _Bits(start), np.append(np.flatnonzero(start), self.size).astype(np.int32)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the stretch of suffixes that start with the symbol and then the match."""
        n = len(lo)
        both = np.concatenate([symbol, symbol])
        at = self.less[both] + self.bwt.rank(both, np.concatenate([lo, hi]))
        return at[:n], at[n:]

    def shorten(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Drop the last symbol of a match of full width."""
        run = self.starts.rank(lo + 1)
        return self.first[run - 1], self.first[run]


def word_index(data: list[bytes], marks: np.ndarray, windows: np.ndarray, times: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Mask of the windows of each fragment, at its first place, that start earlier in another fragment or the same."""
    split = [d.split(b" ") for d in data]
    flat = np.fromiter((xxhash.xxh64_intdigest(w) for ws in split for w in ws), np.uint64)
    ids = np.unique(flat, return_inverse=True)[1].reshape(-1).astype(np.int64) + 1
    sizes = np.array([len(ws) for ws in split])
    starts = np.cumsum(np.concatenate([[0], sizes + 1]))[:-1]
    s = np.zeros(int(sizes.sum() + len(sizes)), np.int64)
    own = np.repeat(np.arange(len(sizes)), sizes)
    s[np.arange(len(ids)) + own] = ids  # one zero behind each fragment
    index = FMIndex(s, width)
    order = np.argsort(-sizes, kind="stable")
    lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), index.size, np.int64)
    asked = []
    for k in range(int(sizes.max(initial=0))):  # k words from each end are matched; the longest fragments stand first
        live = order[: int(np.searchsorted(-sizes[order], -k, side="left"))]
        if k >= width:
            lo[live], hi[live] = index.shorten(lo[live])
        at = starts[live] + sizes[live] - 1 - k
        lo[live], hi[live] = index.extend(lo[live], hi[live], s[at])
        if k >= width - 1:
            asked.append((at, lo[live]))
    at, lo = (np.concatenate(c) for c in zip(*asked))
    # stretches of full windows are equal or apart, and every window of the shard has been asked for: the least place of each
    which = np.unique(lo, return_inverse=True)[1].reshape(-1)
    least = np.full(len(lo), len(s), np.int64)
    np.minimum.at(least, which, at)
    earlier = np.zeros(len(s), bool)
    earlier[at[least[which] < at]] = True
    return [earlier[b : b + w] for b, w in zip(starts, windows)]


def _normal(text: Column) -> Column:
    """The words of a text joined by one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_SPLIT, " "))


def _tid(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def repeated_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """tid, least (least key of the text), n_removed, kept (the words left at that key, joined by one space)
    of each distinct text that has a repeat or several rows."""
    rows = df.select(_tid(F.col(f"`{text}`")).alias("tid"), F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # a window has width - 1 spaces at least
    known, found = repeats(rows.filter(F.length("text") >= 2 * WIDTH - 1), SPEC, word_index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, kept = [], []
            spans = b.column(2)
            lows, firsts, masks = (spans.values.field(k) for k in ("lo", "first", "mask"))
            lows, firsts, masks = lows.to_numpy(), firsts.to_numpy(zero_copy_only=False), masks.to_pylist()
            bounds = spans.offsets.to_numpy()
            for t, s, e in zip(b.column(1), bounds[:-1], bounds[1:]):
                w = t.as_py().encode("utf-8", "surrogatepass").split()
                sizes = np.fromiter(map(len, masks[s:e]), np.int64, e - s)
                ends = np.cumsum(sizes)
                at = np.repeat(lows[s:e] - (ends - sizes), sizes) + np.arange(ends[-1])
                # elsewhere than at the fragment's first place all its windows are repeats
                hit = at[np.frombuffer(b"".join(masks[s:e]), np.uint8).astype(bool) | np.repeat(~firsts[s:e], sizes)]
                n = len(w) + 1
                gone = np.cumsum(np.bincount(hit, minlength=n) - np.bincount(hit + WIDTH, minlength=n))[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join(compress(w, (~gone).tolist())).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["tid", "n_removed", "kept"])

    changed = found.select("tid", "text", "spans").mapInArrow(run, "tid binary, n_removed long, kept string")
    every = known.join(changed, "tid", "left")
    return every.filter("copies > 1 OR n_removed IS NOT NULL").select("tid", "least", "n_removed", "kept")


_LAST = (1 << 63) - 1  # a null key counts as the last


def _settled(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """rows (tid, key, n_words, ...) with n_removed, and kept where it differs from the row's own words."""
    later = (F.coalesce(F.col("key").cast("long"), F.lit(_LAST)) > F.col("least")) & (F.col("n_words") >= WIDTH)
    return rows.join(changed, "tid", "left").withColumns(
        {
            "kept": F.when(later, F.lit("")).otherwise(F.col("kept")),
            "n_removed": F.when(later, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))),
        }
    )


def _n_words(normal: Column) -> Column:
    return F.when(normal == "", 0).otherwise(F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) + 1).cast("long")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256 of every row. Texts without repeats are not moved."""
    changed = repeated_words(df, key, text).withColumn("kept", F.sha2(F.col("kept").cast("binary"), 256))
    normal = df.select(F.col(f"`{key}`").alias("key"), _tid(F.col(f"`{text}`")).alias("tid"), _normal(F.col(f"`{text}`")).alias("t"))
    rows = normal.select("key", "tid", _n_words(F.col("t")).alias("n_words"), F.sha2(F.col("t").cast("binary"), 256).alias("whole"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return _settled(rows, changed).select(
        F.col("key").alias(key), "n_words", "n_removed", F.when(F.col("kept") == "", empty).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256")
    )


def clean_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the texts replaced that lose words (by the words left, joined by one space); the others stay as they are."""
    changed = repeated_words(df, key, text)
    normal = _normal(F.col(f"`{text}`"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{key}`").alias("key"), _tid(F.col(f"`{text}`")).alias("tid"), _n_words(normal).alias("n_words"))
    settled = _settled(rows, changed)
    replaced = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row")[text])
    return settled.select(*((replaced if c == text else F.col("row")[c]).alias(c) for c in df.columns))
