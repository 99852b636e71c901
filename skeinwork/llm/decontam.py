"""Benchmark decontamination by the q-gram lemma.

A document is contaminated by an item if a stretch of it can be turned into the whole item by at most
e edits of single characters, e being `rate` of the item's length (less for items so short that the
lemma would say nothing). Both are compared in lower case with white space as single spaces.

An item of m characters and such a stretch share at least m - q + 1 - q * e q-grams, and those lie
within 2e + 1 neighbouring diagonals (place in document less place in item). Shared q-grams are
counted by item and diagonal band; bands are twice as wide as their distance, so one of them holds all
of them. Bands that reach the bound are aligned: edit distance within the band, free ends in the
document. Items that share a passage with many others, such as a fixed opening, reach the bound wherever that passage
stands; so all candidate bands are first held against a lower bound together: an item's disjoint pieces of PIECE
characters, rarest first, each have a least edit distance in the band (bit-parallel, an array operation over all candidates),
and a candidate goes as soon as their sum exceeds its edits. The items' q-grams are sent to all tasks in blocks of at most
BLOCK characters of items, so what is sent is bounded whatever the size of the benchmark; each block is one pass over
the documents. A run with over HITS shared q-grams is cut in two, or else its items are taken in groups.

Cases: null texts are empty and clean; null or empty items, and those of fewer than q characters,
contaminate nothing; equal items are each reported; of several stretches for one item that overlap the
closest is reported, the first of equals; repeated rows are judged alike; empty tables: an empty
result, or no contamination. Other columns pass through `annotate` untouched, but one with the name of the new column is
replaced. Texts are read whole, very long ones in overlapping runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from skeinwork.llm._shared import spare_name, stage

Q = 8
RATE = 0.1
BLOCK = 1 << 22
RUN = 1 << 20
HITS = 1 << 22
PIECE = 64
_MUL = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def edits_allowed(m: int, q: int = Q, rate: float = RATE) -> int:
    """Most edits for an item of m characters, such that the lemma asks for one q-gram at least."""
    return min(int(rate * m), (m - q) // q)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_codes(c: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit codes of the q-grams; q is a power of two."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    h, n, mul = c.astype(np.uint64) + np.uint64(1), 1, _MUL
    while n < q:
        h = h[:-n] * mul + h[n:]
        h ^= h >> np.uint64(29)
        n, mul = 2 * n, np.uint64((int(mul) * int(_MUL) + 2) % (1 << 64))
    return h * _MUL


@dataclass
class Items:
    """q-gram index of a block of items."""

    ids: list
    texts: list[np.ndarray]
    table: np.ndarray  # by the top 20 bits of a code: whether any item has one of those
    codes: np.ndarray  # sorted, distinct
    first: np.ndarray  # of a code: its first posting; one more at the end
    item: np.ndarray
    place: np.ndarray
    pieces: dict[int, np.ndarray] = field(default_factory=dict)  # of an item: the starts of its pieces, rarest first

    def __post_init__(self) -> None:
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.sizes = sizes
        self.allowed = np.minimum((RATE * sizes).astype(np.int64), (sizes - Q) // Q)
        self.bound = sizes - Q + 1 - Q * self.allowed

    @property
    def longest(self) -> int:
        return int(self.sizes.max(initial=0))

    def rarest(self, j: int) -> np.ndarray:
        if j not in self.pieces:
            codes, m = gram_codes(self.texts[j]), len(self.texts[j])
            k = np.searchsorted(self.codes, codes)
            often = self.first[k + 1] - self.first[k]
            starts = np.arange(0, max(m - PIECE, 0) + 1, PIECE)
            starts += (m - PIECE) % PIECE if m > PIECE else 0  # to the item's end; what is left over is in front
            self.pieces[j] = starts[np.argsort([np.minimum(often[s : s + PIECE], 1000).mean() for s in starts], kind="stable")]
        return self.pieces[j]


def index_items(items: list[tuple[object, str]]) -> Items:
    kept = [(i, points(t)) for i, t in items if len(t) >= Q]
    codes = [gram_codes(t) for _, t in kept]
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    distinct, first = np.unique(flat[order], return_index=True)
    table = np.zeros(1 << 20, bool)
    table[(distinct >> np.uint64(44)).astype(np.int64)] = True
    item = np.repeat(np.arange(len(kept)), [len(c) for c in codes]) if codes else np.zeros(0, np.int64)
    place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
    return Items([i for i, _ in kept], [t for _, t in kept], table, distinct, np.append(first, len(flat)).astype(np.int32), item[order].astype(np.int32), place[order].astype(np.int32))


def _piece_distances(patterns: list[np.ndarray], which: np.ndarray, c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each asked pattern (`which`; at most 64 characters) its least edit distance to any stretch of c[start:end], or a little less.

    Myers' bit vectors, one word for each; characters are told apart modulo 128, which can only lower a distance.
    """
    n = len(which)
    size = np.array([len(x) for x in patterns])
    eq = np.zeros((len(patterns), 129), np.uint64)
    letters = np.zeros((len(patterns), PIECE), np.int64)
    for row, x in zip(letters, patterns):
        row[: len(x)] = x & 127
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        eq[has, letters[has, k]] |= np.uint64(1) << np.uint64(k)
    eq, rows, size = eq.reshape(-1), which * 129, size[which]
    folded = np.append((c & 127).astype(np.int64), 128)
    top, one = (size - 1).astype(np.uint64), np.uint64(1)
    pv, mv, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), size.astype(np.int64)
    best = score.copy()
    for t in range(int((end - start).max(initial=0))):
        at = start + t
        e = eq[rows + folded[np.where(at < end, at, len(c))]]
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv), pv & xh
        score += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
        np.minimum(best, score, out=best)
    return best


def plausible(c: np.ndarray, items: Items, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of candidates (item, lowest and highest diagonal) those that the sum of their pieces' least distances does not rule out."""
    left, spent, p, done = np.arange(len(item)), np.zeros(len(item), np.int64), 0, []
    while len(left):
        asked, which = np.unique(item[left], return_inverse=True)
        more = np.array([len(items.rarest(int(j))) > p for j in asked])[which]
        done.append(left[~more])
        left = left[more]
        for at in range(0, len(left), 1 << 14):
            some = left[at : at + (1 << 14)]
            asked, which = np.unique(item[some], return_inverse=True)
            starts = np.array([items.rarest(int(j))[p] for j in asked], np.int64)
            patterns = [items.texts[j][s : s + PIECE] for j, s in zip(asked, starts)]
            # a piece stands on the item's diagonals, or off them by as many as its edits
            e, first = items.allowed[item[some]], starts[which]
            begin, end = np.clip(first + low[some] - e, 0, len(c)), np.clip(first + high[some] + PIECE + e, 0, len(c))
            spent[some] += _piece_distances(patterns, which, c, begin, end)
        left = left[spent[left] <= items.allowed[item[left]]]
        p += 1
    return np.sort(np.concatenate(done)) if done else left


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """edits, start, end of the closest stretch of text, on diagonals low to high; None if over most.

    Ends in the text are free; of equals the first end counts, and its latest start.
    """
    width, far = high - low + 1, 1 << 30
    col = np.arange(width)
    # cell (i, k): i characters of the item against the text up to i + low + k; its value holds edits and start
    reach = low + col
    value = np.where((reach >= 0) & (reach <= len(text)), np.int64(0), np.int64(far)) * (1 << 32) + ((1 << 31) - np.clip(reach, 0, len(text)))
    one = np.int64(1 << 32)
    for i in range(1, len(item) + 1):
        at = i + low + col  # text characters used
        ok = (at >= 1) & (at <= len(text))
        same = np.zeros(width, bool)
        same[ok] = text[at[ok] - 1] == item[i - 1]
        step = np.where(ok, value + np.where(same, 0, one), np.int64(far) * one)
        skip = np.append(value[1:], np.int64(far) * one) + one  # an item's character is missing in the text
        value = np.minimum(step, skip)
        value = np.minimum.accumulate(value - col * one) + col * one  # the text has a character more
        value = np.where((at >= 0) & (at <= len(text)), value, np.int64(far) * one)
    k = int(np.argmin(value >> 32))
    edits = int(value[k] >> 32)
    if edits > most:
        return None
    return edits, (1 << 31) - int(value[k] & 0xFFFFFFFF), len(item) + low + k


def find(text: str, items: Items) -> list[tuple[int, int, int, int]]:
    """(item's place in the block, start, end, edits) of each stretch of a normalised text that is close to an item."""
    found: dict[tuple[int, int, int], int] = {}
    overlap = 2 * items.longest + 64
    for at in range(0, max(1, len(text)), RUN):
        c = points(text[at : at + RUN + overlap])
        for k, s, e, d in _find(c, items):
            found[(k, at + s, at + e)] = d
    out: list[tuple[int, int, int, int]] = []
    last: dict[int, list[tuple[int, int]]] = {}
    for (k, s, e), d in sorted(found.items(), key=lambda f: (f[0][0], f[1], f[0][1])):
        if not any(s < o[1] and o[0] < e for o in last.get(k, ())):
            out.append((k, s, e, d))
            last.setdefault(k, []).append((s, e))
    return sorted(out)


def _find(c: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int]]:
    codes = gram_codes(c)
    where = np.flatnonzero(items.table[(codes >> np.uint64(44)).astype(np.int64)])
    if not len(where):
        return
    code = codes[where]
    k = np.searchsorted(items.codes, code)
    k[k == len(items.codes)] = 0
    hit = items.codes[k] == code
    where, k = where[hit], k[hit]
    if not len(k):
        return
    # cheap first: items that have enough of their q-grams anywhere in the run
    order = np.argsort(k, kind="stable")
    where, (held, begin, times) = where[order], np.unique(k[order], return_index=True, return_counts=True)
    n = (items.first[held + 1] - items.first[held]).astype(np.int64)
    post = np.repeat(items.first[held] - np.cumsum(n) + n, n) + np.arange(n.sum())
    item, place, own = items.item[post].astype(np.int64), items.place[post].astype(np.int64), np.repeat(np.arange(len(held)), n)
    keep = (np.bincount(item, minlength=len(items.sizes)) >= items.bound)[item]
    item, place, own = item[keep], place[keep], own[keep]
    hits = np.bincount(item, weights=times[own], minlength=len(items.sizes)).astype(np.int64)
    overlap = 2 * items.longest + 64
    if hits.sum() > HITS and len(c) > 4 * overlap:
        half = len(c) // 2
        yield from _find(c[: half + overlap], items)
        yield from ((j, s + half, e + half, d) for j, s, e, d in _find(c[half:], items))
        return
    group = np.cumsum(hits) // HITS  # of an item
    for g in np.unique(group[item]):
        some = group[item] == g
        i, p, o = item[some], place[some], own[some]
        t = times[o]
        at = where[np.repeat(begin[o] - np.cumsum(t) + t, t) + np.arange(t.sum())]
        yield from _bands(c, items, np.repeat(i, t), at - np.repeat(p, t), np.repeat(p, t))


def _bands(c: np.ndarray, items: Items, item: np.ndarray, diagonal: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Matches out of shared q-grams: item, diagonal and place in the item."""
    step = 2 * items.allowed[item] + 1
    asked: list[tuple[int, int, int]] = []
    for shift in (0, 1):  # bands of 2 * step diagonals, starting at odd and at even steps
        band = (diagonal + shift * step) // (2 * step)
        key = item * (1 << 40) + band + (1 << 39)
        order = np.lexsort((place, key))
        k, p = key[order], place[order]
        once = np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1]))  # an item's q-gram counts once in a band
        v, count = np.unique(k[once], return_counts=True)
        v = v[count >= items.bound[v >> 40]]
        some = np.isin(key, v)
        # the diagonal that most of a band's q-grams have
        name, line = key[some], diagonal[some]
        order = np.lexsort((line, name))
        name, line = name[order], line[order]
        begin = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (line[1:] != line[:-1]))[: len(name)])
        count, name, line = np.diff(np.append(begin, len(name))), name[begin], line[begin]
        order = np.lexsort((line, -count, name))
        name, line = name[order], line[order]
        best = np.append(True, name[1:] != name[:-1])[: len(name)]
        for name, straight in zip(name[best].tolist(), line[best].tolist()):
            j, b = name >> 40, (name & ((1 << 40) - 1)) - (1 << 39)
            w, m = 2 * int(items.allowed[j]) + 1, int(items.sizes[j])
            if 0 <= straight <= len(c) - m and np.array_equal(c[straight : straight + m], items.texts[j]):
                yield j, straight, straight + m, 0
            else:
                low = 2 * w * b - shift * w
                asked.append((j, low - int(items.allowed[j]), low + 2 * w - 1 + int(items.allowed[j])))
    if asked:
        j, low, high = np.array(sorted(set(asked)), np.int64).T
        for i in plausible(c, items, j, low, high):
            k = int(j[i])
            got = align(items.texts[k], c, int(low[i]), int(high[i]), int(items.allowed[k]))
            if got:
                yield k, got[1], got[2], got[0]


def blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of at most BLOCK characters (a longer item is a block)."""
    held: list[tuple[object, str]] = []
    size = 0
    for r in benchmark.select(key, text).toLocalIterator():
        t = normal(r[1])
        if held and size + len(t) > BLOCK:
            yield held
            held, size = [], 0
        held.append((r[0], t))
        size += len(t)
    if held:
        yield held


def annotate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", column: str = "matches") -> DataFrame:
    """df with an array of matches (item, start, end, edits; places in the normalised text) for every row; a column of that name goes."""
    names = [c for c in df.columns if c != column]
    df = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))  # plain names, so that any can be handed to a task
    item = benchmark.schema[item_key].dataType
    match = StructType([StructField("item", item), StructField("start", LongType()), StructField("end", LongType()), StructField("edits", IntegerType())])
    kind = pa.list_(pa.struct([("item", to_arrow_type(item)), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    schema = StructType([*df.schema.fields, StructField("found", ArrayType(match))])
    at, width = names.index(text), len(names)
    out = None
    for block in blocks(benchmark, item_key, item_text):
        shared = df.sparkSession.sparkContext.broadcast(index_items(block))  # bounded by BLOCK

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                before = b.column(width).to_pylist()
                new = [old + [{"item": items.ids[k], "start": s, "end": e, "edits": d} for k, s, e, d in find(normal(t.as_py()), items)] for old, t in zip(before, b.column(at))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, kind)], names=schema.names)

        # a further block is a further pass over what the last one wrote
        out = df.withColumn("found", F.array().cast(ArrayType(match))) if out is None else stage(out, "decontam-pass")
        out = out.mapInArrow(search, schema)
    out = out if out is not None else df.withColumn("found", F.array().cast(ArrayType(match)))
    return out.toDF(*names, column)


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df that no item contaminates."""
    column = spare_name(df.columns, "matches")
    return annotate(df, benchmark, text, item_key, item_text, column).filter(F.size(column) == 0).select(*(F.col(f"`{c}`") for c in df.columns))
