"""Shared plan of the two repeat removers: bring equal windows together without moving all windows.

A window is `width` consecutive symbols (bytes or words) of one text. Every window is represented by
its anchor, the gram of `gram` symbols within it with the least hash (the leftmost of equals), so
equal windows have equal anchors. Windows with one anchor start at consecutive places lo..hi, and
the text from lo to hi + width is the anchor's fragment: each window lies in exactly one fragment, and
equal windows lie in fragments with the same anchor key.

1. The anchor keys of all texts are listed, once for each distinct text (by MD5); exact copies are settled by their
   class alone. Texts stay where they are.
2. Keys are counted over all distinct texts; those found twice or more are wanted, and only texts with a wanted key move.
3. Fragments of wanted anchors are cut out and reduced to distinct ones, pre-aggregated before the shuffle. Anchors
   with over HOT different fragments are refined (`_halves`): the windows with more than a middle share of the text
   before the anchor and those with less are parted, and each half is keyed by all the text that its windows have in
   common. That is repeated until no key is crowded, at the latest with single windows, so no key gathers an unbounded number.
4. Fragments are dealt by key to a bounded number of tasks and sorted by key; a task cuts its stream into shards of about
   SHARD symbols, one after the other, and an index of each shard (the caller's) tells which windows are repeats.
5. The answers go back to every place the fragment occurs, and from there to the texts.

Every step is an aggregation or a join over all data; nothing is sampled, capped or cut short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm._shared import discard, release, stage

HOT = 2_000
SHARD = 400_000
PART = 1 << 20  # symbols of a text handled at a time
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        for at, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(m, np.uint64(b))
            p[0] = 1
            _POWERS[at : at + 1] = [np.multiply.accumulate(p)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit symbols."""

    def __init__(self, x: np.ndarray):
        power, self.inverse = _powers(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * power[: len(x)], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def anchors(x: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, lo, hi, place of each anchor of the sequence, by place."""
    if len(x) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    h = Rolling(x).grams(gram)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    reach, span = width - gram + 1, 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if reach > span:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    at = (least & low).astype(np.int64)
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.append(lo[1:], len(at)) - 1
    return h[at[lo]].view(np.int64), lo, hi, at[lo]


def parts(n: int, width: int) -> Iterator[tuple[int, int]]:
    """Stretches of a text whose windows together are the text's, each once."""
    for at in range(0, max(n - width + 1, 0), PART):
        yield at, min(n, at + PART + width - 1)


@dataclass(frozen=True)
class Spec:
    """symbols: UTF-8 text -> 64-bit symbols; cut: text or stored stretch -> function of start and end that gives
    the stored form of that stretch."""

    name: str
    width: int
    gram: int
    symbols: Callable[[bytes], np.ndarray]
    cut: Callable[[bytes], Callable[[int, int], bytes]]
    symbol_bytes: int


def _keys(rows: DataFrame, spec: Spec) -> DataFrame:
    """tid, least, n_bytes, keys (the anchor keys, repeats included) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for t in b.column(3):
                x = spec.symbols(t.as_py().encode("utf-8", "surrogatepass"))
                keys.append(np.concatenate([np.zeros(0, np.int64), *(anchors(x[s:e], spec.width, spec.gram)[0] for s, e in parts(len(x), spec.width))]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(keys, pa.list_(pa.int64()))], names=["tid", "least", "n_bytes", "keys"])

    last = F.lit((1 << 63) - 1)  # a null key counts as the last
    known = rows.select("tid", F.coalesce(F.col("key").cast("long"), last).alias("least"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return known.mapInArrow(run, "tid binary, least long, n_bytes long, keys array<long>")


_COLUMNS = "key long, fid binary, nid long, least long, lo long, mark int, windows int, data binary"
_NAMES = ["key", "fid", "nid", "least", "lo", "mark", "windows", "data"]
_KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose last value is binary, of about `most` bytes."""
    out: list[list] = [[] for _ in names]
    held = 0
    for row in rows:
        for column, v in zip(out, row):
            column.append(v)
        held += 64 + len(row[-1] or b"")
        if held > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
            out, held = [[] for _ in names], 0
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)


def _fragments(held: DataFrame, spec: Spec) -> DataFrame:
    """The wanted anchors' fragments of every text: key, fid (MD5 of data), place, mark (the anchor's place in it), windows, data
    (null if the task has had that fragment already)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        had: set[bytes] = set()
        for b in batches:
            for nid, text, least, keys in zip(*b.columns):
                nid, raw, least = nid.as_py(), text.as_py().encode("utf-8", "surrogatepass"), least.as_py()
                x, cut, keys = spec.symbols(raw), spec.cut(raw), np.array(keys.as_py(), np.int64)
                for s, e in parts(len(x), spec.width):
                    key, lo, hi, at = anchors(x[s:e], spec.width, spec.gram)
                    some = np.isin(key, keys)
                    for k, a, z, m in zip(key[some].tolist(), lo[some].tolist(), hi[some].tolist(), at[some].tolist()):
                        data = cut(s + a, s + z + spec.width)
                        fid = hashlib.md5(data).digest()
                        yield k, fid, nid, least, s + a, m - a, z - a + 1, None if fid in had else data
                        if len(had) > 1 << 18:  # bounded; to send a fragment twice is no harm
                            had.clear()
                        had.add(fid)

    return held.select("nid", "text", "least", "keys").mapInArrow(lambda b: _batches(rows(b), _NAMES, _KINDS), _COLUMNS)


def _halves(crowded: DataFrame, spec: Spec) -> DataFrame:
    """Fragments of crowded keys in two: of (the fragment), skip (windows left out before), and the columns of found.

    Windows are told by their distance to the anchor, near..far for those of a key. Windows at distances x to y share the text
    from the start of the one at x to the end of the one at y. This stretch names the half's key, so equal windows keep meeting;
    a half of a single distance shares the whole window.
    """
    names = ["of", "skip", "key", "fid", "mark", "windows", "near", "far", "times", "least", "nid", "lo", "data"]
    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for fid, mark, windows, near, far, times, least, nid, lo, data in zip(*(c.to_pylist() for c in b.columns)):
                cut, middle = spec.cut(data), (near + far) // 2
                for x, y in ((near, middle), (middle + 1, far)):
                    first, last = max(0, mark - y), min(windows - 1, mark - x)
                    if first <= last:
                        shared, part = cut(mark - x, mark - y + spec.width), cut(first, last + spec.width)
                        key = int.from_bytes(hashlib.md5(b"%d %d " % (x, y) + shared).digest()[:8], "little", signed=True)
                        yield fid, first, key, hashlib.md5(part).digest(), mark - first, last - first + 1, x, y, times, least, nid, lo + first, part

    kind = "of binary, skip int, key long, fid binary, mark int, windows int, near int, far int, times long, least long, nid long, lo long, data binary"
    columns = crowded.select("fid", "mark", "windows", "near", "far", "times", "at.least", "at.nid", "at.lo", "data")
    return columns.mapInArrow(lambda b: _batches(rows(b), names, kinds), kind)


#: (data, marks, windows, times found) of a shard's fragments, in the order of their first places -> for each a mask of its windows
Index = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def _tasks(found: DataFrame, spec: Spec) -> int:
    """Four shards a task, but no more tasks than the session is set up for."""
    spark = found.sparkSession
    size = found.agg(F.sum(F.length("data"))).first()[0] or 0
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return max(1, min(size // (4 * SHARD * spec.symbol_bytes), most))


def _judge(found: DataFrame, spec: Spec, index: Index) -> DataFrame:
    """fid and mask of the distinct fragments that have a repeat or are found in several places; a task holds one shard at a time."""

    def judged(shard: pa.Table) -> Iterator[pa.RecordBatch]:
        release()
        t = shard.sort_by([(c, "ascending") for c in ("least", "nid", "lo")])
        masks = index(t["data"].to_pylist(), t["mark"].to_numpy(), t["windows"].to_numpy(), t["times"].to_numpy())
        hit = np.array([m.any() for m in masks]) | (t["times"].to_numpy() > 1)
        got = pa.Table.from_arrays([t["fid"].filter(pa.array(hit)), pa.array([m.astype(np.uint8).tobytes() for m, h in zip(masks, hit) if h], pa.binary())], names=["fid", "mask"])
        yield from got.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, most = 0, SHARD * spec.symbol_bytes
        for b in batches:
            held.append(b)
            size += b.column(8).nbytes
            while size > most:
                t = pa.Table.from_batches(held)
                keys = t["key"].to_numpy()
                ends = np.cumsum(np.array([len(d) for d in t["data"].to_pylist()]))
                # whole keys up to about `most` bytes, one key at least; the last key may go on in the next batch
                borders = np.flatnonzero(keys[1:] != keys[:-1]) + 1
                if not len(borders):
                    break
                end = int(borders[max(np.searchsorted(ends[borders - 1], most, side="right") - 1, 0)])
                yield from judged(t.slice(0, end))
                held = t.slice(end).to_batches()
                size = int(ends[-1] - ends[end - 1])
        if held and sum(h.num_rows for h in held):
            yield from judged(pa.Table.from_batches(held))

    rows = found.select("key", "fid", "at.least", "at.nid", "at.lo", "mark", "windows", "times", "data")
    return rows.repartition(_tasks(found, spec), "key").sortWithinPartitions("key").mapInArrow(run, "fid binary, mask binary")


def _judge_all(found: DataFrame, spec: Spec, index: Index) -> DataFrame:
    """_judge, with crowded keys refined first."""
    crowded = stage(found.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"), f"{spec.name}-crowded")
    if crowded.isEmpty():
        return _judge(found, spec, index)
    big = found.join(crowded, "key")
    halves = stage(_halves(big, spec), f"{spec.name}-halves")
    at = F.struct("least", "nid", "lo")
    same = [F.first(c).alias(c) for c in ("data", "mark", "windows", "near", "far")]
    own = stage(halves.groupBy("key", "fid").agg(*same, F.sum("times").alias("times"), F.min(at).alias("at")), f"{spec.name}-own")
    got = stage(_judge_all(own, spec, index), f"{spec.name}-refined").join(own.select("fid", F.col("at").alias("first")), "fid")
    # a half's mask is that of its first place; elsewhere all its windows are repeats
    mine = halves.select("of", "skip", "windows", "fid", at.alias("at")).join(got, "fid", "left")
    flags = F.when(F.col("mask").isNull(), F.expr("repeat('00', windows)")).when(F.col("at") == F.col("first"), F.hex("mask")).otherwise(F.expr("repeat('01', windows)"))
    whole = mine.groupBy("of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("skip", flags.alias("f")))), lambda x: x["f"]), "").alias("flags"))
    masks = big.select(F.col("fid").alias("of"), "times").join(whole, "of").filter(F.contains("flags", F.lit("1")) | (F.col("times") > 1))
    return _judge(found.join(crowded, "key", "left_anti"), spec, index).unionByName(masks.select(F.col("of").alias("fid"), F.unhex("flags").alias("mask")))


def repeats(rows: DataFrame, spec: Spec, index: Index) -> tuple[DataFrame, DataFrame]:
    """Distinct texts of rows (tid, key, text), and the repeated windows in them.

    The first table has tid, least (key), n_bytes and copies (rows) of each distinct text. The second has tid, text and spans:
    array<struct<lo, first, mask>>; mask has a byte for each window from lo on, as the index found it for the
    fragment's first place, and `first` tells whether that is here.
    """
    keys = _keys(rows, spec).groupBy("tid").agg(F.min("least").alias("least"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("keys").alias("keys"))
    texts = stage(keys.withColumn("nid", F.monotonically_increasing_id()), f"{spec.name}-keys")
    each = texts.select("nid", F.explode("keys").alias("key"))
    wanted = stage(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), f"{spec.name}-wanted")
    mine = each.join(wanted, "key", "left_semi").groupBy("nid").agg(F.collect_list("key").alias("keys"))
    marked = stage(mine.join(texts.select("nid", "tid", "least"), "nid"), f"{spec.name}-marked")
    known = stage(texts.select("tid", "least", "n_bytes", "copies"), f"{spec.name}-known")
    discard(texts, wanted)
    held = stage(rows.groupBy("tid").agg(F.first("text").alias("text")).join(marked, "tid"), f"{spec.name}-held")
    discard(marked)
    pieces = stage(_fragments(held, spec), f"{spec.name}-pieces")
    same = [F.first("data", ignorenulls=True).alias("data"), F.first("mark").alias("mark"), F.first("windows").alias("windows")]
    range_ = [F.lit(0).alias("near"), F.lit(spec.width - spec.gram).alias("far")]
    found = pieces.groupBy("key", "fid").agg(*same, F.count("*").alias("times"), F.min(F.struct("least", "nid", "lo")).alias("at"))
    found = stage(found.select("*", *range_), f"{spec.name}-found")
    # a key and a fragment's content go together, so fid alone tells it
    judged = stage(_judge_all(found, spec, index), f"{spec.name}-judged")
    firsts = stage(judged.join(found.select("fid", "at"), "fid"), f"{spec.name}-firsts")
    discard(found, judged)
    places = pieces.select("fid", "nid", "least", "lo").join(firsts, "fid")
    spans = places.groupBy("nid").agg(F.collect_list(F.struct("lo", (F.struct("least", "nid", "lo") == F.col("at")).alias("first"), "mask")).alias("spans"))
    return known, held.select("nid", "tid", "text").join(spans, "nid").drop("nid")
