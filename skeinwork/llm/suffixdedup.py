"""Exact repeats of long byte strings, found with suffix arrays.

Each byte covered by a string of ``width`` bytes that also starts at another place, of the same
document or another, is removed; strings are judged on the input.

`suffix_array` is the linear grouping construction: suffixes are grouped by their longest Lyndon
prefix, groups are processed from the highest down, the members' previous smaller suffixes (found by
pointers) move to new groups right behind their old ones, and in a last pass every group hands out
its places in order. There is no recursion and no renaming.

Equal strings meet in one shard (see `_repeats`), cut relative to their anchor. A shard's suffix array
is over blocks of BLOCK bytes counted from the fragments' anchors, numbered in the order of their bytes, so it has one entry for each
block, not byte, and stands in the order of the bytes behind each block border. Equal strings that start t bytes before a
border share the whole blocks behind it: their borders are neighbours in the array. What is left of them behind those blocks is equal if the
common prefixes of all neighbours between them reach so far; what is left in front is told the same way, by the order of the bytes
in front read backwards. So the array's runs, cut where common prefixes are too short, decide for each t, without any hash. Only
texts and fragments as wholes are told apart by a digest (MD5).

Cases: a null text is empty; texts shorter than the width lose nothing; of repeated rows and exact
copies of at least the width nothing is left, as each one's strings start elsewhere too; an empty
table gives an empty result; null keys are kept (as places, they count as the last); other columns are
ignored. A very long text is handled in runs of `_repeats.PART` bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm._repeats import Spec, repeats

WIDTH, GRAM, BLOCK = 400, 128, 32
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of a sequence of integers of zero or more, in time linear in its length and greatest number."""
    n = len(s) + 1
    s = [*(v + 1 for v in s), 0]  # the end is the least symbol
    starts = [0] * (max(s) + 2)
    for v in s:
        starts[v + 1] += 1
    for v in range(1, len(starts)):
        starts[v] += starts[v - 1]
    place, group, size = [0] * n, [0] * n, [0] * n  # of a suffix: its place, its group's first place; of a first place: the group's size
    order, filled = [0] * n, starts[:]
    for i, v in enumerate(s):  # counting sort by the first symbol
        k = filled[v]
        filled[v] = k + 1
        order[k], place[i], group[i] = i, k, starts[v]
        size[starts[v]] += 1
    before = [-2] * n  # the next suffix to the left in a lower group; -2: not known yet
    end = n
    while end > 0:
        first = group[order[end - 1]]
        counts: dict[int, int] = {}
        for i in order[first:end]:
            chain = []
            while before[i] == -2:  # to the left, past higher groups; members of this group on the way have the same answer
                chain.append(i)
                j = i - 1
                while j >= 0 and group[j] > first:
                    j = before[j]
                if j < 0 or group[j] < first:
                    before[i] = j
                else:
                    i = j
            j = before[i]
            for k in chain:
                before[k] = j
        for i in order[first:end]:
            j = before[i]
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, c in counts.items():
            by_count.setdefault(c, []).append(j)
        for c in range(max(by_count, default=0), 0, -1):
            moved: dict[int, int] = {}
            for j in by_count.get(c, ()):  # to the end of its group
                g = group[j]
                size[g] -= 1
                to = g + size[g]
                other, at = order[to], place[j]
                order[at], order[to] = other, j
                place[other], place[j] = at, to
                moved[g] = moved.get(g, 0) + 1
            for j in by_count.get(c, ()):
                g = group[j]
                group[j] = g + size[g]
            for g, m in moved.items():
                if size[g]:
                    size[g + size[g]] = m
                else:
                    size[g] = m
        end = first
    out, free = [0] * n, list(range(n))
    out[0] = n - 1
    placed = [False] * n
    placed[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
    return out[1:]


def _symbols(raw: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(raw, np.uint8)]


def _cut(raw: bytes) -> Callable[[int, int], bytes]:
    return lambda start, end: raw[start:end]


def _common(raw: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, most: int, room: np.ndarray) -> np.ndarray:
    """How many bytes are equal from places a and b on, in steps of 1 or -1, up to `most` and the room there is."""
    out = np.zeros(len(a), np.int64)
    for k in range(0, len(a), 1 << 14):
        x, y = a[k : k + (1 << 14), None], b[k : k + (1 << 14), None]
        ways = step * np.arange(most)
        equal = raw[np.clip(x + ways, 0, len(raw) - 1)] == raw[np.clip(y + ways, 0, len(raw) - 1)]
        out[k : k + (1 << 14)] = np.where(equal.all(axis=1), most, np.argmin(equal, axis=1))
    return np.minimum(out, room)


def byte_index(data: list[bytes], marks: np.ndarray, windows: np.ndarray, times: np.ndarray, width: int = WIDTH, block: int = BLOCK) -> list[np.ndarray]:
    """Mask of the windows of each fragment that start at another place too."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    base = np.cumsum(sizes) - sizes
    repeated = np.repeat(times > 1, sizes)  # by the window's first byte
    whole = (width - block + 1) // block  # whole blocks in every window, wherever it starts
    # block borders are counted from the anchor, to which equal windows lie alike; a fragment's last block may be a part of one
    first = marks % block
    count = np.maximum(-(-(sizes - first) // block), 0)
    own = np.repeat(np.arange(len(data)), count)
    border = (base + first)[own] + block * (np.arange(len(own)) - (np.cumsum(count) - count)[own])
    raw = np.frombuffer(b"".join(data), np.uint8)
    if not len(border):
        return [repeated[b : b + w] for b, w in zip(base, windows)]
    stop = (base + sizes)[own]
    # blocks get numbers in the order of their bytes, what a part lacks being less than any byte; 0 parts the fragments
    symbols = _numbered(raw, border, stop, block)
    gap = np.flatnonzero(np.diff(own)) + 1
    symbols, border, own, stop = np.insert(symbols, gap, 0), np.insert(border, gap, -1), np.insert(own, gap, -1), np.insert(stop, gap, -1)
    sa = np.array(suffix_array(symbols.tolist()), np.int64)
    padded = np.append(symbols, np.zeros(whole, np.int64))
    run = np.zeros(len(sa), np.int64)
    for k in range(whole):
        head = padded[sa + k]
        run[1:] |= head[1:] != head[:-1]
    run = np.cumsum(run)
    held = whole * block
    full = border[sa] + held <= stop[sa]  # the inserted ones have stop -1 and do not fit
    sa, run = sa[full], run[full]
    same = run[1:] == run[:-1]
    near = np.append(False, same) | np.append(same, False) if len(run) else np.zeros(0, bool)  # a run of one is no repeat
    border, run, own, stop = border[sa[near]], run[near], own[sa[near]], stop[sa[near]]
    m, rest = len(border), width - held  # bytes of a window outside its whole blocks
    if not m:
        return [repeated[b : b + w] for b, w in zip(base, windows)]
    behind, front = border + held, border - 1
    after, before = stop - behind, border - base[own]  # bytes there are
    right = np.where(run[1:] == run[:-1], _common(raw, behind[:-1], behind[1:], 1, rest, np.minimum(after[1:], after[:-1])), -1)
    order = _backwards(raw, front, before, block)
    left = _common(raw, front[order[:-1]], front[order[1:]], -1, block, np.minimum(before[order[1:]], before[order[:-1]]))
    for t in range(block):  # a window belongs to the first border at or behind its start
        at = border - t
        ok = np.flatnonzero((at >= base[own]) & (at < base[own] + windows[own]))
        groups = np.cumsum(np.append(0, right < rest - t))[ok] * (m + 1)
        of_left = np.empty(m, np.int64)
        of_left[order] = np.cumsum(np.append(0, left < t))
        groups += of_left[ok]
        place = np.argsort(groups, kind="stable")
        twin = np.flatnonzero(groups[place[1:]] == groups[place[:-1]])
        repeated[at[ok[place[twin]]]] = repeated[at[ok[place[twin + 1]]]] = True
    return [repeated[b : b + w] for b, w in zip(base, windows)]


def _numbered(raw: np.ndarray, border: np.ndarray, stop: np.ndarray, block: int) -> np.ndarray:
    """Numbers from 1 of the blocks at the borders, in the order of their bytes; bytes that are not there come first."""
    wide = np.zeros((len(border), block), ">u2")
    for k in range(0, len(border), 1 << 14):
        places = border[k : k + (1 << 14), None] + np.arange(block)
        there = places < stop[k : k + (1 << 14), None]
        wide[k : k + (1 << 14)] = np.where(there, raw[np.minimum(places, len(raw) - 1)].astype(np.int64) + 1, 0)
    return np.unique(wide.view(f"V{2 * block}").reshape(-1), return_inverse=True)[1].reshape(-1) + 1


def _backwards(raw: np.ndarray, front: np.ndarray, before: np.ndarray, block: int) -> np.ndarray:
    """The order of the bytes in front, read backwards for a block; where one ends, it comes first."""
    block = -(-block // 8) * 8
    keys = np.zeros((len(front), block), np.uint8)
    for k in range(0, len(front), 1 << 14):
        ways = np.arange(block)
        there = ways < before[k : k + (1 << 14), None]
        keys[k : k + (1 << 14)] = np.where(there, raw[np.maximum(front[k : k + (1 << 14), None] - ways, 0)], 0)
    words = np.ascontiguousarray(keys).view(">u8").astype(np.uint64)
    return np.lexsort((before, *words.T[::-1]))


SPEC = Spec("suffix", WIDTH, GRAM, _symbols, _cut, 4)


def _spans(masks: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches that repeated windows cover."""
    starts = np.sort(np.concatenate([m["lo"] + np.flatnonzero(np.frombuffer(m["mask"], np.uint8)) for m in masks]))
    cut = np.flatnonzero(np.diff(starts) > WIDTH)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + WIDTH


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """tid (MD5 of the text), n_bytes, spans (array<struct<start, end>>, repeated bytes), kept (the other
    bytes) of each distinct text that has a repeat; texts found in several rows are one span."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.unhex(F.md5(whole.cast("binary"))).alias("tid"), F.col(key).alias("key"), whole.alias("text")).filter(F.octet_length("text") >= WIDTH)
    known, found = repeats(rows, SPEC, byte_index)
    copied = known.filter("copies > 1").select("tid", "n_bytes")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, spans, kept = [], [], []
            for t, masks in zip(b.column(1), b.column(2)):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                lo, hi = _spans(masks.as_py())
                sizes.append(len(raw))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi)])
                kept.append(b"".join(raw[x:y] for x, y in zip(np.append(0, hi), np.append(lo, len(raw)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["tid", "n_bytes", "spans", "kept"])

    out = "tid binary, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    single = found.join(copied.select("tid"), "tid", "left_anti").mapInArrow(run, out)
    all_of_it = copied.select("tid", "n_bytes", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans"), F.lit(b"").alias("kept"))
    return single.unionByName(all_of_it)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row. Texts without repeats are not moved."""
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    changed = repeated_spans(df, key, text).select(
        "tid", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
    rows = df.select(F.col(key).alias(key), F.unhex(F.md5(whole)).alias("tid"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("whole"))
    none = F.lit(0).cast("long")
    return rows.join(changed, "tid", "left").select(
        key, "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )
