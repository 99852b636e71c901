"""SimHash near-duplicates by pivot distance tables.

A document's fingerprint has 64 bits: bit b is set if more than half of the XXH64 values (seed 42)
of its word shingles have it set. Documents whose fingerprints differ in at most RADIUS = 2 bits are
linked; classes are the connected components.

Search, on distinct fingerprints only:

1. Table. A fingerprint's row holds its Hamming distance to every one of 68 fixed reference fingerprints: for each quarter
   of the bits the 16 Walsh codewords there, zero elsewhere, and the quarter's own mask.
2. Cells. The distance to a quarter's mask less that to the zero fingerprint is a coordinate from 0 to 16 (after scaling); two bits
   change the four coordinates by 2 in sum at most. So a cell is a point of the four coordinates; a fingerprint goes to its own
   cell, its home, and to one of every two opposite cells within a sum of 2 around: COPIES = 21 rows in all, whatever the input. Linked
   fingerprints meet in the home of one of them. There are 17**4 cells; one with over CELL members is split by bits (one of three
   parts of the 64 must agree).
3. Discard and verify. In a cell, pairs of a home member and any other whose table rows differ by over 2 in any coordinate are
   discarded (the triangle inequality allows no more), the others are verified by their real
   distance. A cell yields a link from each member to the least of its class there, never all pairs.

`drop_near_duplicates` also links documents whose sets of shingles overlap by SIMILARITY = 4/5 or more, which
a radius of two bits does not reach (an overlap of 0.8 flips about ten bits of 64). The sets are those of the
shingles' XXH64 values; every link is verified on them. Nodes are distinct (fingerprint, set).

1. Most links come cheaply: each node goes to cells named by TABLES pairs of min-hashes and is compared with the least and
   the greatest member of each. What is missed here is left to the next step.
2. All others come from prefix filtering. Shingles are ordered, common ones (by a sample) last; two sets of s and t
   members that overlap by 4/5 share one of the first s - ceil(4s/5) + 1 and t - ceil(4t/5) + 1. A node goes to the cells
   of these shingles, and only cells whose nodes are not yet of one class count. Not common shingle, up to PAIRED nodes:
   pairs are counted over all such cells; the counts of links have a lower bound (``_enough``). More nodes: all are compared,
   in blocks if there are many. Common shingle: only pairs that could link by common shingles alone have to meet here.
   In such a pair at least 8/9 of the smaller set are common shingles; cells without such a node are dropped.

Links are joined to classes by label propagation with pointer jumping over written tables.

Cases: null and empty texts and texts without words have fingerprint zero, linked like any other;
fewer words than a shingle: the whole sequence is the one shingle; repeated rows share a class; an
empty table gives an empty result; a null id is never the id of a class that has another; other
columns are ignored. Whole texts are used, hashed in runs of RUN shingles to bound memory.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm._shared import discard, maybe_broadcast, spare_name, stage

RADIUS = 2
CELL = 8_000
RUN = 1 << 16
SMALL = 1024
#: Sets are similar from this overlap on (numerator, denominator).
SIMILARITY = (4, 5)
TABLES, SIMILAR_CELL, PAIRED = 8, 4000, 100
#: Nodes in the sample for common shingles, and how many of these are told apart at most (the order of the others is by hash).
SAMPLE, COMMON = 10_000, 1 << 18
#: Odd numbers for min-hashes, two for each table.
_ODD = np.random.default_rng(5).integers(1, 1 << 63, 2 * TABLES, dtype=np.uint64) | np.uint64(1)


def shingle_digests(text: str | None, n: int) -> Iterator[bytes]:
    """The big-endian XXH64 values of the word shingles, in runs of at most RUN shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    digest, join = xxhash.xxh64_digest, b" ".join
    if w and len(w) < n:
        yield digest(join(w), 42)
    for at in range(0, len(w) - n + 1, RUN):
        part = [w[at + k : min(at + RUN, len(w) - n + 1) + k] for k in range(n)]
        yield b"".join([digest(join(s), 42) for s in zip(*part)])


def majority(runs: list[bytes]) -> int:
    """The fingerprint of shingle values as an unsigned integer."""
    ones, total = np.zeros(64, np.int64), sum(map(len, runs)) // 8
    for run in runs:
        ones += np.unpackbits(np.frombuffer(run, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprint(text: str | None, n: int = 3) -> int:
    return majority(list(shingle_digests(text, n)))


def shingle_set(runs: list[bytes]) -> np.ndarray:
    """The distinct shingle values in ascending order."""
    return np.unique(np.frombuffer(b"".join(runs), ">u8").astype(np.uint64))


def min_hashes(h: np.ndarray) -> list[int]:
    """The keys of TABLES cells of a set, each from a pair of min-hashes."""
    if not len(h):
        return []
    mixed = h ^ (h >> np.uint64(31))
    least = np.array([(mixed * odd).min() for odd in _ODD])
    keys = least[0::2] * np.uint64(0x9E3779B97F4A7C15) + least[1::2] + np.arange(TABLES, dtype=np.uint64)
    return keys.view(np.int64).tolist()


def fingerprints(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """key and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), n) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fp long")


def set_rows(df: DataFrame, key: str, text: str, n: int, common: np.ndarray) -> DataFrame:
    """key, digest (MD5 of the text), fp, node (a number for fingerprint and set), cells (min-hashes), size of the set, rare (its
    shingles that are not common ones) and prefix (its first shingles, rare ones before common ones) of every row."""
    order = np.argsort(common)
    values = df.sparkSession.sparkContext.broadcast((common[order], order + 1))  # COMMON numbers at most
    kind = f"`{key}` {df.schema[key].dataType.simpleString()}, digest binary, fp long, node long, cells array<long>, size int, rare int, prefix array<long>"
    kinds = {"fp": pa.int64(), "node": pa.int64(), "cells": pa.list_(pa.int64()), "size": pa.int32(), "rare": pa.int32(), "prefix": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = values.value
        for b in batches:
            made = []
            for t in b.column(2):
                runs = list(shingle_digests(t.as_py(), n))
                fp, h = majority(runs), shingle_set(runs)
                place = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    place = np.where(known[at] == h, rank[at], 0)
                p, rare = prefix(len(h)), int((place == 0).sum())
                some = h[place == 0][:p] if rare >= p else h[np.argsort(place, kind="stable")[:p]]  # h is sorted
                made.append((_signed(fp), _signed(xxhash.xxh64_intdigest(h.tobytes(), fp)), min_hashes(h), len(h), rare, some.view(np.int64)))
            columns = zip(*made) if made else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds.values()))], names=[key, "digest", *kinds])

    return df.select(key, _digest(F.col(text)).alias("__digest"), text).mapInArrow(run, kind)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


QUARTERS = [0xFFFF << 16 * q for q in range(4)]


def references() -> np.ndarray:
    """All 68 references: the quarters' masks, then the Walsh codewords of each quarter."""
    i = np.arange(16)
    bits = np.array([[bin(j & k).count("1") & 1 for k in i] for j in i])
    walsh = (bits << i).sum(axis=1).astype(np.uint64)
    return np.concatenate([np.array(QUARTERS, np.uint64), *(walsh << np.uint64(16 * q) for q in range(4))])


def distances(u: np.ndarray) -> np.ndarray:
    """The table: a row for each fingerprint, a column for each reference."""
    return np.stack([np.bitwise_count(u ^ r).astype(np.int8) for r in references()], axis=1)


def coordinates(u: np.ndarray) -> np.ndarray:
    """For each quarter half of 16 and the distance to zero less that to its mask: the ones in it."""
    zero = np.bitwise_count(u).astype(np.int64)
    return np.stack([(16 + zero - np.bitwise_count(u ^ np.uint64(q))) // 2 for q in QUARTERS], axis=1)


def _steps() -> np.ndarray:
    """From a home to the cells within a sum of RADIUS around, one of every two opposite ones; the home itself first."""
    span = range(-RADIUS, RADIUS + 1)
    ball = [d for d in itertools.product(span, repeat=4) if sum(map(abs, d)) <= RADIUS]
    return np.array(sorted([d for d in ball if d >= (0, 0, 0, 0)], key=lambda d: (sum(map(abs, d)), d)))


COPIES = len(_steps())


def _cells(nodes: DataFrame) -> DataFrame:
    """cell, home, fp: COPIES rows at most for each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = 17 ** np.arange(4)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            at = coordinates(fp.view(np.uint64))
            for k, step in enumerate(_steps()):
                to = at + step
                real = ((to >= 0) & (to <= 16)).all(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array((to @ scale)[real]), pa.array(np.full(real.sum(), k == 0)), pa.array(fp[real])], names=["cell", "home", "fp"])

    return nodes.select("fp").mapInArrow(run, "cell long, home boolean, fp long")


class _Sets:
    """Disjoint sets over 0..n-1; a set's root is its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def _link(u: np.ndarray, at: np.ndarray, home: np.ndarray, sets: _Sets, table: np.ndarray) -> None:
    """Join the members `at` of u that differ in at most RADIUS bits, one of them at home here."""
    if len(at) < 2 or not home[at].any():
        return
    if len(at) > SMALL:
        varying = np.bitwise_or.reduce(u[at] ^ u[at[0]])
        bits = [k for k in range(64) if int(varying) >> k & 1]
        for part in range(RADIUS + 1):
            mask = np.uint64(sum(1 << k for k in bits[part :: RADIUS + 1]))
            v = u[at] & mask
            order = np.argsort(v, kind="stable")
            for group in np.split(at[order], np.flatnonzero(np.diff(v[order])) + 1):
                _link(u, group, home, sets, table)
        return
    own = at[home[at]]
    near = np.ones((len(own), len(at)), bool)
    for column in range(4):  # a first look at a few columns
        near &= np.abs(table[own, column][:, None] - table[at, column][None, :]) <= RADIUS
    i, j = np.nonzero(near)
    i, j = own[i], at[j]
    i, j = i[i != j], j[i != j]
    for k in range(0, len(i), 1 << 16):
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        kept = np.abs(table[x] - table[y]).max(axis=1, initial=0) <= RADIUS
        x, y = x[kept], y[kept]
        linked = np.bitwise_count(u[x] ^ u[y]) <= RADIUS
        for a, b in zip(x[linked].tolist(), y[linked].tolist()):
            sets.join(a, b)


def link_members(fps: np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member of its class) of one cell, in signed longs; `home` tells whose home it is (all, if not given)."""
    s, first = np.unique(fps, return_index=True)
    u = s.view(np.uint64)
    sets = _Sets(len(u))
    _link(u, np.arange(len(u)), np.ones(len(u), bool) if home is None else home[first], sets, distances(u))
    root = np.array([sets.root(i) for i in range(len(u))])
    moved = root != np.arange(len(u))
    return s[moved], s[root[moved]]


def _links(cells: DataFrame) -> DataFrame:
    """Links found in the cells (cell, part, home, fp); a task has its cells one after the other."""

    def found(held: list[pa.RecordBatch], last: bool) -> tuple[list[pa.RecordBatch], pa.RecordBatch]:
        cell, part, home, fp = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(4))
        border = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
        ends = np.append(border, len(cell)) if last else border  # the last cell may go on in the next batch
        u, v, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for end in ends.tolist():
            if end - at > 1:
                a, b = link_members(fp[at:end], home[at:end])
                u.append(a)
                v.append(b)
            at = end
        rest = pa.RecordBatch.from_arrays([pa.array(x[at:]) for x in (cell, part, home, fp)], names=["cell", "part", "home", "fp"])
        return [rest] if rest.num_rows else [], pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) > RUN:
                held, links = found(held, False)
                yield links
        if held:
            yield found(held, True)[1]

    ordered = cells.select("cell", "part", "home", "fp").repartition("cell", "part").sortWithinPartitions("cell", "part")
    return ordered.mapInArrow(run, "u long, v long")


def near_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints, enough to connect every class."""
    cells = _cells(nodes)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("h")).filter("n > 1 and h > 0").select("cell", "n")
    full = cells.join(F.broadcast(sizes), "cell")  # 17**4 rows at most
    thirds = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_third(k))).alias("v")) for k in range(3)))
    parts = F.when(F.col("n") <= CELL, F.array(F.lit(0).cast("long"))).otherwise(F.transform(thirds, lambda t: F.xxhash64(t["k"], t["v"])))
    return _links(full.select("cell", F.explode(parts).alias("part"), "home", "fp")).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _third(k: int) -> int:
    return _signed(sum(1 << b for b in range(64) if b % 3 == k))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of the ranges from each start on, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def prefix(size):
    """How many of a set's shingles in any common order have one of each similar set's first ones among them."""
    a, b = SIMILARITY
    return size - (a * size + b - 1) // b + (size > 0)


def link_similar(fps: np.ndarray, sets: list[bytes], roots: np.ndarray | None = None, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of similar sets, enough to connect the classes; members of one root are connected already.
    With `blocks`, members of one block need not be compared."""
    a, b = SIMILARITY
    label = np.unique(fps if roots is None else roots, return_inverse=True)[1].reshape(-1)
    none = np.zeros(0, np.int64)
    if len(label) == 0 or (label == label[0]).all():
        return none, none
    size = np.array([len(x) // 8 for x in sets])
    owner = np.repeat(np.arange(len(size)), size)
    token, held = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True, return_counts=True)[1:]
    token = token.reshape(-1)
    token = token[np.lexsort((token, held[token], owner))]  # each set's rarest first
    start = np.cumsum(size) - size
    first = (np.arange(len(token)) - start[owner] < prefix(size)[owner]) & (held[token] > 1)
    at = np.flatnonzero(first)[np.argsort(token[first], kind="stable")]
    lists, count = owner[at], np.bincount(token[first], minlength=len(held))
    where = np.cumsum(count) - count
    seen, links = np.zeros(len(held), bool), []
    for i in range(len(size)):
        other = label != label[i]
        other[: i + 1] = False
        if blocks is not None:
            other &= blocks != blocks[i]
        if not other.any():
            continue
        own = token[start[i] : start[i] + size[i]]
        few = own[: prefix(size[i])]
        near = np.unique(lists[_ranges(where[few], count[few])])
        near = near[other[near] & (b * size[near] >= a * size[i]) & (b * size[i] >= a * size[near])]
        if not len(near):
            continue
        seen[own] = True
        both = np.add.reduceat(seen[token[_ranges(start[near], size[near])]].astype(np.int64), np.cumsum(size[near]) - size[near])
        seen[own] = False
        for j in near[(a + b) * both >= a * (size[i] + size[near])]:
            if label[j] != label[i]:
                links.append((fps[j], fps[i]))
                label[label == label[j]] = label[i]
    found = np.array(links, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _of(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """One row of texts (digest, text; copies have a row each) for each of the digests. Texts that are not asked for are not
    moved where the digests were measured to be few."""
    return texts.join(maybe_broadcast(digests, 64), "digest", "left_semi").dropDuplicates(["digest"])


def _verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Of pairs (structs a, b of node, fp, digest) the links (u, v) of similar sets. Texts (digest, text) move to their pairs,
    a row at a time; what a task holds is one pair and the set of the last b."""
    asked = stage(pairs.select(F.col("a.digest").alias("ad"), F.col("b.digest").alias("bd"), F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct(), "simhash-pairs")
    held = stage(_of(texts, asked.select(F.explode(F.array("ad", "bd")).alias("digest")).distinct()), "simhash-texts")
    first = asked.join(held.select(F.col("digest").alias("ad"), F.col("text").alias("x")), "ad")
    both = first.join(held.select(F.col("digest").alias("bd"), F.col("text").alias("y")), "bd").select("u", "v", "bd", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = SIMILARITY
        last, y = None, np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for digest, xt, yt in zip(*batch.columns[2:]):
                if digest != last:
                    last, y = digest, shingle_set(list(shingle_digests(yt.as_py(), n)))
                x = shingle_set(list(shingle_digests(xt.as_py(), n)))
                good.append((a + b) * len(np.intersect1d(x, y, assume_unique=True)) >= a * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    links = stage(both.mapInArrow(run, "u long, v long").distinct(), "simhash-links")
    discard(asked, held)
    return links


def _compared(members: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Links (u, v) within each (cell, part) of members cell, part, block, node, fp, digest, root. Members of one block are compared
    if it is alone in its part."""
    held = _of(texts, members.select("digest").distinct())

    def run(key, pdf):  # twice SIMILAR_CELL members at most, long ones counting more
        import pandas as pd

        pdf = pdf.drop_duplicates("node").sort_values("node")
        blocks = None if pdf["block"].nunique() < 2 else pdf["block"].to_numpy()
        sets = [shingle_set(list(shingle_digests(t, n))).tobytes() for t in pdf["text"]]
        a, b = link_similar(pdf["fp"].to_numpy(), sets, pdf["root"].to_numpy(), blocks)
        return pd.DataFrame({"u": a, "v": b})

    return stage(members.join(held, "digest").groupBy("cell", "part").applyInPandas(run, "u long, v long").distinct(), "simhash-links")


def _weight() -> Column:
    """A member's share of SIMILAR_CELL: long sets count more, for memory."""
    return F.lit(1) + F.expr("size div 1000")


def _alike(a: str, b: str) -> Column:
    """Whether the sizes of two different nodes allow similar sets and their fingerprints do not link them already."""
    x, y = SIMILARITY
    return F.expr(f"{a}.fp <> {b}.fp and {y} * {a}.size >= {x} * {b}.size and {y} * {b}.size >= {x} * {a}.size")


def similar_links(nodes: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Links (u, v) of nodes (node, fp, size, digest, cells) to the least and the greatest member of each of their cells, where
    the sets are similar: most of the links that are needed. No cell is gathered anywhere."""
    cells = nodes.select(F.explode("cells").alias("cell"), F.struct("node", "fp", "size", "digest").alias("a"))
    ends = cells.groupBy("cell").agg(F.min("a").alias("least"), F.max("a").alias("most")).filter("least.node < most.node")
    pairs = cells.join(ends, "cell").select("a", F.explode(F.array("least", "most")).alias("b")).filter(_alike("a", "b"))
    return _verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), texts, n)


def common_shingles(df: DataFrame, text: str, n: int) -> np.ndarray:
    """Shingles in more than about PAIRED rows, by a sample of the rows, the least common first. Any answer is right: it is for speed."""
    every = max(1, df.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_pydict({"shingle": pa.array(shingle_set(list(shingle_digests(t.as_py(), n))).view(np.int64))})

    some = df.filter(F.pmod(F.xxhash64(text, F.lit(1)), F.lit(every)) == 0).select(text).mapInArrow(run, "shingle long")
    often = some.groupBy("shingle").count().filter(F.col("count") > max(2, PAIRED // every)).orderBy(F.desc("count"), "shingle").limit(COMMON)
    return np.array([r["shingle"] for r in often.collect()][::-1], np.int64).view(np.uint64)


def _enough(a: str, b: str) -> Column:
    """The least count of rare shingles that two similar sets share in their prefixes. They share (4/9)(s + t) at least, thus as
    many rare ones less the common ones of the set with fewer; of the set whose prefix ends first, those beyond it may be lost."""
    x, y = SIMILARITY
    least = F.ceil(F.lit(x) * (F.col(f"{a}.size") + F.col(f"{b}.size")) / F.lit(x + y) - 1e-6)
    hot = F.least(*(F.col(f"{s}.size") - F.col(f"{s}.rare") for s in (a, b)))
    beyond = F.greatest(*(F.col(f"{s}.rare") - F.least(F.col(f"{s}.rare"), F.expr(f"{s}.size - ({x} * {s}.size + {y - 1}) div {y} + 1")) for s in (a, b)))
    return F.greatest(F.lit(1), least - hot - beyond)


def missed_links(nodes: DataFrame, texts: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """Links (u, v) between fingerprints of all similar nodes (node, fp, size, rare, prefix, digest) that have no common root
    (roots: node, root of fingerprints) yet."""
    x, y = SIMILARITY
    rooted = stage(nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).drop("cells"), "simhash-rooted")
    kinds = F.col("common") & ((x + y) * (F.col("size") - F.col("rare")) >= 2 * x * F.col("size"))

    def exploded(*columns: str) -> DataFrame:
        return rooted.select(F.posexplode("prefix").alias("at", "cell"), "rare", *columns).withColumn("common", F.col("at") >= F.col("rare")).drop("at")

    sizes = exploded("root", "size").groupBy("cell").agg(
        F.count("*").alias("n"), F.sum(_weight()).alias("w"), F.min("root").alias("a"), F.max("root").alias("b"), F.first("common").alias("often"), F.max(kinds).alias("able")
    )
    met = stage(sizes.filter("a < b and (able or not often)").select("cell", "n", "w", "often"), "simhash-met")
    mine = exploded("node").select("cell", "node").join(met, "cell")
    full = stage(mine.join(rooted.select("node", "fp", "root", "size", "rare", "digest"), "node"), "simhash-missed")
    few = full.filter(~F.col("often") & (F.col("n") <= PAIRED)).select("cell", F.struct("node", "fp", "root", "size", "rare", "digest").alias("m"))
    a, b = few.withColumnRenamed("m", "a"), few.withColumnRenamed("m", "b")
    pairs = a.join(b, "cell").filter(F.expr("a.node < b.node and a.root <> b.root") & _alike("a", "b"))
    close = _verified(pairs.groupBy("a", "b").agg(F.count("*").alias("c")).filter(F.col("c") >= _enough("a", "b")), texts, n)
    many = full.filter(F.col("often") | (F.col("n") > PAIRED)).withColumn("k", F.ceil(F.col("w") / SIMILAR_CELL)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")))
    # every two blocks meet: part i * k + j holds blocks i and j, and block i alone if i = j
    to = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: F.least("block", j) * F.col("k") + F.greatest("block", j))
    blocks = many.select("cell", F.explode(to).alias("part"), "block", "node", "fp", "digest", "root")
    crowded = _compared(blocks, texts, n)
    links = stage(close.unionByName(crowded), "simhash-links")
    discard(rooted, met, full, close, crowded)
    return links


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (least node of its component) of every node that has a link, from links u, v."""
    both = stage(edges.select("u", "v").union(edges.select("v", "u")).distinct(), f"{name}-edges")
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), f"{name}-labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("u"), "root"), "u").groupBy(F.col("v").alias("node")).agg(F.min("root").alias("heard"))
        lower = stage(labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root")), f"{name}-heard")
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        before, labels = labels, stage(lower.join(jump, "root").select("node", "old", F.col("next").alias("root")), f"{name}-labels")
        discard(before, lower)
        if labels.filter("root <> old").limit(1).count() == 0:
            discard(both)
            return labels.select("node", "root")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, similar: bool = False) -> DataFrame:
    """key, fp and class_id (the least key of the row's class) of every row; with `similar`, overlapping texts share a class too."""
    rows = set_rows(df, key, text, n, common_shingles(df, text, n)) if similar else fingerprints(df, key, text, n)
    docs = stage(rows, "simhash-docs")
    nodes = stage(docs.groupBy("fp").agg(F.min(key).alias("least")), "simhash-nodes")
    links = near_links(nodes)
    if similar:
        texts = df.select(_digest(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        parts = [F.first(c).alias(c) for c in ("cells", "size", "rare", "prefix")]
        sets = stage(docs.groupBy("node", "fp").agg(F.min("digest").alias("digest"), *parts), "simhash-sets")
        large, docs = docs, stage(docs.select(key, "fp"), "simhash-docs")
        discard(large)
        cheap = similar_links(sets, texts, n)
        links = stage(links.unionByName(cheap), "simhash-links")
        others = missed_links(sets, texts, components(links, "simhash"), n)
        roots = components(links.unionByName(others), "simhash")
        discard(sets, cheap, links, others)
    else:
        roots = components(links, "simhash")
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = rooted.join(lowest, "root").select("fp", "class_id")
    return docs.join(classes, "fp").select(key, "fp", "class_id")


def fp_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """df with one row of each class: the one with the least key, then digest of the text. Rows without a key stay."""
    pair = F.struct(F.col(key).alias("key"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest"))
    row = spare_name(df.columns, "row")
    kept = spare_name([*df.columns, row], "kept")
    keyed = df.filter(F.col(key).isNotNull()).withColumn(row, pair)
    classes = near_duplicates(keyed, row, text, n, similar=True).select(F.col("class_id").alias(kept)).distinct()
    same = (F.col(f"{row}.key") == F.col(f"{kept}.key")) & F.col(f"{row}.digest").eqNullSafe(F.col(f"{kept}.digest"))
    rows = keyed.join(classes, same, "left_semi").dropDuplicates([row]).drop(row)  # repeated rows share key and text
    return rows.unionByName(df.filter(F.col(key).isNull()))
