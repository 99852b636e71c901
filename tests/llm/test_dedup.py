"""SimHash classes, repeated bytes and repeated words against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import *  # noqa: F403

from skeinwork.llm import _repeats, fmdedup, simhash, suffixdedup


def plain_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    s = [w[i : i + n] for i in range(len(w) - n + 1)] or ([w] if w else [])
    h = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(fps):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def check_classes(rows, got):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = classes(fps)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    want = sorted((i if i is not None else -1, f, least[r] if least[r] is not None else -1) for (i, _), f, r in zip(rows, fps, root))
    assert sorted((r[0] if r[0] is not None else -1, r[1] % (1 << 64), r[2] if r[2] is not None else -1) for r in got) == want


def test_simhash_classes(docs, odd_docs, no_docs):
    check_classes(odd_docs, simhash.near_duplicates(docs).collect())
    assert simhash.near_duplicates(no_docs).count() == 0


def test_links_of_planted_fingerprints(spark, monkeypatch):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for f in base:
        for _ in range(rng.randint(0, 12)):
            fps.add(f ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 3))}))
    chain = rng.getrandbits(64)
    for k in range(0, 60, 2):
        chain ^= 3 << k
        fps.add(chain)
    fps = sorted(fps)
    want = classes(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for cell, small in ((simhash.CELL, simhash.SMALL), (3, 4)):
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "SMALL", small)
        found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.near_links(nodes)).collect()}
        groups, same = {}, {}
        for f, w in zip(fps, want):
            groups.setdefault(w, set()).add(f)
            same.setdefault(found.get(f, f), set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, same.values()))


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


@pytest.mark.parametrize("crowd", [4000, 5])
def test_similar_texts_share_a_class(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "SIMILAR_CELL", crowd)
    rng = random.Random(7)
    rows, groups = [], []
    for g in range(12):
        w = [f"{rng.choice(WORDS)}{rng.randint(0, 99)}" for _ in range(300)]  # noqa: F405
        for c in range(4):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(300)] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(v)))
            groups.append(g)
        rows.append((len(rows), " ".join(w[:150] + [f"own{i}{g}" for i in range(150)])))  # a third in common
        groups.append(100 + g)
    got = {r["doc_id"]: r["class_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=5, similar=True).collect()}
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            x, y = shingles(a), shingles(b)
            if groups[i] == groups[j] and len(x & y) / len(x | y) >= 0.85:
                assert got[i] == got[j]
            if groups[i] != groups[j]:
                assert got[i] != got[j]


def similar_classes(rows, n=5):
    """Class of each text: pairs of 0.8 or more of the shingles, or two bits."""
    sets, fps = [shingles(t, n) for _, t in rows], [plain_fingerprint(t, n) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and (9 * both >= 4 * (len(sets[i]) + len(sets[j])) or bin(fps[i] ^ fps[j]).count("1") <= 2):
                root = [root[j] if r == root[i] else r for r in root]
    return partition(rows, root)


def partition(rows, label):
    groups = {}
    for (key, _), r in zip(rows, label):
        groups.setdefault(r, []).append(key)
    return sorted(map(sorted, groups.values()))


def found_classes(spark, rows):
    got = {r["doc_id"]: r["class_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=5, similar=True).collect()}
    return partition(rows, [got[i] for i, _ in rows])


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.random()}"
    return words


@pytest.mark.parametrize("pairs, crowd, shared", [(100, 10, 300), (100, 10, 350), (2, 3, 385)])
def test_similar_texts_around_one_template(spark, monkeypatch, pairs, crowd, shared):
    """Every cell of min-hashes is crowded by texts that share a template; their copies are found all the same."""
    monkeypatch.setattr(simhash, "SIMILAR_CELL", crowd)
    monkeypatch.setattr(simhash, "PAIRED", pairs, raising=False)
    rng = random.Random(3)
    template, texts = [f"t{rng.random()}" for _ in range(shared)], []
    for _ in range(60):
        own = [f"own{rng.random()}" for _ in range(404 - shared)]
        texts += [template + own, template[: shared // 2] + ["x"] + template[shared // 2 :] + edited(rng, own, (404 - shared) // 20)]
    texts += [template, template[:-30], template[: shared * 4 // 5 + 2]]
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    assert found_classes(spark, rows) == similar_classes(rows)


def test_repeated_line_does_not_hide_similar_texts(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        w = [f"{rng.choice(WORDS)}{rng.random()}" for _ in range(1000)]  # noqa: F405
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:500] + w[480:500] * 45 + w[500:]))]
    assert any(bin(plain_fingerprint(a[1], 5) ^ plain_fingerprint(b[1], 5)).count("1") > 24 for a, b in zip(rows[::2], rows[1::2]))
    assert found_classes(spark, rows) == similar_classes(rows)


def test_overlap_is_exact(spark):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        w = [f"{rng.choice(WORDS)}{rng.random()}" for _ in range(304)]  # noqa: F405
        lost = 28 + k % 12  # of 300 shingles; a third part of the pairs has 0.80 or a little more, a third a little less
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: 304 - lost] + [f"own{rng.random()}" for _ in range(lost)]))]
    assert found_classes(spark, rows) == similar_classes(rows)


def test_texts_of_one_fingerprint_are_searched_each(spark):
    rng = random.Random(6)
    line = [f"l{rng.random()}" for _ in range(21)]
    own = [[f"own{rng.random()}" for _ in range(200)] for _ in range(3)]
    rows = [(k, " ".join(line * 200 + o)) for k, o in enumerate(own)] + [(10 + k, " ".join(line + o)) for k, o in enumerate(own)]
    assert len({plain_fingerprint(t, 5) for _, t in rows[:3]}) == 1
    assert found_classes(spark, rows) == similar_classes(rows) == [[0, 1, 2, 10, 11, 12]]


def test_different_texts_of_one_id_stay(spark):
    rng = random.Random(8)
    a, b = (" ".join(f"{rng.choice(WORDS)}{rng.random()}" for _ in range(100)) for _ in range(2))  # noqa: F405
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b + " tail"), (None, a), (4, None), (4, "")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, a), (1, b), (None, a), (4, None)]))


def test_long_texts_have_the_plain_fingerprint():
    text = prose(random.Random(2), simhash.RUN + 500)  # noqa: F405
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_linked_fingerprints_meet_at_a_home():
    """Every pair within two bits meets in a cell that is home to one of them, and copies are bounded."""
    rng = np.random.default_rng(4)
    steps = {tuple(s) for s in simhash._steps().tolist()}
    assert simhash.COPIES == 21
    x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64))
    a, b = simhash.coordinates(x), simhash.coordinates(y)
    assert (a.sum(axis=1) == np.bitwise_count(x)).all()
    for p, q in zip(a.tolist(), b.tolist()):
        d = tuple(j - i for i, j in zip(p, q))
        assert d in steps or tuple(-k for k in d) in steps


def test_pivot_table_never_discards_a_link():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    for r in simhash.references():
        assert np.abs(np.bitwise_count(x ^ r).astype(int) - np.bitwise_count(y ^ r).astype(int)).max() <= 2


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(1500):
        n, top = rng.randint(0, 40), rng.choice([1, 2, 3, 10])
        s = [rng.randint(0, top) for _ in range(n)]
        s = (s[:5] * 9)[:n] if rng.random() < 0.3 else s
        assert suffixdedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def repeated_bytes(rows, width=400):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for (key, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((key if key is not None else -1, len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out)


def repeated_words(rows, width=20):
    order = sorted({(i if i is not None else 1 << 70, t or "") for i, t in rows})
    seen, result = set(), {}
    for i, t in order:
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            h = tuple(w[k : k + width])
            if h in seen:
                gone[k : k + width] = [True] * width
            seen.add(h)
        result[i, t] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return sorted((i if i is not None else -1, *result[i if i is not None else 1 << 70, t or ""]) for i, t in rows)


def plain(rows):
    return sorted(tuple(-1 if v is None else v for v in r) for r in rows)


@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeats(docs, odd_docs, monkeypatch, hot):
    monkeypatch.setattr(_repeats, "HOT", hot)
    assert plain(suffixdedup.remove_repeats(docs).collect()) == repeated_bytes(odd_docs)
    assert plain(fmdedup.remove_repeats(docs).collect()) == repeated_words(odd_docs)


def test_repeats_in_parts(docs, odd_docs, monkeypatch):
    monkeypatch.setattr(_repeats, "PART", 700)
    from skeinwork.llm import _repeats as again

    assert list(again.parts(1500, 400)) == [(0, 1099), (700, 1500)]


def test_repeats_of_nothing(no_docs):
    assert suffixdedup.remove_repeats(no_docs).count() == 0 and fmdedup.remove_repeats(no_docs).count() == 0 and fmdedup.clean_texts(no_docs).count() == 0


def test_clean_texts_keeps_columns(docs, odd_docs):
    got = fmdedup.clean_texts(docs)
    assert got.columns == docs.columns and got.count() == len(odd_docs)
    texts = {r["doc_id"]: r["text"] for r in got.collect() if r["doc_id"] in (3, 5, 6, 31)}
    source = dict(odd_docs)
    assert texts[3] == source[3] and texts[5] == source[5] and texts[6] == "" and texts[31] == source[31]


def test_spans_are_the_texts(docs, odd_docs):
    rows = suffixdedup.repeated_spans(docs).collect()
    by = {hashlib.md5((t or "").encode()).digest(): (t or "").encode() for _, t in odd_docs}
    for r in rows:
        d = by[bytes(r["tid"])]
        gone = sum(s["end"] - s["start"] for s in r["spans"])
        assert len(r["kept"]) == len(d) - gone and all(s["end"] - s["start"] >= 400 for s in r["spans"])


def test_wavelet_rank_and_backward_search():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 9, 300)
    m = fmdedup.WaveletMatrix(v)
    for c in range(9):
        at = np.arange(301)
        assert (m.rank(np.full(301, c), at) == np.array([(v[:k] == c).sum() for k in at])).all()
    s = np.append(rng.integers(1, 4, 200), 0)
    index, full = fmdedup.FMIndex(s, 5), np.append(s, 0)
    suffixes = fmdedup._suffixes(full, 6)[0]
    for start in range(190):
        lo, hi = np.array([0]), np.array([index.size])
        for k in range(4, -1, -1):
            lo, hi = index.extend(lo, hi, s[[start + k]])
        assert sorted(suffixes[lo[0] : hi[0]]) == [i for i in range(196) if (s[i : i + 5] == s[start : start + 5]).all()]
        short = index.shorten(lo)
        assert sorted(suffixes[short[0][0] : short[1][0]]) == [i for i in range(197) if (s[i : i + 4] == s[start : start + 4]).all()]
    assert sum(r.words.nbytes + r.before.nbytes for r in index.bwt.rows) <= index.bwt.digits * (len(full) * 3 / 16 + 16)


@pytest.mark.parametrize("seed", range(4))
def test_byte_index_against_plain_python(seed):
    """Windows count as equal if they lie alike to block borders; few letters, zero bytes among them, make every kind of neighbour."""
    rng = random.Random(seed)
    for _ in range(150):
        width, block = rng.choice([(40, 8), (24, 8), (50, 16), (33, 8), (16, 4), (400, 32)])
        letters = rng.choice([b"\0a", b"ab", b"abcdef", b"\0\1", b"a"])
        pool = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 3 * width))) for _ in range(3)]
        data = [b"".join(rng.choice(pool)[rng.randint(0, 5) :] if rng.random() < 0.7 else bytes(rng.choice(letters) for _ in range(rng.randint(0, width))) for _ in range(rng.randint(1, 4))) for _ in range(8)]
        data = [d for d in data if len(d) >= width]
        marks, times = np.array([rng.randrange(block) for _ in data], int), np.array([rng.choice([1, 1, 1, 2]) for _ in data], int)
        windows = np.array([len(d) - width + 1 for d in data], int)
        seen = Counter((d[i : i + width], (i - m) % block) for d, m in zip(data, marks) for i in range(len(d) - width + 1))
        want = [[n > 1 or seen[d[i : i + width], (i - m) % block] > 1 for i in range(w)] for d, m, w, n in zip(data, marks, windows, times)]
        assert [g.tolist() for g in suffixdedup.byte_index(data, marks, windows, times, width, block)] == want
