"""Spelling variants against plain Python over the same rows; the registered query against SQL is in test_pipeline.py."""

import random
import re
import zlib
from collections import Counter

import pytest
from conftest import *  # noqa: F403

from skeinwork.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(rows, shortest=7, least=2, times=10):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    out = {}
    for w, n in counts.items():
        close = sorted((-m, v) for v, m in counts.items() if near(v, w))
        form = close[0][1] if close and -close[0][0] >= times * n else None
        out[w] = [w, form, w, n, len(close), counts[form] if form else None]
    for w, row in out.items():
        while out[row[2]][1]:
            row[2] = out[row[2]][1]
    return sorted(map(tuple, out.values()))


def test_near():
    assert near("abc", "abd") and near("abc", "ab") and near("abc", "xabc") and not near("abc", "abc") and not near("abc", "bcd") and not near("ab", "abcd")


@pytest.fixture(scope="module")
def misspelt(spark):
    rng = random.Random(4)
    stems = ["kitchens", "kitchéns", "ablution", "aaaaaaaa", "abababab", "zzxyzzxy", "Ýpsilons", "recordings"]
    words = [w for k, s in enumerate(stems) for w in [s] * (4000 if k == 0 else 60)]
    for s in stems:
        for _ in range(60):
            i, c = rng.randrange(len(s) + 1), rng.choice("abkxyé")
            words += [rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]])] * rng.choice([1, 2, 2, 3, 30])
    words += ["kitchenss"] * 300 + ["kitchensss"] * 20 + ["kitchenssss"] * 2 + ["÷÷÷×××÷÷"] * 3
    rng.shuffle(words)
    rows = [(k // 40, " ".join(words[k : k + 40])) for k in range(0, len(words), 40)]
    return rows + [(None, "kitchens recordings"), (None, "kitchens recordings"), (7, None), (8, ""), (9, "1 2, .")]


@pytest.mark.parametrize("crowded", [200, 2, 0])
def test_against_plain_python(spark, misspelt, monkeypatch, crowded):
    monkeypatch.setattr(spelling, "CROWDED", crowded)
    df = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in misspelt], "doc_id long, text string, word string, n int, key int").repartition(3)
    got = sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(df).collect())
    want = plain(misspelt)
    assert got == want
    assert len({r[2] for r in want}) < len(want) and any(r[1] not in (None, r[2]) for r in want)


def test_short_words_and_no_rows(spark, no_docs):
    rows = [(1, "a b ab abc abd bc xbc a b ab abc abd bc xbc"), (2, "ab ab abcd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spelling.near_pairs(spelling.vocabulary(df, shortest=4, least=1))
    assert pairs.count() == 0
    assert spelling.variants(no_docs).count() == 0
