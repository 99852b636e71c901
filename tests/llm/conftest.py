import random

import pytest

DATA = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ba", "ko", "ri", "tu", "me", "so") for b in ("ner", "lat", "dim", "gos", "wer", "pan", "il")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs():
    """(doc_id, text): nulls, empties, white space, ties, exact and near copies, shared passages, periodic and long texts."""
    rng = random.Random(11)
    shared, base = prose(rng, 90), prose(rng, 150)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, base), (6, base), (7, base + " tail"), (8, base.replace("banner", "bannir", 1)), (None, prose(rng, 60)), (None, base)]
    rows += [(10 + i, f"{prose(rng, rng.randint(0, 80))} {shared} {prose(rng, rng.randint(0, 80))}") for i in range(6)]
    rows += [(30, "la " * 400), (31, prose(rng, 4000)), (32, "é ü ☃ 日本 " * 60), (33, "x" * 1500), (34, "\n".join([base] * 3))]
    return rows + [(4, "one"), (40, prose(rng, 30) + "  \n " + prose(rng, 30))]


@pytest.fixture(scope="session")
def docs(spark, odd_docs):
    """The rows with extra columns whose names clash with results and helpers."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "k") for i, t in odd_docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, tid string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
