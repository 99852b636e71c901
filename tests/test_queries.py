"""The library's queries against their SQL on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from skeinwork.plans import lexical_queries, registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cursor = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_gold_of_short_items(spark, tmp_path):
    docs = [(1, "the heart beats"), (2, "heart, heart and lung"), (3, "a lung"), (4, "no such"), (5, None), (6, "")]
    items = [(1, "heart"), (2, "a lung"), (3, "heart, heart"), (4, "heart beats"), (5, "the heart beats"), (6, "..."), (7, ", "), (8, None), (9, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted((i, d) for i, q in items for d, t in docs if q is not None and t is not None and q in t)
    assert sorted(map(tuple, lexical_queries.gold(spark, str(tmp_path)).collect())) == want


def test_round_context_gives_the_last_round(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "nobody replies"), (2, 0, "user", "alone")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["round_context"](spark, str(tmp_path)).collect()
    assert [(r["conv_id"], r["last_round"]) for r in got] == [(1, 2)]
    assert "last_round" in registry.ORACLES["round_context"]


def test_judged_contexts_are_compared_by_bytes(spark, tmp_path):
    rows = [(1, 0, "abcdefgh"), (1, 1, "abcdéèêë"), (1, 2, "abcdezzz"), (1, 3, "日本語"), (2, 0, "éèêë"), (2, 1, "éèab"), (2, 2, "éèêabcde")]
    rows += [(3, 0, "abcd"), (3, 1, None), (3, 2, "abcx"), (3, None, "abcy"), (4, 0, None), (4, 1, "abcd"), (5, 0, None), (5, 1, ""), (5, 2, "a"), (6, 0, ""), (6, 1, None), (7, None, "abcd"), (7, 3, "wxyz"), (None, 1, "a")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in c.execute(registry.ORACLES["judged_context_scores"]).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in registry.QUERIES["judged_context_scores"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 8 and want[1] == (0.5, 1.0)


def test_top_lists_with_a_cap_leave_no_candidate_out(spark, tmp_path):
    rows = [(i, [1.0 + i / 1e4, 0.1], 0) for i in range(120)] + [(200 + i, [0.9, 0.2 + i / 1e3], 1 + i // 2) for i in range(12)] + [(300 + i, [-1.0, -0.5 - i / 1e3], 9) for i in range(140)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    name = "vec_topk_centered_floor_cap"
    want = sorted(map(tuple, c.execute(registry.ORACLES[name]).fetchall()))
    got = registry.QUERIES[name](spark, str(tmp_path))
    plain_rows = lambda found: sorted((q, i, d, round(s, 5), k) for q, i, d, s, k in found)
    assert plain_rows(map(tuple, got.collect())) == plain_rows(want)
    assert [r["document"] for r in got.filter("query_id = 0").orderBy("rank").collect()] == [0, 0, 0, 1, 1, 2, 2, 3]
