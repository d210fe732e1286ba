"""Exact top-k against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopygrid.llm import topk


def brute(rows, k):
    rows = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows]
    out = []
    for q, a in rows:
        if q % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in rows if c != q and len(a) == len(b))
        out += [(q, n, c, -s) for n, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize(("n", "dim", "spread"), [(400, 20, 1.0), (120, 3, 0.01), (60, 1, 1.0), (300, 17, 60.0)])
def test_matches_brute_force(spark, n, dim, spread):
    r = np.random.default_rng(n)
    base = r.normal(0, spread, (9, dim))
    rows = [(i, (base[i % 9] + r.normal(0, spread / (i % 4 + 1), dim)).round(3).tolist()) for i in range(n)]
    assert run(spark, rows) == brute(rows, 5)


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 2)
    r = np.random.default_rng(4)
    rows = [(i, r.normal(0, 1, 12).tolist()) for i in range(0, 900, 5)]
    assert run(spark, rows) == brute(rows, 5)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5]), (50, [0.0, 0.0]), (7, [5.0]), (100, [3.0])]
    bad = [(150, None), (200, [nan, 1.0]), (4, [inf, 1.0]), (5, [-inf, 1.0]), (6, [1.0, None]), (None, [1.0, 2.0])]
    twice = [(8, [0.25, 0.25]), (8, [0.25, 0.25])]
    assert run(spark, rows + bad + twice) == brute(rows + twice, 5)


def test_numbers_beyond_floating_point(spark):
    rows = [(0, [2.0**24, 1.0, 3.0]), (1, [2.0**20, 5.0, 1.0]), (2, [2.0**20, 5.0, 1.0 + 2.0**-8]), (3, [-(2.0**21), 0.0, 9.0])]
    assert run(spark, rows) == brute(rows, 5)


def test_queries_that_share_an_id_have_a_list_each(spark):
    import duckdb

    from canopygrid.llm.queries import SQL

    r = np.random.default_rng(2)
    rows = [(i, r.normal(0, 1, 6).round(3).tolist()) for i in (50, 50, 50, *range(1, 40))]
    want = []
    for q, a in rows[:3]:
        fixed = lambda v: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]
        scored = sorted((-sum(x * y for x, y in zip(fixed(a), fixed(b))), c) for c, b in rows if c != q)
        want += [(q, n, c, -s) for n, (s, c) in enumerate(scored[:5], 1)]
    assert run(spark, rows) == sorted(want)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({SQL['op7_top_k']})").fetchall()) == sorted(want)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_bounds_drop_candidates():
    """Candidates whose remaining length cannot lift them are no longer read, and nothing is lost."""
    r = np.random.default_rng(6)
    vectors = np.floor(r.normal(0, 1, (64, 2000)) * (256 * 0.9 ** np.arange(64))[:, None])
    queries, ids = vectors[:, :20].T.copy(), np.arange(2000)
    for q, found, scores in topk.search_block(ids[:20], queries, ids, vectors, 5):
        every = queries[q] @ vectors
        every[q] = -np.inf
        want = np.lexsort((ids, -every))[:5]
        assert found.tolist() == want.tolist() and scores.tolist() == every[want].tolist()
