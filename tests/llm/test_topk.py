"""Exact top-k by inner product: against all products, pruning that takes fewer of them, and hard rows."""

import math

import duckdb
import numpy as np
import pytest

from cairn.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score double, vector string, block int, _row int, key int"


def make(spark, rows, parts=3, kind="double"):
    return spark.createDataFrame([(i, v, 1.0, "x", 2, 3, 4) for i, v in rows], SCHEMA.replace("array<double>", f"array<{kind}>")).repartition(parts)


def plain(rows, k, step):
    """(query_id, rank, vec_id, score) from unbounded integers."""
    usable = [(i, [math.floor(topk.SCALE * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % step == 0}):
        # An id with several vectors is asked with the smallest: for each length of array.
        best = {}
        for width in {len(v) for _, v in usable}:
            own = [list(map(float, v)) for i, v in rows if i == q and v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
            if own:
                asked = [math.floor(topk.SCALE * x) for x in min(own)]
                for i, v in usable:
                    if i != q and len(v) == width:
                        s = max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(asked, v))))
                        best[i] = max(best.get(i, s), s)
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


def found(spark, rows, k=10, step=100, **more):
    return sorted(tuple(r) for r in topk.search(make(spark, rows, **more), k, step).collect())


def clustered(seed, n, width, noise, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    x = centres[rng.integers(0, 8, n)] + noise * rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(spread * rng.normal(size=(n, 1)))


@pytest.mark.parametrize(("noise", "spread"), [(0.05, 0.0), (0.1, 0.4), (3.0, 0.02), (1.0, 1.5)])
def test_equals_all_products(spark, monkeypatch, noise, spread):
    monkeypatch.setattr(topk, "RUN_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 16 * 8 * 150)  # several buckets and blocks of queries
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(3, 900, 16, noise, spread))]
    assert found(spark, rows, 10, 3) == plain(rows, 10, 3)


def test_pruning_takes_fewer_products_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(topk, "RUN_ROWS", 128)
    for noise, spread, most in ((0.03, 0.0, 0.4), (1.0, 0.8, 0.5)):  # by coordinates; by length
        x = np.floor(1024 * clustered(5, 3000, 24, noise, spread))
        ids = np.arange(3000)
        best, taken = topk.search_bucket(ids[::30], x[::30], np.full(100, -np.inf), ids, x, 5)
        assert taken < most * 100 * 3000
        for b, q in zip(best, x[::30]):
            scores = (x @ q).astype(int)
            scores[b.own] = -(1 << 62)
            order = np.lexsort((ids, -scores))[:5]
            assert b.ids.tolist() == ids[order].tolist() and b.scores.tolist() == scores[order].tolist()


def test_coordinate_bounds_hold():
    rng = np.random.default_rng(2)
    x = clustered(8, 2000, 6, 0.3, 0.0)
    run = topk.Run(np.arange(2000), x, topk.lengths(x))
    run.norms = np.linalg.norm(x, axis=1)
    for c in (0.7, 0.9, 0.99, 1.0):
        for q in x[rng.integers(0, 2000, 40)]:
            assert set(np.flatnonzero(x @ q >= c)) <= set(run.candidates(q, c).tolist())


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (6, [0.0, 0.0]), (7, [-1.0, -0.5]), (8, [0.9999, 0.5]), (None, [5.0, 5.0])]
    rows += [(9, [1e200, 0.0]), (10, [1e-300, -1e-300]), (11, [1.0, 2.0, 3.0]), (100, [3.0, 2.0, 1.0]), (12, []), (200, []), (300, [0.0, 0.0]), (400, [2.0, 1.0]), (400, [-2.0, 1.0]), (-100, [1e10, 1e10]), (13, [1.5e305, 0.0])]
    assert found(spark, rows, 4) == plain(rows, 4, 100)
    assert found(spark, []) == [] and found(spark, [(1, [1.0]), (2, [2.0])]) == [] and found(spark, [(0, [1.0])]) == []


def test_ties_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 4 * 100)
    rows = [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(400)] + [(400 + i, [0.5, 0.5, 0.5, 0.4]) for i in range(300)] + [(5, [0.5, 0.5, 0.5, 0.5])] * 300
    assert found(spark, rows, 7, 50) == plain(rows, 7, 50)
    assert found(spark, rows[:20], 50, 10, kind="float") == plain(rows[:20], 50, 10)


def test_equals_sql(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(4, 500, 8, 0.5, 0.3).astype(np.float32).astype(float))] + [(1000, None), (1001, [None] * 8)]
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(con.sql(topk.ORACLE).fetchall()) == found(spark, rows, kind="float")
