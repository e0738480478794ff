from __future__ import annotations

import math
import random

import numpy as np
import pytest

from webquarry.llm import topk as K

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, queries, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = [math.floor(64 * x) for x in v]
    out = {}
    for q in queries:
        if q in ok:
            s = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
            out[q] = [(i, -x) for x, i in s]
    return out


@pytest.fixture
def rows():
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a group of equal vectors
    rows += [(2000, None), (2001, [None] * 16), (2002, [math.nan] * 16), (2003, [math.inf] + [0.0] * 15), (2004, []), (2005, [0.5] * 8), (None, [1.0] * 16)]
    return rows


def as_lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("block", [8192, 50])
def test_matches_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "QUERY_BLOCK", 40)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).selectExpr("*", "0 AS id", "0 AS v", "1 AS cell")
    got = as_lists(K.top_k(df, df.filter("vec_id % 20 = 0"), 20))
    ids = [i for i, _ in rows if i is not None and i % 20 == 0]
    assert got == brute(rows, ids, 20)


def test_repeats_few_and_none(spark):
    one = spark.createDataFrame([(1, [0.1, 0.2], 1), (1, [0.1, 0.2], 1), (2, [0.3, 0.1], 1), (20, [0.5, 0.5], 2)], SCHEMA)
    assert as_lists(K.top_k(one, one.filter("vec_id = 20"), 20)) == brute([(1, [0.1, 0.2]), (2, [0.3, 0.1]), (20, [0.5, 0.5])], [20], 20)
    assert K.top_k(one.limit(0), one.limit(0), 5).count() == 0


def test_large_numbers_stay_exact():
    rows = np.array([[2.0**40, 1.0], [3.0, 2.0**30]])
    assert list(K.exact_products(rows, np.array([2.0**20 + 1, 3.0]), 2.0**40)) == [2**40 * (2**20 + 1) + 3, 3 * (2**20 + 1) + 3 * 2**30]


def test_elimination_skips_far_clusters():
    rng = np.random.default_rng(1)
    centres = np.eye(8)[:, :8] * 500
    rows = np.floor(np.repeat(centres, 500, axis=0) + rng.normal(0, 3, (4000, 8)))
    pivots = K.choose_pivots(rows[::50], 16)
    block = K.Block(np.arange(4000), rows, pivots, 20)
    best, evaluated = block.top(0, rows[0], K._distances(rows[:1], pivots)[0], -np.inf)
    assert evaluated < 2000
    assert [b[1] for b in best] == [i for _, i in sorted((-int(rows[i] @ rows[0]), i) for i in range(1, 4000))[:20]]


def test_cells_that_cannot_rank_are_not_met(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 100)
    rng = np.random.default_rng(2)
    rows = [(i, (np.eye(12)[i % 12] * 9 + rng.normal(0, 0.05, 12)).tolist()) for i in range(1200)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    met, written = [], K.C.written

    def spy(frame, label):
        out = written(frame, label)
        if label == "queries":
            met.append(out.selectExpr("sum(size(cells)) AS n").first().n / out.count())
        return out

    monkeypatch.setattr(K.C, "written", spy)
    got = as_lists(K.top_k(df, df.filter("vec_id % 20 = 0"), 20))
    assert got == brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert met[0] <= 4  # of 24 cells


def test_queries_that_are_no_candidates(spark):
    df = spark.createDataFrame([(i, [0.1 * i, 1.0], 1) for i in range(50)], SCHEMA)
    asked = spark.createDataFrame([(1000, [0.5, -0.5, 2.0], 1)], SCHEMA)
    got = as_lists(K.top_k(df, asked, 3))
    assert list(got) == [1000] and [i for i, _ in got[1000]] == [49, 48, 47]
    assert K.top_k(df.limit(0), asked, 3).count() == 0
