import numpy as np
import pytest

from clausewright.llm.rankwalk import rank_by_walk, walk


def matrix_walk(values, damping=0.85, steps=300):
    v = np.where(np.isnan(values), -np.inf, values)
    n, m = v.shape
    p, move = np.full(n, 1 / n), np.zeros((n, n))
    for s in range(m):
        higher = (v[None, :, s] > v[:, None, s]) / n
        move += (higher + np.diag(1 - higher.sum(1))) / m
    for _ in range(steps):
        p = (1 - damping) / n + damping * p @ move
    return p


def test_prefix_sums_equal_the_matrix():
    rng = np.random.default_rng(5)
    parts = [np.round(rng.normal(size=(n, 3)), 1) for n in (1, 7, 30)]
    parts[2][rng.random((30, 3)) < 0.2] = np.nan
    groups = np.repeat([0, 1, 2], [1, 7, 30])
    got = walk(np.vstack(parts), groups, steps=300)
    assert np.allclose(got, np.concatenate([matrix_walk(p) for p in parts]), atol=1e-10)


def test_scale_does_not_count(spark):
    rows = [(1, i, float(i), 1000.0 - i * i) for i in range(8)]
    a = spark.createDataFrame(rows, "q long, item long, x double, y double")
    b = spark.createDataFrame([(q, i, x * 1e6 - 5, y / 1e9) for q, i, x, y in rows], a.schema)
    pick = lambda df: [(r.item, r["rank"]) for r in rank_by_walk(df, "q", "item", ["x", "y"]).orderBy("rank").collect()]
    assert pick(a) == pick(b)


def test_large_groups_give_the_same(spark):
    rng = np.random.default_rng(2)
    rows = [(q, i, float(np.round(rng.normal(), 1)), None if rng.random() < 0.3 else float(rng.normal())) for q, n in ((1, 25), (2, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "q long, item long, x double, y double")
    local = {(r.q, r.item): (round(r.share, 10), r["rank"]) for r in rank_by_walk(df, "q", "item", ["x", "y"], steps=6).collect()}
    spread = {(r.q, r.item): (round(r.share, 10), r["rank"]) for r in rank_by_walk(df, "q", "item", ["x", "y"], steps=6, local_items=4).collect()}
    assert local == spread


def test_nulls_repeats_and_empty(spark):
    rows = [(1, 1, None, 9), (1, 1, 5.0, 9), (1, 2, None, 9), (None, 3, 1.0, 9), (2, 4, float("nan"), 9)]
    df = spark.createDataFrame(rows, "q long, item long, x double, share int")
    out = {(r.q, r.item): r["rank"] for r in rank_by_walk(df, "q", "item", ["x"]).collect()}
    assert out == {(1, 1): 1, (1, 2): 2, (None, 3): 1, (2, 4): 1}
    assert rank_by_walk(df.limit(0), "q", "item", ["x"]).count() == 0
    with pytest.raises(ValueError):
        rank_by_walk(df, "q", "item", [])
