import numpy as np

from clausewright.llm import vptree
from clausewright.llm.vptree import VpRule, mutual, nearest


def brute(ids, x, k, floor=-1.0):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= floor), key=lambda j: (-round(s[i, j], 6), ids[j]))
        out |= {(ids[i], ids[j]) for j in order[:k]}
    return out


def data(seed=4, n=300, dim=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2 :] = x[: n - n // 2] + rng.normal(scale=0.05, size=(n - n // 2, dim))
    return list(range(0, 3 * n, 3)), x * rng.uniform(0.1, 9, (n, 1))


def frame(spark, ids, x, *more):
    return spark.createDataFrame([(i, [float(a) for a in v], "z") for i, v in zip(ids, x)] + list(more), "id long, v array<float>, cosine string")


def test_factor_one_is_exact(spark):
    ids, x = data()
    for rule in (VpRule(dim=8, leaf=10), VpRule(dim=8, leaf=10, shard_rows=60), VpRule(dim=8, leaf=7, shard_rows=40, min_cosine=0.9, k=3)):
        got = {(r.id, r.neighbour) for r in nearest(frame(spark, ids, x), "id", "v", rule).collect()}
        assert got == brute(ids, x, rule.k, rule.min_cosine)


def test_relaxed_search_keeps_most(spark):
    ids, x = data(9, 400, 16)
    rule = VpRule(dim=16, leaf=20, shard_rows=100, min_cosine=0.9, factor=0.4)
    got = {(r.id, r.neighbour) for r in nearest(frame(spark, ids, x), "id", "v", rule).collect()}
    want = brute(ids, x, 5, 0.9)
    assert got <= want and len(got) >= 0.9 * len(want)


def test_query_set_and_mutual(spark):
    ids, x = data(1, 120)
    df = frame(spark, ids, x)
    got = {(r.id, r.neighbour) for r in nearest(df, "id", "v", VpRule(dim=8), df.where("id % 100 = 0")).collect()}
    assert got == {p for p in brute(ids, x, 5) if p[0] % 100 == 0}
    near = nearest(df, "id", "v", VpRule(dim=8))
    all_of = brute(ids, x, 5)
    assert {(r.a, r.b) for r in mutual(near, "id").collect()} == {(a, b) for a, b in all_of if a < b and (b, a) in all_of}


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    more = [(1, None, "z"), (2, [1.0], "z"), (4, [0.0] * 8, "z"), (5, [nan] * 8, "z"), (7, [inf] * 8, "z"), (None, [1.0] * 8, "z"), (8, [None] * 8, "z")]
    ids, x = data(2, 6)
    df = frame(spark, ids, x, *more)
    df = df.unionByName(df.limit(3))
    rows = nearest(df, "id", "v", VpRule(dim=8)).collect()
    assert {r.id for r in rows} == set(ids) and len(rows) == 30
    assert nearest(df.limit(0), "id", "v", VpRule(dim=8)).count() == 0
    one = spark.createDataFrame([(1, [1.0] * 8)], "id long, v array<float>")
    assert nearest(one, "id", "v", VpRule(dim=8)).count() == 0


def test_equal_neighbours_rank_by_id(spark):
    rng = np.random.default_rng(3)
    family, other = rng.normal(size=(2, 8)), rng.normal(size=(60, 8))
    ids = [int(i) for i in rng.permutation(100)]
    rows = [(i, [float(x) for x in (family[k % 2] if k < 40 else other[k - 40])]) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    for rule in (VpRule(dim=8, leaf=6), VpRule(dim=8, leaf=64), VpRule(dim=8, leaf=6, shard_rows=30), VpRule(dim=8, leaf=6, min_cosine=0.9)):
        got = {(r.id, r["rank"]): r.neighbour for r in nearest(df, "id", "v", rule).collect()}
        for side in (0, 1):
            members = sorted(i for k, i in enumerate(ids[:40]) if k % 2 == side)
            for i in members:
                assert [got[i, n] for n in range(1, 6)] == [m for m in members if m != i][:5]


def test_pair_rule_finds_planted_pairs_of_the_lowest_band():
    from clausewright.llm.queries import PAIR_RULE
    from clausewright.llm.vptree import Tree

    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(20_000, 64)), rng.normal(size=(1_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = x[:1_000]
    g -= (g * p).sum(1, keepdims=True) * p
    c = rng.uniform(0.851, 0.87, (1_000, 1))
    q = c * p + np.sqrt(1 - c**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    _, who = Tree(x.astype(np.float32), PAIR_RULE).search(q.astype(np.float32), np.full(1_000, -1))
    assert (who == np.arange(1_000)[:, None]).any(1).mean() > 0.998


def test_a_third_of_all_vectors_equal(spark):
    """Copies are one vector in the trees; each has the least ids of the others as neighbours."""
    rng = np.random.default_rng(8)
    same, x = rng.normal(size=8), rng.normal(size=(120, 8))
    ids = [int(i) for i in rng.permutation(180)]
    rows = [(i, [float(a) for a in (same if k < 60 else x[k - 60])]) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    want = brute([i for i, _ in rows], np.array([v for _, v in rows]), 5)
    for rule in (VpRule(dim=8, leaf=10), VpRule(dim=8, leaf=10, shard_rows=30, part_queries=20)):
        assert {(r.id, r.neighbour) for r in nearest(df, "id", "v", rule).collect()} == want
        got = nearest(df, "id", "v", rule, df.where("id % 4 = 0")).collect()
        assert {(r.id, r.neighbour) for r in got} == {p for p in want if p[0] % 4 == 0}
        assert sorted((r.id, r["rank"]) for r in got) == sorted((i, n) for i in range(0, 180, 4) for n in range(1, 6))


def test_what_travels_is_bounded():
    """Unstructured vectors go to most shards, of which there once were more with every doubling of the input."""
    from clausewright.llm.queries import PAIR_RULE

    rng = np.random.default_rng(6)
    x = rng.normal(size=(8_192, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    for n in (59_049, 590_490, 2_500_000, 12_500_000):
        depth = vptree._depth(n, PAIR_RULE)
        held, asking = np.zeros(2**depth), np.zeros(2**depth)
        router = vptree.Router(x, depth, PAIR_RULE)
        for into, margin in ((held, 0.0), (asking, PAIR_RULE.factor * PAIR_RULE.reach)):
            for shard, rows in router.route(x, margin):
                into[shard - 2**depth] = len(rows) * n / len(x)
        parts, rounds = vptree._rounds(held, asking, PAIR_RULE)
        assert [i for r in rounds for i in r] == list(range(2**depth))
        sent = held * parts + asking
        assert max(sent[r.start : r.stop].sum() for r in rounds) <= max(PAIR_RULE.round_rows, PAIR_RULE.round_copies * n)
        assert asking.sum() / n <= max(16, 2 * n / PAIR_RULE.most_shard_rows)
        for r in rounds:
            want = [(s, rows) for s, rows in router.route(x, 0.1) if s - 2**depth in r]
            got = router.route(x, 0.1, range(2**depth + r.start, 2**depth + r.stop))
            assert [s for s, _ in got] == [s for s, _ in want] and all((a == b).all() for (_, a), (_, b) in zip(got, want))


def test_rounds_find_the_same_and_leave_no_shuffle_files(spark, monkeypatch):
    dropped = []

    def files():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        all_ = disk.getAllFiles()
        return {all_.apply(i).getName() for i in range(all_.length()) if all_.apply(i).getName().startswith("shuffle_")}

    def drop(df):
        before = files()
        real(df)
        dropped.append(len(before - files()))

    real = vptree.drop_shuffles
    monkeypatch.setattr(vptree, "drop_shuffles", drop)
    ids, x = data()
    for more in ({}, {"min_cosine": 0.9, "k": 3}, {"part_queries": 20}):
        rule = VpRule(dim=8, leaf=10, shard_rows=40, round_rows=1, round_copies=1.0, **more)
        dropped.clear()
        df = frame(spark, ids, x)
        assert {(r.id, r.neighbour) for r in nearest(df, "id", "v", rule).collect()} == brute(ids, x, rule.k, rule.min_cosine)
        assert len(dropped) >= 4 and all(dropped)
        got = {(r.id, r.neighbour) for r in nearest(df, "id", "v", rule, df.where("id % 4 = 0")).collect()}
        assert got == {p for p in brute(ids, x, rule.k, rule.min_cosine) if p[0] % 4 == 0}


def test_sketches_lose_nothing():
    """Vectors along one axis, on which any fixed choice of entries would see nothing, and their like."""
    rng = np.random.default_rng(5)
    for spread in (np.ones(64), np.r_[np.full(60, 0.02), np.ones(4)], np.r_[np.ones(4), np.full(60, 0.02)]):
        x = rng.normal(size=(3_000, 64)) * spread
        x[1_500:] = x[:1_500] + rng.normal(size=(1_500, 64)) * spread * 0.4
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        tree = vptree.Tree(x, VpRule(min_cosine=0.85, leaf=100))
        assert tree.heads is not None and ((tree.heads @ tree.heads.T) >= tree.rows @ tree.rows.T - vptree.Sketch.SLACK).all()
        cos, who = tree.search(x, np.arange(3_000))
        s = np.where(np.eye(3_000, dtype=bool), -2, x @ x.T)
        want = -np.sort(-s, axis=1)[:, :5]
        assert np.allclose(cos, np.where(want >= 0.85 - 1e-6, want, -2), atol=2e-6)
    assert vptree.Tree(x, VpRule()).heads is None
