"""Most similar vectors for every vector (problem 6).

Method: vantage-point trees. A small tree of vantage points, fitted on a
bounded sample, splits the space into shards; every vector lies in one shard
and every query goes to each shard that the triangle inequality can't rule
out. A task builds the tree of its shard and walks it with all its queries at
once. Unstructured vectors send most queries into most shards; so shards grow
before they get many, and what a shuffle holds of it is bounded: the shards are
searched in rounds, each of which leaves its best k and no shuffle files.
``factor`` relaxes the pruning: a side is skipped when it is further than
``factor`` times the query's reach; at factor one the search is exact. The
reach is that of the least cosine asked for; where none is, each query first
looks in its own shard, and the k-th neighbour found there bounds its reach.
Equal vectors are one in the trees, however many there are.

Vectors are compared on the unit sphere, where the chord sqrt(2 - 2 cos) is a
metric in the order of the cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, drop_shuffles, ship_code


#: Cosines count as equal if they are to six places, so they may differ by as much.
TIE = 1.5e-6


@dataclass(frozen=True)
class VpRule:
    """k nearest with a cosine of at least ``min_cosine`` (-1: all)."""

    k: int = 5
    min_cosine: float = -1.0
    factor: float = 1.0
    dim: int = 64
    leaf: int = 256
    #: Vectors per shard aimed at, which sets the depth of the routing tree.
    shard_rows: int = 8_192
    #: Beyond so many shards they grow, up to ``most_shard_rows`` vectors each: a query travels
    #: once to every shard that it looks in, and what a larger shard rules out its own tree does.
    few_shards: int = 16
    most_shard_rows: int = 131_072
    #: Most vectors that the routing tree is fitted on (64 a shard or more, 256 aimed
    #: at); all vectors are indexed. Beyond some 250 million vectors shards grow instead.
    sample_rows: int = 200_000
    #: Queries of a shard that one task aims at; only beyond do a shard's vectors go to several,
    #: but they travel half as often as queries at most.
    part_queries: int = 65_536
    #: Rows (vectors and queries) that a round sends, as a multiple of all vectors; ``round_rows``
    #: where that is more. A round has one shard at least.
    round_copies: float = 6.0
    round_rows: int = 2_000_000
    #: Queries walked at once.
    block: int = 4_096
    seed: int = 7

    @property
    def reach(self) -> float:
        """Largest chord of a neighbour that counts."""
        return math.sqrt(max(0.0, 2 - 2 * self.min_cosine)) + 1e-6


def chord(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ v), 0.0))


def _vantage(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of a few candidates the one from which distances spread most."""
    some = x[rng.integers(0, len(x), 8)]
    seen = x[rng.integers(0, len(x), min(len(x), 256))]
    return some[np.argmax(np.std(np.sqrt(np.maximum(2 - 2 * some @ seen.T, 0)), axis=1))]


class Router:
    """A balanced tree of vantage points; leaves are shards."""

    def __init__(self, sample: np.ndarray, depth: int, rule: VpRule) -> None:
        rng = np.random.default_rng(rule.seed)
        self.depth, self.nodes = depth, {}

        def fit(x: np.ndarray, at: int, level: int) -> None:
            if level == depth:
                return
            if len(x) < 2:
                x = sample
            v = _vantage(x, rng)
            d = chord(x, v)
            mid = float(np.median(d))
            self.nodes[at] = (v, mid)
            fit(x[d <= mid], 2 * at, level + 1)
            fit(x[d > mid], 2 * at + 1, level + 1)

        if depth and len(sample):
            fit(sample, 1, 0)
        else:
            self.depth = 0

    def route(self, x: np.ndarray, margin: np.ndarray | float, among: range | None = None) -> list[tuple[int, np.ndarray]]:
        """(shard, rows): where each vector lies (margin 0) or has to look. Shards have the
        numbers from 2 ** depth on; among: only these."""
        level = [(1, np.arange(len(x)))]
        margin = np.broadcast_to(margin, len(x))
        for left in range(self.depth - 1, -1, -1):
            below = []
            for at, rows in level:
                v, mid = self.nodes[at]
                d = chord(x[rows], v)
                below.append((2 * at, rows[d <= mid + margin[rows]]))
                below.append((2 * at + 1, rows[d > mid - margin[rows]]))
            level = [(a, r) for a, r in below if len(r) and (among is None or (a << left < among.stop and (a + 1) << left > among.start))]
        return level


class Sketch:
    """Of turned vectors the first entries and the length of the rest.

    The product of two sketches is never below the cosine (Cauchy and Schwarz), and
    in a random basis it is seldom much above, whatever the data look like. ``size``
    is what unstructured vectors need to stay under the least cosine, 0 where a
    sketch would save little.
    """

    #: Products of sketches are rounded apart from those of the vectors by less.
    SLACK = 1e-5

    def __init__(self, rule: VpRule) -> None:
        fits = [m for m in range(8, rule.dim * 5 // 8 + 1, 8) if 1 - m / rule.dim + 3.5 * math.sqrt(m) / rule.dim <= rule.min_cosine]
        self.size = fits[0] if fits else 0
        if self.size:
            self.turn = np.linalg.qr(np.random.default_rng(rule.seed).normal(size=(rule.dim, rule.dim)))[0].astype(np.float32)

    def of(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.turn
        return np.column_stack((y[:, : self.size], np.linalg.norm(y[:, self.size :], axis=1)))


class Tree:
    """The tree of one shard, kept as the order of its rows and its nodes."""

    def __init__(self, x: np.ndarray, rule: VpRule) -> None:
        self.x, self.rule, self.nodes = x, rule, {}
        points: list[np.ndarray] = []
        self.sketch = Sketch(rule)
        # leaves that are scanned by sketches may be larger; that only rules out less
        most = rule.leaf * (4 if self.sketch.size else 1)
        self.order = np.arange(len(x))
        rng = np.random.default_rng(rule.seed)
        todo = [(1, 0, len(x))]
        while todo:
            at, a, b = todo.pop()
            if b - a <= most:
                self.nodes[at] = (a, b)
                continue
            rows = self.order[a:b]
            v = _vantage(x[rows], rng)
            d = chord(x[rows], v)
            by = np.argpartition(d, (b - a) // 2)
            self.order[a:b] = rows[by]
            m = a + (b - a) // 2
            inner, outer = d[by[: m - a]], d[by[m - a :]]
            self.nodes[at] = (len(points), float(inner.min()), float(inner.max()), float(outer.min()), float(outer.max()))
            points.append(v)
            todo += [(2 * at, a, m), (2 * at + 1, m, b)]
        self.rows = x[self.order]
        self.points = np.array(points, np.float32).reshape(len(points), x.shape[1])
        self.heads = self.sketch.of(self.rows) if self.sketch.size and len(x) else None

    def search(self, q: np.ndarray, own: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, rows) of the best k for each query, best first, -2 where there
        are fewer; equal cosines (to six places) by row. own: each query's row here
        (-1: none), which isn't its own neighbour. least: the cosine that each
        query's neighbours have at least, beside that of the rule.

        The queries of a block go down the tree together.
        """
        r = self.rule
        best = np.full((len(q), r.k), -2.0, np.float32)
        who = np.full((len(q), r.k), -1, np.int64)
        floor = np.full(len(q), r.min_cosine - 1e-6, np.float32)
        if least is not None:
            floor = np.maximum(floor, least - np.float32(TIE))

        def leaf(a: int, b: int, at: np.ndarray) -> None:
            least = np.maximum(best[at, -1] - TIE, floor[at])
            # few queries have a hit here; the others cost one pass, over sketches where there are some
            if self.heads is not None:
                near = np.flatnonzero((heads[at - first] @ self.heads[a:b].T).max(axis=1) >= least - Sketch.SLACK)
                at, least = at[near], least[near]
            s = q[at] @ self.rows[a:b].T
            hit = np.flatnonzero(s.max(axis=1) >= least)
            at, s = at[hit], s[hit]
            i, j = np.nonzero(s >= least[hit, None])
            other = self.order[a + j] != own[at[i]]
            i, j = i[other], j[other]
            if not len(i):
                return
            # the hits of each query side by side, behind its best so far
            hit, count = np.unique(i, return_counts=True)
            start = np.repeat(np.cumsum(count) - count, count)
            row = np.repeat(np.arange(len(hit)), count)
            cos = np.full((len(hit), r.k + count.max()), -2.0, np.float32)
            ids = np.full(cos.shape, -1, np.int64)
            at = at[hit]
            cos[:, : r.k], ids[:, : r.k] = best[at], who[at]
            cos[row, r.k + np.arange(len(i)) - start], ids[row, r.k + np.arange(len(i)) - start] = s[i, j], self.order[a + j]
            rank = (np.rint(cos.astype(np.float64) * -1e6).astype(np.int64) << 40) + ids
            if cos.shape[1] > 4 * r.k:
                top = np.argpartition(rank, r.k - 1, axis=1)[:, : r.k]
                cos, ids, rank = (np.take_along_axis(t, top, 1) for t in (cos, ids, rank))
            keep = np.argsort(rank, axis=1)[:, : r.k]
            best[at], who[at] = np.take_along_axis(cos, keep, 1), np.take_along_axis(ids, keep, 1)

        def down(at: int, rows: np.ndarray) -> None:
            node = self.nodes[at]
            if len(node) == 2:
                leaf(*node, rows)
                return
            v, in0, in1, out0, out1 = node
            d = away[v, rows - first]
            # With a bounded reach all queries go down as one; without one, nearer sides
            # go first, so that the k-th neighbour so far soon bounds the reach.
            turns = [np.ones(len(rows), bool)] if r.min_cosine > -1 else [d <= (in1 + out0) / 2, d > (in1 + out0) / 2]
            for i, turn in enumerate(turns):
                margin = r.factor * (np.sqrt(np.maximum(2 - 2 * np.maximum(best[rows, -1] - TIE, floor[rows]), 0)) + 1e-6)
                inner = (d <= in1 + margin) & (d >= in0 - margin) & turn
                outer = (d >= out0 - margin) & (d <= out1 + margin) & turns[-1 - i]
                if inner.any():
                    down(2 * at, rows[inner])
                if outer.any():
                    down(2 * at + 1, rows[outer])

        if len(self.x):
            for first in range(0, len(q), r.block):
                some = q[first : first + r.block]
                away = chord(self.points, some.T) if len(self.points) else None
                heads = self.sketch.of(some) if self.heads is not None else None
                down(1, np.arange(first, first + len(some)))
        return best, who


def usable(vector, dim: int):
    """Vectors that take part: ``dim`` finite numbers, not all zero."""
    clean = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dim) & clean & F.exists(vector, lambda x: x != 0)


def _unit(col: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large numbers stay in range
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def nearest(df: DataFrame, id_col: str, vector_col: str, rule: VpRule = VpRule(), queries: DataFrame | None = None) -> DataFrame:
    """(id, neighbour, cosine, rank): for each vector its k most similar others.

    ``queries``: rows of ``df`` to look up (same columns); all if not given.
    Vectors that are null, have not ``dim`` entries, are all zero or hold a
    null, NaN or infinity take no part, nor do rows with a null id. Length
    doesn't matter. Equal cosines rank by id. Rows given twice count once (of
    different vectors under one id the largest array). Fewer than k rows give
    fewer neighbours; an empty table gives an empty one.
    """
    spark = df.sparkSession
    ship_code(spark)
    clean = lambda t: t.select(t[id_col].cast("long").alias("id"), t[vector_col].cast("array<float>").alias("x")).where(F.col("id").isNotNull() & usable(F.col("x"), rule.dim)).groupBy("id").agg(F.max("x").alias("x"))
    vectors = cut_lineage(clean(df))
    counts = vectors.select(F.xxhash64("x").alias("h")).agg(F.count(F.lit(1)), F.countDistinct("h")).first()
    if counts[0] == counts[1]:  # no two vectors are equal
        found = _search(vectors, vectors if queries is None else clean(queries), counts[0], counts[0] if queries is None else None, rule)
        # rounding makes equal cosines equal whichever shard they come from
        order = Window.partitionBy("id").orderBy(F.round("cosine", 6).desc(), "neighbour")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rule.k).select(F.col("id").alias(id_col), "neighbour", "cosine", "rank")
    # equal vectors are one, under their least id; their first k + 1 ids are all that can be neighbours
    one = cut_lineage(vectors.groupBy("x").agg(F.min("id").alias("id")).select("id", "x"))
    members = cut_lineage(vectors.join(one.withColumnRenamed("id", "one"), "x").select("id", "one"))
    low = members.withColumn("__n", F.row_number().over(Window.partitionBy("one").orderBy("id"))).where(F.col("__n") <= rule.k + 1).select(F.col("one").alias("neighbour"), F.col("id").alias("other"))
    asked = members if queries is None else members.join(queries.select(queries[id_col].cast("long").alias("id")).distinct(), "id", "left_semi")
    n = one.count()
    found = _search(one, one if queries is None else one.join(asked.select(F.col("one").alias("id")).distinct(), "id", "left_semi"), n, n if queries is None else None, rule)
    best = found.select("id", "neighbour", "cosine").unionByName(asked.select(F.col("one").alias("id")).distinct().select("id", F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine")))
    order = Window.partitionBy("id").orderBy(F.round("cosine", 6).desc(), "other")
    # k + 1 candidates a vector: each of its ids leaves itself out
    few = best.join(low, "neighbour").withColumn("n", F.row_number().over(order)).where(F.col("n") <= rule.k + 1)
    few = few.groupBy(F.col("id").alias("one")).agg(F.array_sort(F.collect_list(F.struct("n", "other", "cosine"))).alias("few"))
    rows = asked.join(few, "one").select("id", F.slice(F.filter("few", lambda x: x["other"] != F.col("id")), 1, rule.k).alias("few"))
    return rows.select(F.col("id").alias(id_col), F.posexplode("few").alias("p", "x")).select(id_col, F.col("x.other").alias("neighbour"), F.col("x.cosine").alias("cosine"), (F.col("p") + 1).alias("rank"))


def _depth(n: int, rule: VpRule) -> int:
    """Levels of the routing tree over n vectors; 2 ** depth shards."""
    most = max(0, int(math.log2(max(1, rule.sample_rows // 64))))
    levels = lambda rows: math.ceil(math.log2(max(1.0, n / rows)))
    few = int(math.log2(max(1, rule.few_shards)))
    return min(most, levels(rule.shard_rows), max(few, levels(max(rule.shard_rows, rule.most_shard_rows))))


def _rounds(held: np.ndarray, asking: np.ndarray, rule: VpRule) -> tuple[int, list[range]]:
    """(parts, ranges of shards): a shard's queries are split into parts, each of which needs
    all its vectors; held, asking: the rows that are expected in each shard."""
    wanted = math.ceil(asking.mean() / rule.part_queries)
    parts = max(1, min(wanted, int(asking.sum() / max(1.0, held.sum()) / 2)))
    most = max(rule.round_rows, rule.round_copies * held.sum())
    rounds, start, rows = [], 0, 0.0
    for i, more in enumerate(held * parts + asking):
        if i > start and rows + more > most:
            rounds.append(range(start, i))
            start, rows = i, 0.0
        rows += more
    return parts, [*rounds, range(start, len(held))]


def _search(vectors: DataFrame, ask: DataFrame, n: int, asks: int | None, rule: VpRule) -> DataFrame:
    """(id, neighbour, cosine): the best k of every shard or round of shards that a query has to look in."""
    spark = vectors.sparkSession
    depth = _depth(n, rule)
    sample = np.empty((0, rule.dim), np.float32)
    if depth:
        # the sample only places the shard borders; it is bounded by sample_rows
        size = min(rule.sample_rows, 256 * 2**depth)
        some = vectors.where(F.pmod(F.xxhash64("id", F.lit(rule.seed)), F.lit(max(1, n // size))) == 0).select("x").limit(size).toPandas()
        sample = _unit(pa.array(some["x"].tolist(), pa.list_(pa.float32())), rule.dim) if len(some) else sample
    router = Router(sample, depth, rule)
    sent = spark.sparkContext.broadcast(router)  # 2 ** depth vantage points
    # without a least cosine each query looks in its own shard first
    twice = rule.min_cosine <= -1 and router.depth > 0
    shards = 2**router.depth
    asks = ask.count() if asks is None else asks
    margins = lambda least: rule.factor * (np.sqrt(np.maximum(2 - 2 * (least.astype(float) - TIE), 0)) + 1e-6)

    def load(rows: int, margin: np.ndarray | float) -> np.ndarray:
        """Of so many rows those expected in each shard, as the sample has it."""
        share = np.zeros(shards)
        for shard, found in router.route(sample, margin):
            share[shard - shards] = len(found) / max(1, len(sample))
        return rows * (share if router.depth else np.ones(shards))

    row_type = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("asks", T.BooleanType()), T.StructField("id", T.LongType()), T.StructField("least", T.FloatType()), T.StructField("x", T.BinaryType())])

    def place(what: str, parts: int, among: range):
        """held: each vector into its shard; own, all, others: queries into their own, all or the other
        shards they need. Only shards among these, counted from 0."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only = range(shards + among.start, shards + among.stop)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, ids = _unit(batch.column(1), rule.dim), batch.column(0).to_numpy()
                least = batch.column(2).to_numpy() if what == "others" else np.full(len(x), rule.min_cosine, np.float32)
                raw = np.array([v.tobytes() for v in x], object)
                margin = 0.0 if what in ("held", "own") else margins(least)
                home = np.zeros(len(x), np.int64)
                if what == "others":
                    for shard, rows in sent.value.route(x, 0.0):
                        home[rows] = shard
                for shard, rows in sent.value.route(x, margin, only):
                    rows = rows[home[rows] != shard]
                    for part in range(parts) if what == "held" else [None]:
                        which = np.full(len(rows), part) if part is not None else ids[rows] // 7 % parts
                        task = ((shard - only.start) * parts + which).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(np.full(len(rows), what != "held")), pa.array(ids[rows]), pa.array(least[rows].astype(np.float32)), pa.array(list(raw[rows]), pa.binary())], names=row_type.names)

        return run

    out_type = T.StructType([T.StructField("id", T.LongType()), T.StructField("neighbour", T.LongType()), T.StructField("cosine", T.DoubleType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, xs, tree, asked = None, [], [], None, []

        def flush():
            nonlocal tree, asked
            if not asked:
                return
            own_ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
            by = np.argsort(own_ids)  # rows in the order of their ids, by which ties are settled
            own_ids = own_ids[by]
            if tree is None:
                tree = Tree(np.concatenate(xs)[by] if xs else np.empty((0, rule.dim), np.float32), rule)
            q, least, qx = (np.concatenate(c) for c in zip(*asked))
            asked = []
            at = np.minimum(np.searchsorted(own_ids, q), max(0, len(own_ids) - 1))
            own = np.where(own_ids[at] == q, at, -1) if len(own_ids) else np.full(len(q), -1)
            cos, who = tree.search(qx, own, least)
            i, j = np.nonzero(who >= 0)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(own_ids[who[i, j]]), pa.array(cos[i, j].astype(float))], names=out_type.names)

        for batch in batches:
            code, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            edges = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (asks[1:] != asks[:-1])))) if len(code) else []
            for a, b in zip(edges, [*edges[1:], len(code)]):
                if code[a] != key:
                    yield from flush()
                    key, ids, xs, tree = code[a], [], [], None
                x = np.frombuffer(b"".join(batch.column(4).slice(a, b - a).to_pylist()), np.float32).reshape(-1, rule.dim)
                i = batch.column(2).slice(a, b - a).to_numpy()
                if asks[a]:
                    asked.append((i, batch.column(3).slice(a, b - a).to_numpy(), x))
                else:
                    ids.append(i)
                    xs.append(x)
                if asks[a] and sum(len(c[0]) for c in asked) >= 4 * rule.block:
                    yield from flush()
        yield from flush()

    def scan(asking: DataFrame, what: str, queries: np.ndarray) -> DataFrame:
        parts, rounds = _rounds(load(n, 0.0), queries, rule)

        def one(among: range) -> DataFrame:
            rows = vectors.mapInArrow(place("held", parts, among), row_type).unionByName(asking.mapInArrow(place(what, parts, among), row_type))
            return rows.repartitionById(parts * len(among), F.col("task")).sortWithinPartitions("task", "asks").mapInArrow(look, out_type)

        if len(rounds) == 1:
            return one(rounds[0])
        found = None
        for among in rounds:
            best = one(among).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.round("cosine", 6).desc(), "neighbour")))
            best = best.where(F.col("n") <= rule.k).drop("n")
            kept = cut_lineage(best)
            drop_shuffles(best)
            found = kept if found is None else found.unionByName(kept)
        return found

    if not twice:
        return scan(ask, "all", load(asks, float(margins(np.float32(rule.min_cosine)))))
    near = cut_lineage(scan(ask, "own", load(asks, 0.0)))
    kth = near.groupBy("id").agg(F.when(F.count(F.lit(1)) >= rule.k, F.min("cosine")).alias("least"))
    bound = ask.join(kth, "id", "left").select("id", "x", F.coalesce("least", F.lit(-1.0)).cast("float").alias("least"))
    return near.unionByName(scan(bound, "others", np.full(shards, float(asks))))


def mutual(neighbours: DataFrame, id_col: str) -> DataFrame:
    """(a, b, cosine) with a < b: pairs of which each is among the other's nearest."""
    pair = neighbours.select(F.least(id_col, "neighbour").alias("a"), F.greatest(id_col, "neighbour").alias("b"), "cosine")
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("cosine").alias("cosine")).where("n = 2").select("a", "b", "cosine")
