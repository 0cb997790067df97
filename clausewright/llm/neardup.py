"""Near-duplicate records with small edits (problem 5).

Method: universal-hash minima of the word shingles, banded into buckets;
candidates are verified (signature agreement by the number of bands in common,
then the exact share of common shingles); linked records form groups by
alternating large-star and small-star.

Exact copies are one record from the start. First each record meets the least
record of its buckets (stars), and what verifies is joined into components.
Then only records of different components are candidates, and only if two
bands agree. No bucket is expanded into all its pairs: of each bucket the
stars' heads are compared first, and since the Jaccard distance is a metric,
what a head's distance to another and its members' distances to it rule out is
never paired (see ``_across``). Nothing depends on the size of a bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_code
from .components import connected_components

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class NearDupRule:
    """Two records are compared if two bands agree, whatever the buckets' sizes. With
    q = threshold ** rows a pair at the threshold is missed with probability
    (1 - q) ** bands + bands * q * (1 - q) ** (bands - 1): 3e-6 at 0.6 with 3 rows
    and 64 bands. (A pair that a star finds needs one band only.)"""

    shingle: int = 5
    threshold: float = 0.8
    min_words: int = 0
    rows: int = 4
    bands: int = 40
    #: Bands that the star step uses; the pair step uses all.
    star_bands: int = 12
    seed: int = 1


#: What TESTDATA.md states for clauses.
CLAUSE_RULE = NearDupRule(shingle=3, threshold=0.6, min_words=30, rows=3, bands=64, star_bands=16)


@lru_cache(maxsize=300_000)
def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingle_hashes(words: list[str], k: int) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the k-word sequences (of all words if fewer).

    Two different shingles of a pair of records meet in one hash about once in
    100,000 pairs of ordinary length, and then change the share by one shingle.
    """
    if not words:
        return np.empty(0, np.uint32)
    h = np.fromiter(map(_hash, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(k, len(words))):
            out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return np.unique((out >> np.uint64(32)).astype(np.uint32))


class Signer:
    """Minima of bands * rows multiply-shift hashes, as one key per band."""

    def __init__(self, rule: NearDupRule) -> None:
        rng = np.random.default_rng(rule.seed)
        n = rule.bands * rule.rows
        self.a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.band = (np.arange(rule.bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        self.rule = rule

    def signature(self, grams: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(grams), 2048):
                x = grams[i : i + 2048].astype(np.uint64)
                best = np.minimum(best, (self.a[:, None] * x[None, :] + self.b[:, None]).min(axis=1))
        return best

    def bands(self, grams: np.ndarray) -> np.ndarray:
        s = (self.signature(grams) >> np.uint64(32)).reshape(self.rule.bands, self.rule.rows)
        key = self.band.copy()
        with np.errstate(over="ignore"):
            for r in range(self.rule.rows):
                key = (key ^ s[:, r]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
        return key.view(np.int64)


def record_features(records: DataFrame, rule: NearDupRule) -> DataFrame:
    """id, copy, heading, text -> id, copy, set key, bands, shingles; records too short give none."""
    ship_code(records.sparkSession)
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("copy", T.BinaryType()),
            T.StructField("same", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType(), False)),
            T.StructField("grams", T.ArrayType(T.IntegerType(), False)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        signer, out_schema = Signer(rule), to_arrow_schema(schema)
        list_type, gram_type = out_schema.field("bands").type, out_schema.field("grams").type
        for batch in batches:
            take, same, bands, grams = [], [], [], []
            for n, (heading, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                words = _WORD.findall(text.lower())
                if len(words) < max(1, rule.min_words):
                    continue
                g = shingle_hashes(_WORD.findall(heading.lower()) + words if heading else words, rule.shingle)
                take.append(n)
                same.append(xxhash.xxh3_64_intdigest(g.tobytes()) - 2**63)
                bands.append(signer.bands(g))
                grams.append(g.view(np.int32))
            lists = lambda parts, kind, item: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.empty(0, item))).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int32())), batch.column(1).take(pa.array(take, pa.int32())), pa.array(same, pa.int64()), lists(bands, list_type, np.int64), lists(grams, gram_type, np.int32)], schema=out_schema)

    return records.select("id", "copy", "heading", "text").mapInArrow(run, schema)


def _shared(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(a, b, far): the pairs with their exact Jaccard distance."""
    side = lambda n: features.select(F.col("id").alias(n), F.col("grams").alias(f"g{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("ga", "gb")))
    return both.select("a", "b", (1 - F.col("common") / (F.size("ga") + F.size("gb") - F.col("common"))).alias("far"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, heading_col: str | None = None, rule: NearDupRule = NearDupRule()) -> DataFrame:
    """(id, group) of every record that takes part; group is the least id of it.

    A record takes part if its text has at least ``min_words`` words (and one);
    null and empty texts don't, a null heading is as an empty one. Two records
    are linked if of the distinct shingles of either at least the threshold are
    common to both; groups are all linked directly or through others, so a
    record with no partner is a group of its own. Records given twice count
    once, rows with a null id are left out. Ids must be integers. Other columns
    are not read.
    """
    spark = df.sparkSession
    rows = df.select(
        df[id_col].cast("long").alias("id"),
        (df[heading_col] if heading_col else F.lit(None).cast("string")).alias("heading"),
        df[text_col].alias("text"),
    ).where(F.col("id").isNotNull() & (F.length("text") >= max(1, 2 * rule.min_words - 1)))
    rows = rows.withColumn("copy", F.unhex(F.md5(F.concat(F.coalesce("heading", F.lit("")), F.lit("\u0000"), "text"))))
    # exact copies: one record each, under the least id
    records = rows.groupBy("copy").agg(F.min("id").alias("id"), F.first("heading").alias("heading"), F.first("text").alias("text"))
    read = cut_lineage(record_features(records, rule))
    # records of the same shingles are one node, named by the hash of its shingles. Nodes are
    # laid out by it once; a lost part of them is computed again from what was written.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    nodes = read.repartition(parts, "same").groupBy("same").agg(F.first("bands").alias("bands"), F.first("grams").alias("grams")).persist(StorageLevel.DISK_ONLY)
    try:
        label, more = _links(nodes.withColumnRenamed("same", "id"), rule)
    finally:
        nodes.unpersist()
    merged = connected_components(more, "a", "b")
    low = lambda t, name: t.select(F.col("u").alias("c"), F.col("component").alias(name))
    placed = (
        read.select("copy", "id", F.col("same").alias("c"))
        .join(low(label, "l"), "c", "left").select("copy", "id", F.coalesce("l", "c").alias("c"))
        .join(low(merged, "m"), "c", "left").select("copy", "id", F.coalesce("m", "c").alias("c"))
    )
    groups = placed.groupBy("c").agg(F.min("id").alias("group"))
    final = placed.join(groups, "c").select("copy", "group")
    return rows.select(F.col("id").alias("member"), "copy").distinct().join(final, "copy").select(F.col("member").alias(id_col), "group").distinct()


def _links(nodes: DataFrame, rule: NearDupRule) -> tuple[DataFrame, DataFrame]:
    """nodes: id, bands, grams. (u, component) by stars, and (a, b) links between those components."""
    reach = 1 - rule.threshold + 1e-9
    # stars: each node and the bucket head it shares most bands with
    banded = nodes.select("id", F.explode(F.slice("bands", 1, rule.star_bands)).alias("key"))
    heads = banded.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last").drop("last")
    most = banded.join(heads, "key").where("id <> head").groupBy("id", "head").count().groupBy("id").agg(F.max_by("head", F.struct("count", -F.col("head"))).alias("b"))
    stars = cut_lineage(_shared(most.select(F.col("id").alias("a"), "b"), nodes).where(F.col("far") <= reach))
    label = connected_components(stars.select("a", "b"), "a", "b")

    # what is still apart and has two bands in common with another component
    star = stars.select(F.col("a").alias("id"), F.col("b").alias("head"), "far")
    named = nodes.select("id", "bands").join(label.withColumnRenamed("u", "id"), "id", "left").select("id", "bands", F.coalesce("component", "id").alias("label"))
    met = _mixed(named.select("id", "label", F.explode("bands").alias("key")))
    keys = met.groupBy("id", "label").agg(F.array_sort(F.collect_set("key")).alias("ks"))  # at most one key a band
    two = F.flatten(F.transform("ks", lambda x, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda y: F.xxhash64(x, y))))
    met = _mixed(cut_lineage(keys.where(F.size("ks") > 1)).select("id", "label", F.explode(two).alias("key")))
    met = cut_lineage(met.join(star, "id", "left").select("key", "id", "label", F.coalesce("head", "id").alias("head"), F.coalesce("far", F.lit(0.0)).alias("far")))
    return label, cut_lineage(_across(met, nodes, reach))


#: Keys that go to every executor (some 50 MB); more meet their rows in a shuffle.
MAX_BROADCAST_KEYS = 1_000_000


def _mixed(rows: DataFrame) -> DataFrame:
    """(id, label, key) of the keys that more than one label has: combined on the map
    side, so a key of very many rows is no burden to one task."""
    some = cut_lineage(rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"))
    few = some.count() <= MAX_BROADCAST_KEYS
    return rows.join(F.broadcast(some) if few else some, "key", "left_semi")


def _across(met: DataFrame, features: DataFrame, reach: float) -> DataFrame:
    """(a, b): links between labels that the records of ``met`` give.

    met: key, id, label, the head of the record's star and its distance to it
    (itself and 0 if it has none). First the heads that meet under a key are
    compared; heads within reach join their labels. A member a of head x and
    b of head y can only be linked if far(x, y) <= far(a, x) + reach + far(b, y),
    so of two families that stay apart only members at their rims are paired.
    """
    up = lambda t, end: t.select("key", F.col("head").alias(f"h{end}"), F.col("label").alias(f"l{end}"), "rim")
    fam = met.groupBy("key", "head", "label").agg(F.max("far").alias("rim"))
    pairs = up(fam, "a").withColumnRenamed("rim", "ra").join(up(fam, "b").withColumnRenamed("rim", "rb"), "key").where("ha < hb and la <> lb")
    pairs = cut_lineage(pairs.groupBy("ha", "hb", "la", "lb").agg(F.max("ra").alias("ra"), F.max("rb").alias("rb")))
    known = cut_lineage(_shared(pairs.select(F.col("ha").alias("a"), F.col("hb").alias("b")), features).withColumnsRenamed({"a": "ha", "b": "hb"}).join(pairs, ["ha", "hb"]))
    joined = known.where(F.col("far") <= reach).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    label = connected_components(joined, "a", "b")
    now = lambda end: label.select(F.col("u").alias(f"l{end}"), F.col("component").alias(f"n{end}"))
    open_ = (
        known.where((F.col("far") > reach) & (F.col("far") <= F.col("ra") + F.col("rb") + reach))
        .join(now("a"), "la", "left").join(now("b"), "lb", "left").where("coalesce(na, la) <> coalesce(nb, lb)")
        .select("ha", "hb", "la", "lb", "far", "ra", "rb")
    )
    # members that reach over, each judged alone before it meets another
    rim = lambda end: met.select("key", F.col("id").alias(end), F.col("head").alias(f"h{end}"), F.col("far").alias(f"f{end}"))
    a = open_.join(rim("a"), "ha").where(F.col("far") <= F.col("fa") + F.col("rb") + reach)
    both = a.join(rim("b"), ["key", "hb"]).where((F.col("far") <= F.col("fa") + F.col("fb") + reach) & ((F.col("a") != F.col("ha")) | (F.col("b") != F.col("hb"))))
    found = _shared(both.select("a", "b").distinct(), features).where(F.col("far") <= reach)
    ends = both.select("a", "b", "la", "lb").distinct()
    return joined.unionByName(found.select("a", "b").join(ends, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))).distinct()
