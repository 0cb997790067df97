"""Retrieval arms. Every arm answers all queries of a relation at once and gives
(query_id, <key>, score, rank) in a total order; nothing is collected."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..session import ship_code, spread

#: Usual BM25 parameters.
K1, B = 1.2, 0.75
#: Query vectors that go to every executor at once; more are worked off in passes.
MAX_QUERY_VECTORS = 20_000
#: Products of a query and a row that a task holds at a time (64 MB).
PRODUCT = 8_000_000
#: Query tokens (a row per query and token) that are broadcast; beyond that the joins shuffle.
MAX_QUERY_TOKENS = 500_000


def top_k(scored: DataFrame, k: int, ties: Sequence[str | Column], by: str = "query_id") -> DataFrame:
    """Rank within each query by score, made total by ``ties``; the first k."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a token with a query.

    Tokens are lower-case runs of a-z and 0-9, without stemming or stop words.
    Only postings of query tokens are shuffled: the others are sorted out by a
    semi join on the distinct tokens of the queries before term frequencies are
    counted.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(query_text))).alias("token"))
    toks = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), "doc_id").select("doc_id", tokens("t").alias("t"))
    # every document also has one posting of the empty token, whose rows count the
    # documents and their lengths: texts are read and cut into tokens once
    wanted = q.select("token").unionByName(docs.sparkSession.createDataFrame([("",)], "token string")).distinct()
    small = F.broadcast if q.count() < MAX_QUERY_TOKENS else (lambda x: x)
    each = toks.select("doc_id", F.size("t").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("token")).join(small(wanted), "token", "left_semi")
    # laid out by document once: term counts, scores and sums per document need no further shuffle
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    postings = each.repartition(parts, "doc_id").groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.avg("dl").alias("mean_dl"))
    stats = df.where("token = ''").select(F.col("df").alias("N"), F.col("mean_dl").alias("avgdl"))
    idf = df.where("token <> ''").join(F.broadcast(stats)).select("token", "avgdl", F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))  # stats is one row
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = postings.join(small(idf), "token").select("doc_id", "token", part.alias("s"))
    return weighed.join(small(q), "token").groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 9).alias("score"))


def sparse_scores(postings: DataFrame, query_terms: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): sum of query weight times posting weight.

    Of repeated postings the larger weight holds. Weights are added in double
    precision and rounded to 9 places, so that order doesn't depend on how sums
    were split.
    """
    q = query_terms.select("query_id", "term_id", F.col("weight").cast("double").alias("qw"))
    # postings of other terms go before anything is shuffled
    terms = q.select("term_id").distinct()
    few = F.broadcast if q.count() <= MAX_QUERY_TOKENS else (lambda x: x)
    own = postings.join(few(terms), "term_id", "left_semi")
    one = own.groupBy("chunk_id", "term_id").agg(F.max("weight").cast("double").alias("w"))
    return one.join(q, "term_id").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("qw") * F.col("w")), 9).alias("score"))


def exact_nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, dim: int, other: bool = True) -> DataFrame:
    """(query_id, neighbour, score, rank): exact cosine k-NN of a stated query set against all rows.

    Vectors must be clean (see ``functions.text.clean_vector``). Query vectors
    go out in blocks of at most ``MAX_QUERY_VECTORS``; each task multiplies its
    rows with them, some ``PRODUCT`` products at a time, and passes on its k
    best per query, so what is shuffled is k rows per query and task, whatever
    the table's size. ``other``: queries are rows of the table, and a row isn't
    its own neighbour.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("neighbour", T.LongType()), T.StructField("score", T.DoubleType())])
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    asked = queries.select(F.col(id_col if other else "query_id").cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    blocks: list[DataFrame] = []

    def add(ids: list[int], xs: list[list[float]]) -> None:
        q = np.array(xs, float).reshape(-1, dim)
        sent = spark.sparkContext.broadcast((np.array(ids, np.int64), q / np.linalg.norm(q, axis=1, keepdims=True)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, qx = sent.value
            best, who = np.full((len(qid), k), -3.0), np.full((len(qid), k), np.iinfo(np.int64).max)
            for batch in batches:
                if not batch.num_rows or not len(qid):
                    continue
                x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                own = batch.column(0).to_numpy()
                step = max(1, PRODUCT // len(own))
                for a in range(0, len(qid), step):
                    s = np.round(qx[a : a + step] @ x.T, 9)
                    if other:
                        s[qid[a : a + step, None] == own[None, :]] = -3.0
                    c = np.concatenate((best[a : a + step], s), 1)
                    w = np.concatenate((who[a : a + step], np.broadcast_to(own, s.shape)), 1)
                    if c.shape[1] > 4 * k:  # all that equal the k-th stay until ids decide
                        kth = np.partition(c, c.shape[1] - k, axis=1)[:, c.shape[1] - k]
                        most = int((c >= kth[:, None]).sum(1).max())
                        if most < c.shape[1]:
                            top = np.argpartition(-c, most - 1, axis=1)[:, :most]
                            c, w = np.take_along_axis(c, top, 1), np.take_along_axis(w, top, 1)
                    order = np.lexsort((w, -c), axis=1)[:, :k]
                    best[a : a + step], who[a : a + step] = np.take_along_axis(c, order, 1), np.take_along_axis(w, order, 1)
            i, j = np.nonzero(best > -3.0)
            yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(who[i, j]), pa.array(best[i, j])], names=schema.names)

        blocks.append(rows.mapInArrow(run, schema))

    ids, xs = [], []
    for r in asked.toLocalIterator():
        ids.append(r[0])
        xs.append(r[1])
        if len(ids) == MAX_QUERY_VECTORS:
            add(ids, xs)
            ids, xs = [], []
    if ids or not blocks:
        add(ids, xs)
    found = blocks[0]
    for b in blocks[1:]:
        found = found.unionByName(b)
    return top_k(found, k, ["neighbour"])


def keyword_scores(docs: DataFrame, words: Sequence[str], columns: Sequence[tuple[str, int]]) -> Column:
    """Weighted count of words contained in columns: the fallback without an index."""
    return sum((F.when(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w)), weight).otherwise(0) for w in words for c, weight in columns), F.lit(0))


def rrf(lists: Sequence[DataFrame], key: Sequence[str], k: int = 60, carry: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion: (query_id, *key, score, rank, *carry).

    A key that a list holds twice counts twice; the carried columns are those
    of the first list (and best rank) that holds the key. Equal scores order by
    key.
    """
    union = None
    for n, one in enumerate(lists):
        part = one.select("query_id", *key, F.lit(n).alias("__list"), F.col("rank").alias("__rank"), *carry)
        union = part if union is None else union.unionByName(part)
    first = F.struct("__list", "__rank")
    fused = union.groupBy("query_id", *key).agg(F.round(F.sum(1.0 / (k + F.col("__rank"))), 9).alias("score"), *[F.min_by(c, first).alias(c) for c in carry])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *key)
    return fused.withColumn("rank", F.row_number().over(w))


def rerank_head(hits: DataFrame, query_words: Column, passage_words: Column, window: int, ties: Sequence[str]) -> DataFrame:
    """Reorder the first ``window`` hits by the lexical reranker, keep the tail.

    Score: passage tokens that are query tokens, over 1 + passage length / 200.
    """
    hit = F.size(F.filter(passage_words, lambda t: F.array_contains(query_words, t)))
    scored = hits.withColumn("rerank_score", F.when(F.col("rank") <= window, F.round(hit / (1 + F.size(passage_words) / F.lit(200.0)), 9)))
    w = Window.partitionBy("query_id").orderBy(F.when(F.col("rank") <= window, 0).otherwise(1), F.desc_nulls_last("rerank_score"), "rank", *ties)
    return scored.withColumn("final_rank", F.row_number().over(w))


def hash_embedding(dim: int = 256):
    """Deterministic stand-in for a text model, as an Arrow UDF: each token adds its
    sign to a bucket, both from its FNV-1a hash; vectors have length one."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        import re

        def one(text: str | None) -> list[float]:
            v = np.zeros(dim)
            for t in re.findall(r"[^\W_]+", (text or "").lower()):
                h = 2166136261
                for b in t.encode():
                    h = ((h ^ b) * 16777619) & 0xFFFFFFFF
                v[h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            n = math.sqrt(float(v @ v))
            return (v / n if n else v).tolist()

        return texts.map(one)

    return embed


def hash_sparse(text: Column | str, vocabulary: int = 30_000) -> Column:
    """Stand-in sparse vector: for each token bucket 0.4 * sqrt(c) / (1 + sqrt(c))."""
    t = tokens(text)
    buckets = F.transform(F.array_distinct(t), lambda x: F.struct(F.pmod(F.xxhash64(x), F.lit(vocabulary)).alias("term_id"), F.size(F.filter(t, lambda y: y == x)).alias("c")))
    return F.transform(buckets, lambda b: F.struct(b["term_id"].alias("term_id"), (F.lit(0.4) * F.sqrt(b["c"]) / (1 + F.sqrt(b["c"]))).alias("weight")))
