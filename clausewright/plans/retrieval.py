"""Retrieval: arms, fusion, rerank, the search tool."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import versioning as V
from ..retrieval import arms as A
from ..retrieval import index as I
from ..retrieval import products as P
from ..retrieval import search as S
from ..session import checkpoint_dir
from ..sources.tables import table
from .registry import Registry

registry = Registry()
add = registry.add


def _clauses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "chunk_id", "spec_id", "release", "version", "clause_path", "heading", "text")


def stored_index(spark: SparkSession, d: str) -> I.SearchIndex:
    """The corpus' search index, stored in the shared folder and brought up to date once a session."""
    path = f"{checkpoint_dir(spark)}/index-{hashlib.sha1(d.encode()).hexdigest()[:16]}"
    key = (spark.sparkContext.applicationId, path)
    if key not in _READY:
        I.extend_index(table(spark, d, "clauses"), table(spark, d, "clause_sparse"), path)
        _READY[key] = I.open_index(spark, path)
    return _READY[key]


#: Indexes opened in a session, by application and folder.
_READY: dict[tuple[str, str], I.SearchIndex] = {}


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector for each search query. The tables hold none, so query q takes that of the q-th
    embedded clause in the order of chunk ids."""
    x = F.col("embedding").cast("array<double>")
    rows = table(spark, d, "clauses", "chunk_id", "embedding").where(X.clean_vector(x, 64)).select("chunk_id", x.alias("x"))
    near = rows.orderBy("chunk_id").limit(table(spark, d, "search_queries").count())  # one for each query
    placed = near.withColumn("n", F.row_number().over(Window.orderBy("chunk_id")))
    return placed.select(F.col("n").cast("long").alias("query_id"), "x").join(table(spark, d, "search_queries", "query_id"), "query_id", "left_semi")


_BM25 = """
with q as (select distinct query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) as token from search_queries),
t as (select {id} as id, regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+') as ts from {docs}),
s as (select count(*) as n, avg(len(ts)) as avgdl from t),
p as (select id, token, count(*) as tf, any_value(dl) as dl from (select id, len(ts) as dl, unnest(ts) as token from t) where token in (select token from q) group by id, token),
f as (select token, ln((n - df + 0.5::double) / (df + 0.5::double) + 1) as idf from (select token, count(*) as df from p group by token), s),
r as (select q.query_id, p.id, round(sum(f.idf * p.tf * 2.2::double / (p.tf + 1.2::double * (0.25::double + 0.75::double * p.dl / s.avgdl))), 9) as score from p join f using (token) join q using (token), s group by all)
"""


@add("ret_02_bm25_clauses", _BM25.format(id="chunk_id", text="text", docs="clauses") + "select query_id, chunk_id, round(score, 6) as score, rank from (select query_id, id as chunk_id, score, row_number() over (partition by query_id order by score desc, id) as rank from r) where rank <= 10")
def ret_02(spark: SparkSession, d: str) -> DataFrame:
    found = P.bm25_top(table(spark, d, "clauses", "chunk_id", "text"), "chunk_id", "text", table(spark, d, "search_queries"), 10)
    top = A.top_k(found.withColumnRenamed("row_id", "chunk_id"), 10, ["chunk_id"])
    return top.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_CA = (
    "with u as (select distinct unnest(string_split(text, chr(10) || chr(10))) as part from clauses where text is not null), docs as (select md5(part) as id, part from u where part <> ''), "
    + _BM25.format(id="id", text="part", docs="docs").strip()[5:]
    + """, b as (select query_id, heading, text, max(score) as score from (select distinct heading, text, unnest(string_split(text, chr(10) || chr(10))) as part from clauses where text is not null) x join r on r.id = md5(x.part) group by all),
h as (select b.query_id, c.chunk_id, c.spec_id, c.release, c.version, c.clause_path, b.score from b join clauses c on c.heading is not distinct from b.heading and c.text = b.text),
o as (select *, row_number() over (partition by query_id, spec_id, clause_path order by score desc, coalesce(try_cast(split_part(version, '.', 1) as int), 0) desc, coalesce(try_cast(split_part(version, '.', 2) as int), 0) desc, coalesce(try_cast(split_part(version, '.', 3) as int), 0) desc, chunk_id) as n from h)
"""
)


@add("ret_03_bm25_paragraphs", _CA + "select query_id, chunk_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, spec_id, clause_path nulls first, chunk_id) as rank from o where n = 1) where rank <= 10")
def ret_03(spark: SparkSession, d: str) -> DataFrame:
    hits = S.lexical_arm(stored_index(spark, d), table(spark, d, "search_queries"), 10)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@add("ret_04_keyword", "select chunk_id, score, row_number() over (order by score desc, chunk_id) as rank from (select chunk_id, (case when contains(lower(coalesce(heading, '')), 'gateway') then 2 else 0 end + case when contains(lower(coalesce(text, '')), 'gateway') then 1 else 0 end + case when contains(lower(coalesce(heading, '')), 'timer') then 2 else 0 end + case when contains(lower(coalesce(text, '')), 'timer') then 1 else 0 end)::bigint as score from clauses) where score > 0 order by rank limit 50")
def ret_04(spark: SparkSession, d: str) -> DataFrame:
    rows = _clauses(spark, d).select("chunk_id", A.keyword_scores(None, ["gateway", "timer"], [("heading", 2), ("text", 1)]).cast("long").alias("score")).where("score > 0")
    top = rows.orderBy(F.desc("score"), "chunk_id").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).cast("long"))


@add("ret_05_dense", "with e as (select vec_id, embedding from embeddings) select query_id, neighbour, round(score, 5) as score, rank from (select a.vec_id as query_id, b.vec_id as neighbour, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id) as rank from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0) where rank <= 10")
def ret_05(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings", "vec_id", "embedding")
    near = A.exact_nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, 64)
    return near.select("query_id", "neighbour", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@add("ret_06_rescore_candidates", "with e as (select vec_id, label, embedding from embeddings), q as (select embedding as q from embeddings where vec_id = 0) select vec_id, round(list_cosine_similarity(embedding::double[], q::double[]), 5) as score from e, q where label = 3")
def ret_06(spark: SparkSession, d: str) -> DataFrame:
    """One query among candidates: the vector is one row, inlined by a scalar subquery."""
    rows = table(spark, d, "embeddings", "vec_id", "label", "embedding")
    q = F.broadcast(rows.where("vec_id = 0").select(F.col("embedding").alias("q")))
    return rows.where("label = 3").crossJoin(q).select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("q")), 5).alias("score"))


@add("ret_07_rrf", "with h as (select query_id, arm, chunk_id, max(score) as score, max(spec_id) as spec_id, max(clause) as clause, max(citation.release) as release, max(citation.version) as version from hit_out group by query_id, arm, chunk_id), k as (select *, row_number() over (partition by query_id, arm order by score desc nulls last, chunk_id) as r from h) select query_id, spec_id, release, version, clause, round(sum(1.0::double / (60 + r)), 9) as score from k group by all")
def ret_07(spark: SparkSession, d: str) -> DataFrame:
    """Fusion keyed on the clause's place, not on its chunk."""
    h = table(spark, d, "hit_out", "query_id", "arm", "chunk_id", "score", "spec_id", "clause", "citation").groupBy("query_id", "arm", "chunk_id").agg(
        F.max("score").alias("score"), F.max("spec_id").alias("spec_id"), F.max("clause").alias("clause"), F.max("citation.release").alias("release"), F.max("citation.version").alias("version")
    )
    ranked = h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "arm").orderBy(F.desc_nulls_last("score"), "chunk_id")))
    return A.rrf([ranked], ["spec_id", "release", "version", "clause"]).select("query_id", "spec_id", "release", "version", "clause", "score")


@add("ret_08_sparse", "with p as (select chunk_id, term_id, max(weight)::double as w from clause_sparse group by all), s as (select query_id, chunk_id, round(sum(q.weight::double * p.w), 9) as score from query_terms q join p using (term_id) group by all) select query_id, chunk_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s) where rank <= 10")
def ret_08(spark: SparkSession, d: str) -> DataFrame:
    top = A.top_k(A.sparse_scores(table(spark, d, "clause_sparse"), table(spark, d, "query_terms")), 10, ["chunk_id"])
    return top.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@add("ret_09_sharded_top_k", "with p as (select chunk_id, term_id, max(weight)::double as w from clause_sparse where term_id = 5 group by all) select chunk_id, w from p order by w desc, chunk_id limit 20")
def ret_09(spark: SparkSession, d: str) -> DataFrame:
    """The best of each of four shards, united, then the best of all."""
    p = table(spark, d, "clause_sparse").where("term_id = 5").groupBy("chunk_id").agg(F.max("weight").cast("double").alias("w"))
    parts = [p.where(F.pmod("chunk_id", F.lit(4)) == i).orderBy(F.desc("w"), "chunk_id").limit(20) for i in range(4)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.orderBy(F.desc("w"), "chunk_id").limit(20)


_INTENT_SQL = """case when regexp_matches(query_text, '(?i)(diff|change|évolution|difference|différence).*\\brel-?\\d+\\b.*\\brel-?\\d+\\b') and regexp_matches(query_text, '(?i)(^|[^\\pL\\pN_])(diff|change|évolution|difference|différence)($|[^\\pL\\pN_])') then 'changelog' when regexp_matches(query_text, '(?i)(^|[^\\pL\\pN_])(replace[sd]?|remplace|équivalent|evolution|migration|maps to)($|[^\\pL\\pN_])') then 'graph' when regexp_matches(query_text, '(?i)(^|[^\\pL\\pN_])(defined|definition|définition|expansion|stands for|signifie)($|[^\\pL\\pN_])') and regexp_matches(query_text, '\\b[A-Z][A-Z0-9]{1,7}\\b') then 'glossary' when regexp_matches(query_text, '\\bT[SR]\\s?[0-9][0-9]\\.[0-9]{3}\\b') then 'spec_lookup' else 'hybrid' end"""
_TOK = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '')"


@add("ret_12_lexical_rerank", f"with q as (select query_id, list_distinct({_TOK.format('query_text')}) as q from search_queries), h as (select distinct query_id, chunk_id, {_TOK.format('coalesce(snippet, chr(32))')} as p from hit_out where snippet is not null) select h.query_id, h.chunk_id, max(round(len(list_filter(p, lambda x: list_contains(q.q, x))) / (1 + len(p) / 200.0::double), 6)) as score from h join q using (query_id) group by all")
def ret_12(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "search_queries", "query_id", "query_text").select("query_id", F.array_distinct(X.rerank_tokens("query_text")).alias("q"))
    h = table(spark, d, "hit_out", "query_id", "chunk_id", "snippet").where("snippet is not null").distinct().withColumn("p", X.rerank_tokens("snippet"))
    hit = F.size(F.filter("p", lambda t: F.array_contains(F.col("q"), t)))
    return h.join(q, "query_id").groupBy("query_id", "chunk_id").agg(F.max(F.round(hit / (1 + F.size("p") / F.lit(200.0)), 6)).alias("score"))


@add("ret_13_federated", "with h as (select query_id, chunk_id, max(score) as score, max(case when upper(trim(spec_id)) like 'ETSI%' then 'etsi' else '3gpp' end) as half from hit_out where arm = 'dense' group by query_id, chunk_id), r as (select *, row_number() over (partition by query_id, half order by score desc nulls last, chunk_id) as n from h), f as (select query_id, chunk_id, half, round(1.0::double / (60 + n), 9) as score from r) select query_id, chunk_id, half, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from f) where rank <= 10")
def ret_13(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hit_out", "query_id", "arm", "chunk_id", "score", "spec_id").where("arm = 'dense'").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.max(F.when(V.is_etsi("spec_id"), "etsi").otherwise("3gpp")).alias("half"))
    ranked = h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "half").orderBy(F.desc_nulls_last("score"), "chunk_id")))
    return S.federated(ranked, "half", ["chunk_id"], 10).select("query_id", "chunk_id", "half", F.col("rank").cast("long").alias("rank"))


@add("ret_01_intent", f"select query_id, {_INTENT_SQL} as intent from search_queries")
def ret_01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_queries", "query_id", "query_text").select("query_id", S.intent("query_text").alias("intent"))


@add("ret_18_hash_embedding")
def ret_18(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in vectors of all queries (an Arrow UDF; no SQL form)."""
    from ..session import ship_code

    ship_code(spark)
    return table(spark, d, "search_queries", "query_id", "query_text").select("query_id", A.hash_embedding(64)("query_text").alias("embedding"))


@add("ret_19_hash_sparse", "with t as (select query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) as token from search_queries), c as (select query_id, token, count(*) as c from t group by all) select query_id, round(sum(0.4::double * sqrt(c) / (1 + sqrt(c))), 6) as mass, count(*) as terms from c group by query_id")
def ret_19(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "search_queries", "query_id", "query_text").select("query_id", F.explode(A.hash_sparse("query_text")).alias("x"))
    return rows.groupBy("query_id").agg(F.round(F.sum("x.weight"), 6).alias("mass"), F.count(F.lit(1)).alias("terms"))


@add("ret_20_distinct_clauses", "with h as (select query_id, spec_id, clause, max(score) as score from hit_out where arm = 'lexical' and score is not null group by query_id, spec_id, clause) select query_id, spec_id, clause, rank from (select *, row_number() over (partition by query_id order by score desc, spec_id, clause nulls first) as rank from h) where rank <= 5")
def ret_20(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hit_out", "query_id", "arm", "spec_id", "clause", "score").where("arm = 'lexical' and score is not null").groupBy("query_id", "spec_id", "clause").agg(F.max("score").alias("score"))
    return A.top_k(h, 5, ["spec_id", "clause"]).select("query_id", "spec_id", "clause", F.col("rank").cast("long").alias("rank"))


_V3 = "coalesce(try_cast(split_part({0}, '.', 1) as int), 0) desc, coalesce(try_cast(split_part({0}, '.', 2) as int), 0) desc, coalesce(try_cast(split_part({0}, '.', 3) as int), 0) desc"
_CLEAN = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda v: v is null or isnan(v) or isinf(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0"
_DENSE = f""", ev as (select chunk_id, heading, text, embedding::double[] as x from clauses where {_CLEAN}),
qv as (select n as query_id, x from (select x, row_number() over (order by chunk_id) as n from ev) where n in (select query_id from search_queries)),
vb as (select heading, text, min(chunk_id) as chunk_id, arg_min(x, chunk_id) as x from ev where text is not null group by all),
dn as (select * from (select query_id, b.chunk_id as donor, heading, text, s as score, row_number() over (partition by query_id order by s desc, b.chunk_id) as n from (select query_id, vb.*, round(list_cosine_similarity(vb.x, qv.x), 9) as s from vb, qv where {{body}}) b) where n <= {{fetch}}),
dh as (select dn.query_id, c.chunk_id, c.spec_id, c.release, c.version, c.clause_path, dn.score from dn join clauses c on c.heading is not distinct from dn.heading and c.text = dn.text where {{where}}),
do_ as (select *, row_number() over (partition by query_id, spec_id, clause_path order by score desc, {_V3.format("version")}, chunk_id) as n from dh)"""


def _search_sql(where: str = "true", rank_of: int = 22) -> str:
    """SQL of the search over the clauses that ``where`` (over c) keeps."""
    body = "true" if where == "true" else f"exists (select 1 from clauses c where c.heading is not distinct from vb.heading and c.text = vb.text and {where})"
    lexical = _CA.replace("on c.heading is not distinct from b.heading and c.text = b.text)", f"on c.heading is not distinct from b.heading and c.text = b.text where {where})")
    return (
        lexical
        + _DENSE.format(where=where, body=body, fetch=8 * rank_of)
        + f""", lx as (select query_id, spec_id, release, version, clause_path, chunk_id, 0 as l, row_number() over (partition by query_id order by score desc, spec_id, clause_path nulls first, chunk_id) as r from o where n = 1),
sp as (select query_id, chunk_id, round(sum(q2.weight::double * p2.w), 9) as score from query_terms q2 join (select chunk_id, term_id, max(weight)::double as w from clause_sparse group by all) p2 using (term_id) group by all),
sx as (select sp.query_id, c.spec_id, c.release, c.version, c.clause_path, c.chunk_id, 1 as l, row_number() over (partition by sp.query_id order by score desc, c.spec_id nulls first, c.release nulls first, c.version nulls first, c.clause_path nulls first, c.chunk_id) as r from sp join clauses c using (chunk_id) where c.text is not null and {where}),
dx as (select query_id, spec_id, release, version, clause_path, chunk_id, 2 as l, row_number() over (partition by query_id order by score desc, spec_id, clause_path nulls first, chunk_id) as r from do_ where n = 1),
al as (select * from lx where r <= {rank_of} union all select * from sx where r <= {rank_of} union all select * from dx where r <= {rank_of}),
fu as (select query_id, spec_id, release, version, clause_path, round(sum(1.0::double / (60 + r)), 9) as score, arg_min(chunk_id, l * 1000 + r) as chunk_id from al group by query_id, spec_id, release, version, clause_path),
fr as (select *, row_number() over (partition by query_id order by score desc, spec_id nulls first, release nulls first, version nulls first, clause_path nulls first) as rank from fu),
hi as (select f.*, c.text, s2.query_text, list_filter(regexp_split_to_array(lower(concat_ws(' ', c.heading, c.text)), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '') as pw, list_filter(regexp_split_to_array(lower(s2.query_text), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '') as qw from fr f join clauses c using (chunk_id) join search_queries s2 on s2.query_id = f.query_id where f.rank <= {rank_of}),
rr as (select *, case when rank <= 12 then round(len(list_filter(pw, lambda x: list_contains(qw, x))) / (1 + len(pw) / 200.0::double), 9) end as rs from hi),
fi as (select *, row_number() over (partition by query_id order by case when rank <= 12 then 0 else 1 end, rs desc nulls last, rank) as place from rr)
select query_id, place as rank, chunk_id, spec_id, release, version, clause_path, score,
case when length(trim(coalesce(text, ''))) > 400 then substr(trim(coalesce(text, '')), 1, 400) || '…' else trim(coalesce(text, '')) end as snippet,
'3gpp://' || replace(replace(coalesce(spec_id, ''), '%', '%25'), ' ', '%20') || '/' || replace(replace(coalesce(release, ''), '%', '%25'), ' ', '%20') || case when coalesce(clause_path, '') <> '' then '/' || replace(replace(clause_path, '%', '%25'), ' ', '%20') else '' end || case when coalesce(version, '') <> '' then '@' || replace(replace(version, '%', '%25'), ' ', '%20') else '' end as resource,
{_INTENT_SQL} as intent
from fi where place <= 10"""
    )


def _hybrid(spark: SparkSession, d: str, **filters: str) -> DataFrame:
    return S.search_spec(stored_index(spark, d), table(spark, d, "search_queries"), table(spark, d, "query_terms"), query_vectors(spark, d), S.SearchRequest(**filters))


@add("search_spec", _search_sql())
def search_spec(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: every search query, hybrid of three arms, reranked, with citations."""
    return _hybrid(spark, d)


@add("search_spec_in_release", _search_sql("c.release = 'Rel-16'"))
def search_spec_in_release(spark: SparkSession, d: str) -> DataFrame:
    """The same within one release: arms rank its clauses only."""
    return _hybrid(spark, d, release="Rel-16")


@add("win_02_dense_versions", _CA.split("docs as")[0].rstrip(", \n") + _DENSE.format(where="true", body="true", fetch=80) + " select query_id, chunk_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, spec_id, clause_path nulls first, chunk_id) as rank from do_ where n = 1) where rank <= 10")
def win_02(spark: SparkSession, d: str) -> DataFrame:
    """Dense hits, the newest version of each clause."""
    hits = S.dense_arm(stored_index(spark, d), query_vectors(spark, d), 10, 64)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@add("eval_01_metrics")
def eval_01(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.evaluation import metrics

    hits = search_spec(spark, d).select("query_id", "spec_id", F.col("clause_path").alias("clause"), "rank")
    judged = table(spark, d, "hit_out", "query_id", "arm", "spec_id", "clause", "score").where("arm = 'rerank' and score > 0").groupBy("query_id", "spec_id", "clause").agg(F.lit(2).alias("grade"))
    return metrics(hits, judged, 10)
