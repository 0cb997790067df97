"""More of the survey's operators over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import versioning as V
from ..operators import content as C
from ..operators import maintenance as M
from ..operators import relations as R
from ..operators import services as S
from ..operators import validation as Y
from ..operators.evaluation import gate
from ..retrieval import arms as A
from ..sources.tables import table
from . import planted
from .catalogue import ORD_SQL, V_SQL
from .evolution import _VK as VK_SQL
from .registry import Registry

registry = Registry()
add = registry.add


@add("flt_02_filter_after_fetch", "with p as (select chunk_id, term_id, max(weight)::double as w from clause_sparse group by all), s as (select query_id, chunk_id, round(sum(q.weight::double * p.w), 9) as score from query_terms q join p using (term_id) group by all), r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s), f as (select r.*, row_number() over (partition by query_id order by rank) as n from r join clauses c using (chunk_id) where rank <= 80 and c.release = 'Rel-15') select query_id, chunk_id, rank from f where n <= 10")
def flt_02(spark: SparkSession, d: str) -> DataFrame:
    top = A.top_k(A.sparse_scores(table(spark, d, "clause_sparse"), table(spark, d, "query_terms")), 80, ["chunk_id"])
    hits = top.join(table(spark, d, "clauses", "chunk_id", "release"), "chunk_id")
    return S.overfetch(hits, F.col("release") == "Rel-15", 10).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@add("flt_07_citable", "select spec_id, version from spec_versions where coalesce(docx_url, '') <> '' or coalesce(status, '') <> ''")
def flt_07(spark: SparkSession, d: str) -> DataFrame:
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return table(spark, d, "spec_versions").where(some("docx_url") | some("status")).select("spec_id", "version")


@add("flt_13_list_prefix", "select doc_id from documents where len(list_filter(regexp_extract_all(coalesce(text, ''), 'clause ([0-9.]+)', 1), lambda x: starts_with(x, '12.'))) > 0")
def flt_13(spark: SparkSession, d: str) -> DataFrame:
    listed = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("clause ([0-9.]+)"), F.lit(1))
    return table(spark, d, "documents", "doc_id", "text").where(F.exists(listed, lambda x: x.startswith("12."))).select("doc_id")


@add("flt_18_projection", "select count(*) as n, count(distinct release) as releases from clauses")
def flt_18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("release").alias("releases"))


@add("join_02_three_way", "select c.release, count(*) as parts from clauses c join (select chunk_id, unnest(string_split(text, chr(10) || chr(10))) as part from clauses where text is not null) p using (chunk_id) group by c.release")
def join_02(spark: SparkSession, d: str) -> DataFrame:
    """Occurrence, sequence and paragraph joined."""
    c = C.content_tables(table(spark, d, "clauses", "chunk_id", "spec_id", "release", "version", "clause_path", "heading", "text", "is_normative", "embedding"))
    return c.occurrences.select("release", "body_id").join(c.body_seq, "body_id").join(c.paragraphs.select("para_id"), "para_id").groupBy("release").agg(F.count(F.lit(1)).alias("parts"))


@add("join_05_three_left_joins", "select s.spec_id, v.n is null as unfiled, c.n is null as textless, l.n is null as unlogged from specs s left join (select spec_id, count(*) as n from spec_versions group by 1) v on v.spec_id = s.spec_id left join (select spec_id, count(*) as n from clauses group by 1) c on c.spec_id = s.spec_id left join (select spec_id, count(*) as n from ingest_log where status = 'failed' group by 1) l on l.spec_id = s.spec_id where v.n is null or c.n is null or l.n is null")
def join_05(spark: SparkSession, d: str) -> DataFrame:
    n = lambda df, c: df.groupBy("spec_id").agg(F.count(F.lit(1)).alias(c))
    j = table(spark, d, "specs", "spec_id")
    for df, c in ((table(spark, d, "spec_versions", "spec_id"), "v"), (table(spark, d, "clauses", "spec_id"), "c"), (table(spark, d, "ingest_log", "spec_id", "status").where("status = 'failed'"), "l")):
        j = j.join(n(df, c), "spec_id", "left")
    out = j.select("spec_id", F.col("v").isNull().alias("unfiled"), F.col("c").isNull().alias("textless"), F.col("l").isNull().alias("unlogged"))
    return out.where("unfiled or textless or unlogged")


@add("join_13_decorrelated", "select o_custkey, o_orderkey, o_totalprice from orders o where o_totalprice > (select 1.5::double * avg(o_totalprice) from orders i where i.o_custkey = o.o_custkey)")
def join_13(spark: SparkSession, d: str) -> DataFrame:
    """A correlated aggregate as one aggregation and a join."""
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    mean = o.groupBy("o_custkey").agg((1.5 * F.avg("o_totalprice")).alias("m"))
    return o.join(mean, "o_custkey").where("o_totalprice > m").select("o_custkey", "o_orderkey", "o_totalprice")


@add("join_14_lookups", "select s.spec_id, (select count(*) from spec_versions v where v.spec_id = s.spec_id) > 0 as filed, (select max(docx_url) from spec_versions v where v.spec_id = s.spec_id) as url from specs s")
def join_14(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "spec_versions", "spec_id", "docx_url").groupBy("spec_id").agg(F.max("docx_url").alias("url"), F.lit(True).alias("filed"))
    return table(spark, d, "specs", "spec_id").join(v, "spec_id", "left").select("spec_id", F.coalesce("filed", F.lit(False)).alias("filed"), "url")


@add("join_15_late_text", "with t as (select chunk_id, length(text) as n from clauses order by n desc nulls last, chunk_id limit 40) select c.chunk_id, md5(c.text) as text_md5 from clauses c join t using (chunk_id)")
def join_15(spark: SparkSession, d: str) -> DataFrame:
    """Ranked on lengths, texts fetched for the 40 that stay."""
    rows = table(spark, d, "clauses", "chunk_id", "text")
    top = rows.select("chunk_id", F.length("text").alias("n")).orderBy(F.desc_nulls_last("n"), "chunk_id").limit(40)
    return rows.join(F.broadcast(top), "chunk_id").select("chunk_id", F.md5("text").alias("text_md5"))


@add("join_17_neighbours", f"with {planted.EDGES_SQL} select from_term, to_term, evolution_type from e where upper(from_term) = 'AMF' or upper(to_term) = 'AMF' or upper(from_term) = 'MME' or upper(to_term) = 'MME'")
def join_17(spark: SparkSession, d: str) -> DataFrame:
    """One hop around two terms, whatever their case (a curated relation: the tables hold none)."""
    e = planted.edges(spark)
    both = S.neighbours(e, "mme").unionByName(S.neighbours(e, "Amf")).distinct()
    return both.select("from_term", "to_term", "evolution_type")


@add("agg_05_best_paragraph", "select chunk_id, max(length(part))::bigint as longest from (select chunk_id, unnest(string_split(text, chr(10) || chr(10))) as part from clauses where text is not null) group by chunk_id")
def agg_05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "chunk_id", "text").where("text is not null").select("chunk_id", F.array_max(F.transform(F.split("text", r"\n\n", -1), lambda p: F.length(p))).cast("long").alias("longest"))


@add("agg_16_newest", f"select spec_id, version from (select spec_id, version, row_number() over (partition by spec_id order by {V_SQL.format('version', 'desc')}) as n from (select distinct spec_id, version from clauses)) where n = 1")
def agg_16(spark: SparkSession, d: str) -> DataFrame:
    return S.newest_per(table(spark, d, "clauses", "spec_id", "version"), ["spec_id"], "version")


@add("agg_19_set_union", "select spec_id, array_to_string(list_sort(list(distinct x)), ',') as labels from (select spec_id, release as x from clauses where release is not null union select spec_id, release from spec_versions union select spec_id, 'any' from specs) group by spec_id")
def agg_19(spark: SparkSession, d: str) -> DataFrame:
    s = lambda t: table(spark, d, t, "spec_id", "release").groupBy("spec_id").agg(F.collect_set("release").alias("s"))
    both = s("clauses").unionByName(s("spec_versions")).unionByName(table(spark, d, "specs", "spec_id").select("spec_id", F.array(F.lit("any")).alias("s")))
    return both.groupBy("spec_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))), ",").alias("labels"))


@add("agg_21_macro_mean", "select arm, round(avg(m), 6) as mean from (select arm, query_id, max(score) as m from hit_out where score is not null group by all) group by arm")
def agg_21(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "hit_out", "arm", "query_id", "score").where("score is not null").groupBy("arm", "query_id").agg(F.max("score").alias("m"))
    return per.groupBy("arm").agg(F.round(F.avg("m"), 6).alias("mean"))


@add("win_03_donor", "select heading, chunk_id from (select heading, chunk_id, row_number() over (partition by heading, text order by chunk_id) as n from clauses where embedding is not null) where n = 1")
def win_03(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "chunk_id", "heading", "text", "embedding").where("embedding is not null").select("heading", F.sha2("text", 256).alias("t"), "chunk_id")
    return rows.groupBy("heading", "t").agg(F.min("chunk_id").alias("chunk_id")).select("heading", "chunk_id")


@add("win_05_surrogate_keys", "select id, count(*) as n from (select substr(sha256(case when heading is null then '-1|' else length(heading) || '|' || heading end || '|' || length(text) || '|' || text), 1, 32) as id from clauses where text is not null) group by id")
def win_05(spark: SparkSession, d: str) -> DataFrame:
    """Keys from content instead of counters: the same wherever they are made."""
    rows = table(spark, d, "clauses", "heading", "text").where("text is not null").select(C.content_id(F.col("heading"), F.col("text")).alias("id"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@add("win_06_arm_ranks", "select query_id, arm, chunk_id, row_number() over (partition by query_id, arm order by score desc nulls last, chunk_id) as rank from (select query_id, arm, chunk_id, max(score) as score from hit_out group by all)")
def win_06(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hit_out", "query_id", "arm", "chunk_id", "score").groupBy("query_id", "arm", "chunk_id").agg(F.max("score").alias("score"))
    return h.select("query_id", "arm", "chunk_id", F.row_number().over(Window.partitionBy("query_id", "arm").orderBy(F.desc_nulls_last("score"), "chunk_id")).cast("long").alias("rank"))


@add("sort_06_full_tuple", f"select spec_id, version, release, row_number() over (order by {V_SQL.format('version', '')}, spec_id, release, coalesce(status, ''), coalesce(docx_url, '')) as place from spec_versions order by place limit 200")
def sort_06(spark: SparkSession, d: str) -> DataFrame:
    keys = [V.version_key("version"), F.col("spec_id"), F.col("release"), F.coalesce("status", F.lit("")), F.coalesce("docx_url", F.lit(""))]
    top = table(spark, d, "spec_versions").orderBy(*keys).limit(200)
    return top.select("spec_id", "version", "release", F.row_number().over(Window.orderBy(*keys)).cast("long").alias("place"))


@add("sort_16_best_evidence", "select heading, chunk_id from (select heading, chunk_id, row_number() over (partition by heading order by length(coalesce(text, '')) desc, length(coalesce(clause_path, '')), coalesce(clause_path, ''), chunk_id) as n from clauses where heading <> '') where n = 1")
def sort_16(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "chunk_id", "heading", "clause_path", "text").where("heading <> ''")
    path = F.coalesce("clause_path", F.lit(""))
    key = F.struct((-F.length(F.coalesce("text", F.lit("")))).alias("a"), F.length(path).alias("b"), path.alias("c"), F.col("chunk_id").alias("d"))
    return rows.groupBy("heading").agg(F.min(key)["d"].alias("chunk_id"))


@add("set_02_distinct", "select distinct spec_id, release from clauses")
def set_02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "spec_id", "release").distinct()


@add("set_06_merged_index", f"select spec_id, release, version from (select *, row_number() over (partition by spec_id, release order by {V_SQL.format('version', 'desc')}, version desc) as n from (select spec_id, release, version from spec_versions union select spec_id, release, version from clauses)) where n = 1")
def set_06(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "spec_versions", "spec_id", "release", "version").unionByName(table(spark, d, "clauses", "spec_id", "release", "version"))
    key = F.struct(V.version_key("version").alias("k"), F.col("version").alias("v"))
    return both.groupBy("spec_id", "release").agg(F.max_by("version", key).alias("version"))


@add("sca_14_cosine_distance", "select a.vec_id, round(1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as distance from embeddings a, (select embedding from embeddings where vec_id = 1) b")
def sca_14(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings", "vec_id", "embedding")
    q = F.broadcast(rows.where("vec_id = 1").select(F.col("embedding").alias("q")))  # one row
    return rows.crossJoin(q).select("vec_id", F.round(1 - X.cosine(F.col("embedding"), F.col("q")), 5).alias("distance"))


@add("sca_16_null_lists", "select chunk_id, coalesce(array_to_string(embedding[1:2]::int[], ','), '') as head from clauses")
def sca_16(spark: SparkSession, d: str) -> DataFrame:
    """The first two numbers as whole ones, halves to the even side. One that is no int (NaN, infinite, too large)
    has no SQL result: it is left out of its list as a null is, and the row stays."""
    return table(spark, d, "clauses", "chunk_id", "embedding").select("chunk_id", S.joined_list(F.transform(F.slice("embedding", 1, 2), lambda x: F.rint(x).try_cast("int").cast("string"))).alias("head"))


@add("sca_19_sanitised", "select doc_id, length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'))::bigint as n from documents where text is not null")
def sca_19(spark: SparkSession, d: str) -> DataFrame:
    clean = F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.length(clean).cast("long").alias("n"))


@add("ret_17_service_search", "with o as (select p_type as operation_id, p_name as path, p_name as summary, p_brand as service from part where p_brand = 'Brand#11'), s as (select n_name as schema_name, n_name as description from nation), h as (select 'operation' as kind, operation_id as id, (case when contains(lower(operation_id), 'steel') then 3 else 0 end + case when contains(lower(path), 'steel') then 2 else 0 end + case when contains(lower(summary), 'steel') then 1 else 0 end + case when contains(lower(service), 'steel') then 1 else 0 end + case when contains(lower(operation_id), 'an') then 3 else 0 end + case when contains(lower(path), 'an') then 2 else 0 end + case when contains(lower(summary), 'an') then 1 else 0 end + case when contains(lower(service), 'an') then 1 else 0 end) as score from o union all select 'schema', schema_name, case when contains(lower(schema_name), 'steel') then 3 else 0 end + case when contains(lower(description), 'steel') then 1 else 0 end + case when contains(lower(schema_name), 'an') then 3 else 0 end + case when contains(lower(description), 'an') then 1 else 0 end from s), g as (select kind, id, max(score) as score from h where score > 0 group by all) select kind, id, score::bigint as score, row_number() over (order by score desc, kind, id) as rank from g order by rank limit 15")
def ret_17(spark: SparkSession, d: str) -> DataFrame:
    ops = table(spark, d, "part").select(F.col("p_type").alias("operation_id"), F.col("p_name").alias("path"), F.col("p_name").alias("summary"), F.col("p_brand").alias("service"))
    sch = table(spark, d, "nation").select(F.col("n_name").alias("schema_name"), F.col("n_name").alias("description"))
    hits = S.search_services(ops, sch, ["steel", "an"], 15, service="Brand#11")
    return hits.select("kind", "id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@add("inc_04_attestation", "select 'bodies' as name, (select count(*) from (select distinct heading, text from clauses where text is not null)) as now, (select count(*) from (select distinct heading, text from clauses where text is not null)) as stamped, true as holds union all select 'occurrences', (select count(*) from clauses where text is not null), (select count(*) from clauses), (select count(*) from clauses where text is not null) = (select count(*) from clauses)")
def inc_04(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "heading", "text")
    held = rows.where("text is not null").select(C.content_id(F.col("heading"), F.col("text")).alias("id"))
    now = held.agg(F.countDistinct("id").alias("bodies"), F.count(F.lit(1)).alias("occurrences"))
    bodies = held.agg(F.countDistinct("id").alias("value")).select(F.lit("bodies").alias("name"), "value")
    stamped = bodies.unionByName(rows.agg(F.count(F.lit(1)).alias("value")).select(F.lit("occurrences").alias("name"), "value"))
    return S.attest(now, stamped)


@add("inc_15_drift", f"with s as (select spec_id, release, arg_max(version, {VK_SQL}) as version, max({VK_SQL}) as v from spec_versions group by all), h as (select spec_id, release, max({VK_SQL}) as h from clauses where chunk_id % 3 <> 0 and spec_id not like '%1' group by all) select s.spec_id, s.release, case when h is null then 'missing' else 'stale' end as state, s.version from s left join h on h.spec_id = s.spec_id and h.release = s.release where h is null or v > h")
def inc_15(spark: SparkSession, d: str) -> DataFrame:
    """Filings that a corpus without some of its specs and rows is missing, or holds an older version of."""
    held = table(spark, d, "clauses", "chunk_id", "spec_id", "release", "version").where("chunk_id % 3 <> 0 and spec_id not like '%1'")
    return M.drift(table(spark, d, "spec_versions", "spec_id", "release", "version"), held)


@add("snk_07_set_equal", "select * from (values ('reordered', true), ('one fewer', false), ('one more', false), ('one changed', false)) v(case_, skipped)")
def snk_07(spark: SparkSession, d: str) -> DataFrame:
    """A replacement of the curated edges is skipped for an equal set only."""
    held = planted.edges(spark)
    more = spark.createDataFrame([("x", "y", "z", "1", "1")], held.schema)
    cases = {"reordered": planted.EDGES[::-1], "one fewer": planted.EDGES[1:], "one changed": [("MME", "AMF", "merged", "33.501", "3.2"), *planted.EDGES[1:]]}
    frames = {k: spark.createDataFrame(v, held.schema) for k, v in cases.items()} | {"one more": held.unionByName(more)}
    same = lambda a, b: a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count(F.lit(1)) == 0).alias("skipped"))
    return reduce(DataFrame.unionByName, [same(held, x).select(F.lit(k).alias("case_"), "skipped") for k, x in frames.items()])


@add("snk_13_posting_writer", "select chunk_id, term_id, weight::double as weight from clause_sparse where chunk_id % 10 <> 0 union all select chunk_id, term_id, max(weight)::double / 2 from clause_sparse where chunk_id % 10 = 0 group by chunk_id, term_id")
def snk_13(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "clause_sparse").withColumn("weight", F.col("weight").cast("double"))
    new = p.where("chunk_id % 10 = 0").groupBy("chunk_id", "term_id").agg((F.max("weight") / 2).alias("weight"))
    return R.delete_keys(p, new.select("chunk_id"), ["chunk_id"]).select("chunk_id", "term_id", "weight").unionByName(new)


@add("snk_19_metadata", "select status as key, coalesce(max(pipeline_version), '') as value from ingest_log group by status")
def snk_19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingest_log", "status", "pipeline_version").groupBy(F.col("status").alias("key")).agg(F.coalesce(F.max("pipeline_version"), F.lit("")).alias("value"))


@add("val_08_index_state", "select * from (values ('current', 'current', ''), ('more vectors', 'drifted', 'vectors'), ('other model', 'unusable', 'model'), ('other size', 'unusable', 'dim,vectors'), ('no stamp', 'unusable', 'model,metric,dim,vectors')) v(case_, verdict, why)")
def val_08(spark: SparkSession, d: str) -> DataFrame:
    """The index of the embedded clauses against stamps that hold, and that don't."""
    c = table(spark, d, "clauses", "embedding").where(X.clean_vector(F.col("embedding"), 64))
    now = c.agg(F.lit("model-a").alias("model"), F.lit("cosine").alias("metric"), F.max(F.size("embedding")).alias("dim"), F.count(F.lit(1)).alias("vectors"))
    stamps = {
        "current": now, "more vectors": now.withColumn("vectors", F.col("vectors") - 1), "other model": now.withColumn("model", F.lit("model-b")),
        "other size": now.withColumn("dim", F.lit(1024)).withColumn("vectors", F.lit(0).cast("long")), "no stamp": now.where("false"),
    }
    return reduce(DataFrame.unionByName, [Y.index_state(now, s).select(F.lit(k).alias("case_"), "verdict", "why") for k, s in stamps.items()])


@add("eval_04_gate", "with m as (select arm as system, round(avg(score), 6) as value from hit_out where score is not null group by arm) select system, 'mean' as metric, value as current, value + case when system = 'dense' then 0.5::double else 0.0::double end as baseline, system <> 'dense' as passed from m")
def eval_04(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "hit_out", "arm", "score").where("score is not null").groupBy(F.col("arm").alias("system")).agg(F.round(F.avg("score"), 6).alias("value")).withColumn("metric", F.lit("mean"))
    base = now.withColumn("value", F.col("value") + F.when(F.col("system") == "dense", 0.5).otherwise(0.0))
    return gate(now, base, 0.02)


@add("lin_11_later_annex", f"with b as (select distinct spec_id, clause_path from clauses where release = 'Rel-15' and clause_path <> ''), l as (select spec_id, clause_path, min({ORD_SQL.format('release')})::int as first_later from clauses where clause_path <> '' and {ORD_SQL.format('release')} > 15 group by all) select l.* from l where not exists (select 1 from b where b.spec_id = l.spec_id and b.clause_path = l.clause_path)")
def lin_11(spark: SparkSession, d: str) -> DataFrame:
    """What the baseline lacks, with the first later release that has it."""
    rows = table(spark, d, "clauses", "spec_id", "release", "clause_path").where("clause_path <> ''").withColumn("o", V.release_ordinal("release"))
    later = rows.where("o > 15").groupBy("spec_id", "clause_path").agg(F.min("o").alias("first_later"))
    return later.join(rows.where("release = 'Rel-15'"), ["spec_id", "clause_path"], "left_anti")


@add("val_09_justified_edges", f"with {planted.SQL}, {planted.EDGES_SQL}, n as (select spec_id, max({VK_SQL}) as v from c group by 1), l as (select c.spec_id, c.clause_path, arg_max(coalesce(heading, '') || ' ' || coalesce(text, ''), chunk_id) as t from c join n using (spec_id) where {VK_SQL} = n.v group by all) select e.from_term, e.to_term, case when t is null then 'missing' when list_contains(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{Nd}}]+'), lower(e.to_term)) then 'ok' else 'unnamed' end as state from e left join l on l.spec_id = e.spec_id and l.clause_path = e.clause")
def val_09(spark: SparkSession, d: str) -> DataFrame:
    """Curated edges against the clauses they cite, among them planted ones."""
    return Y.justified_edges(planted.edges(spark), planted.clauses(spark, d))


@add("inc_19_site_diff", "with s as (select distinct spec_id, version from spec_versions where status = 'published'), h as (select distinct spec_id, version from clauses), j as (select coalesce(s.spec_id, h.spec_id) as spec_id, coalesce(s.version, h.version) as version, case when h.spec_id is null then 'new' when s.spec_id is null then 'gone' end as state from s full join h on h.spec_id = s.spec_id and h.version = s.version) select * from j where state is not null and spec_id in (select spec_id from s)")
def inc_19(spark: SparkSession, d: str) -> DataFrame:
    """Published versions against those that have clauses."""
    site = table(spark, d, "spec_versions", "spec_id", "version", "status").where("status = 'published'")
    return M.site_diff(site, table(spark, d, "clauses", "spec_id", "version"))


@add("inc_16_filing_release", f"with f as (select distinct spec_id, release, version, coalesce(try_cast(split_part(version, '.', 1) as int), 0) as major from spec_versions), o as (select *, case when major = 3 then 'Rel-99' when major >= 4 then 'Rel-' || major end as own from f) select spec_id, release, version, case when own <> release and {ORD_SQL.format('own')} >= 8 and exists (select 1 from spec_versions v where v.spec_id = o.spec_id and v.release = o.own) then own else release end as filed from o")
def inc_16(spark: SparkSession, d: str) -> DataFrame:
    filings = table(spark, d, "spec_versions", "spec_id", "release", "version").distinct()
    return M.filing_release(filings, filings, 8)


@add("inc_10_overlay", "with b as (select chunk_id, case when chunk_id % 2 = 0 then embedding_hash end as embedding_hash from clauses), o as (select chunk_id, embedding_hash from clauses where chunk_id % 3 = 0) select b.chunk_id, coalesce(b.embedding_hash, o.embedding_hash) as embedding_hash from b left join o using (chunk_id)")
def inc_10(spark: SparkSession, d: str) -> DataFrame:
    """Vectors made elsewhere fill what a corpus lacks (their hashes stand for them)."""
    rows = table(spark, d, "clauses", "chunk_id", "embedding_hash")
    base = rows.withColumn("embedding_hash", F.when(F.col("chunk_id") % 2 == 0, F.col("embedding_hash")))
    return M.overlay_vectors(base, rows.where("chunk_id % 3 = 0"), ["chunk_id"], "embedding_hash", "model-a", "model-a")


_FOOT = "b as (select 'li' as subject, series, count(*) as f from specs group by series), n as (select 'li' as subject, series, count(*) + case when series in ('22', '33') then 1 else 0 end as f from specs where series <> '38' group by series)"


@add("inc_22_series_to_rebuild", f"with {_FOOT} select coalesce(b.series, n.series) as series from b full join n using (subject, series) where b.f is distinct from n.f")
def inc_22(spark: SparkSession, d: str) -> DataFrame:
    """Series whose footprint (here: a count of specs) changed."""
    before = table(spark, d, "specs", "series").groupBy("series").agg(F.count(F.lit(1)).alias("footprint")).withColumn("subject", F.lit("li"))
    now = before.where("series <> '38'").withColumn("footprint", F.col("footprint") + F.when(F.col("series").isin("22", "33"), 1).otherwise(0))
    return M.series_to_rebuild(before, now)


@add("val_07_contract_of_halves", """with r as (select distinct release from clauses where release is not null), w as (select code as release from releases where code <> 'Rel-4'), d1 as (select count(*) as n from ((select * from r except select * from w) union all (select * from w except select * from r))),
d2 as (select count(*) as n from (select spec_id, version from (select spec_id, version, count(*) as c from clauses group by spec_id, version, clause_path, heading, text) group by 1, 2 having min(c) > 1)),
d3 as (select count(*) as n from (select heading, text from clauses where text is not null group by 1, 2 having count(distinct embedding_hash) > 1)),
d4 as (select count(*) as n from (select distinct chunk_id from clause_sparse) where chunk_id not in (select chunk_id from clauses)),
d5 as (select count(*) filter (where not weight > 0) as n from clause_sparse),
d6 as (select count(*) as n from (select half from (select case when upper(trim(spec_id)) like 'ETSI%' then 'etsi' else '3gpp' end as half, heading, text, max(case when embedding is not null then 1 else 0 end) as e from clauses where length(trim(text)) > 0 group by all) group by half having count(*) <> sum(e))),
d8 as (select count(*) filter (where regexp_matches(text, 'BEGIN [A-Z ]*PRIVATE KEY')) as n from clauses),
a as (select 'expected-releases' as name, n from d1 union all select 'no-reingest', n from d2 union all select 'one-hash-a-body', n from d3 union all select 'postings-known', n from d4 union all select 'postings-positive', n from d5 union all select 'halves-embedded', n from d6 union all select 'nothing-forbidden', n from d8)
select name, n = 0 as passed, n::varchar as detail from a union all select 'one-model', false, '2'""")
def val_07(spark: SparkSession, d: str) -> DataFrame:
    """The further checks, with a release left out and two models: those two must fail."""
    codes = [r[0] for r in table(spark, d, "releases", "code").where("code <> 'Rel-4'").collect()]  # 19 rows, which don't grow
    return Y.contract_of_halves(table(spark, d, "clauses"), table(spark, d, "clause_sparse"), codes, {"3gpp": "model-a", "etsi": "model-b"}, forbidden="BEGIN [A-Z ]*PRIVATE KEY")


@add("sort_15_length_batches", "with l as (select chunk_id, length(text)::bigint as n from clauses where length(trim(text)) > 0), o as (select *, row_number() over (order by n, chunk_id) - 1 as p from l) select p // 64 as batch, count(*) as rows, min(n) as shortest, max(n) as longest from o group by 1")
def sort_15(spark: SparkSession, d: str) -> DataFrame:
    """Texts in batches of 64 of nearly equal length: ordered over ranges, numbered without gathering."""
    rows = table(spark, d, "clauses", "chunk_id", "text").where(X.has_text("text")).select("chunk_id", F.length("text").cast("long").alias("n"))
    return S.numbered(rows, ["n", "chunk_id"]).groupBy(F.floor(F.col("place") / 64).alias("batch")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("shortest"), F.max("n").alias("longest"))


@add("snk_03_api_rows", "with p as (select n_name as schema_name, array_to_string(list(r_name order by r_name), chr(31)) as listed from nation join region on r_regionkey = n_regionkey group by n_name) select schema_name, len(string_split(listed, chr(31)))::int as n, string_split(listed, chr(31))[1] as first from p")
def snk_03(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose lists come as one text; of a repeated key the last holds."""
    regions = table(spark, d, "region", "r_regionkey", "r_name")
    packed = table(spark, d, "nation", "n_name", "n_regionkey").join(regions, F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("n_name").alias("schema_name")).agg(F.array_join(F.array_sort(F.collect_list("r_name")), "\x1f").alias("listed"))
    old = packed.withColumn("listed", F.lit("old"))
    rows = S.unpacked(R.upsert(old, packed, ["schema_name"]), ["listed"])
    return rows.select("schema_name", F.size("listed").alias("n"), F.element_at("listed", 1).alias("first"))


@add("lin_09_version_in_release", "with v as (select distinct spec_id, release, version from spec_versions), w as (select spec_id, version, 'Rel-16' as asked from (select distinct spec_id, version from spec_versions)) select w.spec_id, w.version, case when exists (select 1 from v where v.spec_id = w.spec_id and v.version = w.version and v.release = w.asked) then 'there' when exists (select 1 from v where v.spec_id = w.spec_id and v.version = w.version) then 'elsewhere' else 'unknown' end as state from w")
def lin_09(spark: SparkSession, d: str) -> DataFrame:
    versions = table(spark, d, "spec_versions", "spec_id", "release", "version")
    asked = versions.select("spec_id", "version").distinct().withColumn("release", F.lit("Rel-16"))
    return S.version_in_release(asked, versions).select("spec_id", "version", "state")
