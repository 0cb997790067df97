"""Scans, filters, projections, ordering and scalar functions over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import versioning as V
from ..sources.tables import table
from .registry import Registry

registry = Registry()
add = registry.add

#: The version's three numbers in SQL, for the statements below.
V_SQL = "coalesce(try_cast(split_part({0}, '.', 1) as int), 0) {1}, coalesce(try_cast(split_part({0}, '.', 2) as int), 0) {1}, coalesce(try_cast(split_part({0}, '.', 3) as int), 0) {1}"
ORD_SQL = "(case when {0} = 'Rel-99' then 3 when coalesce(try_cast(regexp_extract({0}, '^Rel-([0-9]+)$', 1) as int), 0) >= 4 then try_cast(regexp_extract({0}, '^Rel-([0-9]+)$', 1) as int) else -1 end)"


@add("src_05_filtered_scan", "select spec_id, release, version, status from spec_versions where status = 'published' and freeze_date is not null")
def src_05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spec_versions").where((F.col("status") == "published") & F.col("freeze_date").isNotNull()).select("spec_id", "release", "version", "status")


@add("src_20_literal_rows", "select t.term_id, count(*) as postings from (values (4, 0.5), (5, 0.25), (6, 0.25)) q(term_id, w) join clause_sparse t on t.term_id = q.term_id group by t.term_id")
def src_20(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([(4, 0.5), (5, 0.25), (6, 0.25)], "term_id long, w double")
    return table(spark, d, "clause_sparse", "term_id").join(F.broadcast(q), "term_id").groupBy("term_id").agg(F.count(F.lit(1)).alias("postings"))


@add("src_22_introspection", "select 'specs' as name, count(*) as n from specs union all select 'spec_versions', count(*) from spec_versions union all select 'releases', count(*) from releases union all select 'clauses', count(*) from clauses union all select 'clause_sparse', count(*) from clause_sparse union all select 'ingest_log', count(*) from ingest_log")
def src_22(spark: SparkSession, d: str) -> DataFrame:
    names = ("specs", "spec_versions", "releases", "clauses", "clause_sparse", "ingest_log")
    parts = [table(spark, d, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@add("src_04_shard_coherence", "select count(distinct source) as models, count(distinct source) = 1 as coherent from documents")
def src_04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "source").agg(F.countDistinct("source").alias("models")).withColumn("coherent", F.col("models") == 1)


@add("flt_01_shared_filter", "select c.chunk_id, c.spec_id, c.release, c.clause_path from clauses c where release = 'Rel-15' and (spec_id like '95.%') and spec_id in (select spec_id from specs where upper(doc_type) = 'TS')")
def flt_01(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "specs").where(F.upper("doc_type") == "TS").select("spec_id")
    rows = table(spark, d, "clauses", "chunk_id", "spec_id", "release", "clause_path").where((F.col("release") == "Rel-15") & F.col("spec_id").startswith("95."))
    return rows.join(wanted, "spec_id", "left_semi").select("chunk_id", "spec_id", "release", "clause_path")


@add("flt_03_path_prefix", "select chunk_id, clause_path from clauses where clause_path = '4.5' or clause_path like '4.5.%'")
def flt_03(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("clause_path")
    return table(spark, d, "clauses", "chunk_id", "clause_path").where((p == "4.5") | p.startswith("4.5."))


@add("flt_04_direct_children", "select chunk_id, clause_path from clauses where clause_path like '4.5.%' and length(clause_path) > 4 and position('.' in substr(clause_path, 5)) = 0")
def flt_04(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("clause_path")
    rest = F.substring(p, 5, 1_000_000)
    return table(spark, d, "clauses", "chunk_id", "clause_path").where(p.startswith("4.5.") & (rest != "") & ~rest.contains("."))


@add("flt_05_related_paths", "select distinct a.clause_path as ancestor, b.clause_path as descendant from (select distinct clause_path from clauses where clause_path <> '') a join (select distinct clause_path from clauses where clause_path <> '') b on b.clause_path like a.clause_path || '.%' where regexp_matches(a.clause_path, '^[0-9A-Z.]+$')")
def flt_05(spark: SparkSession, d: str) -> DataFrame:
    """Every path with its ancestors: an equi-join on the path's own prefixes."""
    paths = table(spark, d, "clauses", "clause_path").where("clause_path <> ''").distinct()
    parts = F.split("clause_path", r"\.")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))
    below = paths.where(F.size(parts) > 1).select(F.col("clause_path").alias("descendant"), prefix.alias("ancestor")).where(F.col("descendant") != F.concat("ancestor", F.lit(".")) )
    dotted = paths.where(F.col("clause_path").endswith(".")).select(F.col("clause_path").alias("descendant"), F.regexp_replace("clause_path", r"\.$", "").alias("ancestor"))
    return below.unionByName(dotted).join(paths.select(F.col("clause_path").alias("ancestor")).where(F.col("ancestor").rlike("^[0-9A-Z.]+$")), "ancestor", "left_semi").select("ancestor", "descendant").distinct()


@add("flt_06_embeddable", "select coalesce(release, '') as release, count(*) filter (where length(trim(text)) > 0) as embeddable, count(*) as n from clauses group by 1")
def flt_06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "release", "text").groupBy(F.coalesce("release", F.lit("")).alias("release")).agg(F.count_if(X.has_text("text")).alias("embeddable"), F.count(F.lit(1)).alias("n"))


@add("flt_08_keyword_score", "select * from (select chunk_id, (case when contains(lower(coalesce(heading, '')), 'beacon') then 2 else 0 end + case when contains(lower(coalesce(text, '')), 'beacon') then 1 else 0 end + case when contains(lower(coalesce(heading, '')), 'harbour') then 2 else 0 end + case when contains(lower(coalesce(text, '')), 'harbour') then 1 else 0 end)::bigint as score from clauses) where score > 0")
def flt_08(spark: SparkSession, d: str) -> DataFrame:
    score = sum((F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t)), w).otherwise(0) for t in ("beacon", "harbour") for c, w in (("heading", 2), ("text", 1))), F.lit(0))
    return table(spark, d, "clauses", "chunk_id", "heading", "text").select("chunk_id", score.cast("long").alias("score")).where("score > 0")


@add("flt_09_stable_versions", "select spec_id, release, version, case when upper(trim(spec_id)) like 'ETSI%' then regexp_matches(version, '^[0-9]+\\.[0-9]+\\.[0-9]+$') else coalesce(try_cast(split_part(version, '.', 1) as int), 0) >= 3 end as stable from spec_versions")
def flt_09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spec_versions", "spec_id", "release", "version").withColumn("stable", V.is_stable("spec_id", "version"))


@add("flt_10_version_bounds", "select spec_id, version from spec_versions where version <> '' and (coalesce(try_cast(split_part(version, '.', 1) as int), 0) * 1000000 + coalesce(try_cast(split_part(version, '.', 2) as int), 0) * 1000 + coalesce(try_cast(split_part(version, '.', 3) as int), 0)) between 10002000 and 15010009")
def flt_10(spark: SparkSession, d: str) -> DataFrame:
    lit = lambda *v: F.struct(*[F.lit(x).alias(f"v{i + 1}") for i, x in enumerate(v)])
    return table(spark, d, "spec_versions", "spec_id", "version").where((F.col("version") != "") & V.version_key("version").between(lit(10, 2, 0), lit(15, 10, 9)))


@add("flt_11_release_bounds", "select spec_id, version from spec_versions where coalesce(try_cast(split_part(version, '.', 1) as int), 0) between 8 and 12")
def flt_11(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = (V.release_major(F.lit(r)) for r in ("Rel-8", "12"))
    return table(spark, d, "spec_versions", "spec_id", "version").where(V.version_part("version", 1).between(lo, hi))


@add("flt_14_case_insensitive", "select spec_id, doc_type from specs where lower(doc_type) = 'tr'")
def flt_14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "specs", "spec_id", "doc_type").where(F.lower("doc_type") == "tr")


@add("flt_15_tuple_in", "select chunk_id, spec_id, release from clauses where (spec_id, release) in (select spec_id, release from spec_versions where status = 'withdrawn' or freeze_date is null)")
def flt_15(spark: SparkSession, d: str) -> DataFrame:
    scope = table(spark, d, "spec_versions").where((F.col("status") == "withdrawn") | F.col("freeze_date").isNull()).select("spec_id", "release")
    return table(spark, d, "clauses", "chunk_id", "spec_id", "release").join(scope, ["spec_id", "release"], "left_semi").select("chunk_id", "spec_id", "release")


@add("flt_17_doc_type_default", "select spec_id, coalesce(nullif(upper(trim(doc_type)), ''), 'TS') as doc_type from specs where coalesce(nullif(upper(trim(doc_type)), ''), 'TS') in ('TS', 'EN')")
def flt_17(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(F.nullif(F.upper(F.trim("doc_type")), F.lit("")), F.lit("TS"))
    return table(spark, d, "specs", "spec_id", "doc_type").select("spec_id", kind.alias("doc_type")).where(F.col("doc_type").isin("TS", "EN"))


@add("sort_01_release_order", f"select code, cast({ORD_SQL.format('code')} as int) as ordinal, row_number() over (order by {ORD_SQL.format('code')} desc, code) as place from releases")
def sort_01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "releases", "code").select("code", V.release_ordinal("code").alias("ordinal")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("ordinal"), "code")).cast("long"))


@add("sort_03_newest_first", f"select spec_id, release, version, row_number() over (partition by spec_id order by {ORD_SQL.format('release')} desc, {V_SQL.format('version', 'desc')}, freeze_date desc nulls last, release, version) as place from spec_versions")
def sort_03(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("spec_id").orderBy(V.release_ordinal("release").desc(), V.version_key("version").desc(), F.desc_nulls_last("freeze_date"), "release", "version")
    return table(spark, d, "spec_versions", "spec_id", "release", "version", "freeze_date").select("spec_id", "release", "version", F.row_number().over(w).cast("long").alias("place"))


@add("sort_04_clause_order", "select chunk_id, row_number() over (partition by spec_id, version order by length(clause_path) nulls first, clause_path nulls first, chunk_id) as place from clauses")
def sort_04(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("spec_id", "version").orderBy(F.asc_nulls_first(F.length("clause_path")), F.asc_nulls_first("clause_path"), "chunk_id")
    return table(spark, d, "clauses", "chunk_id", "spec_id", "version", "clause_path").select("chunk_id", F.row_number().over(w).cast("long").alias("place"))


_LATEST = f"select spec_id, version from (select spec_id, version, row_number() over (partition by spec_id order by (case when upper(trim(spec_id)) like 'ETSI%' then regexp_matches(version, '^[0-9]+\\.[0-9]+\\.[0-9]+$') else coalesce(try_cast(split_part(version, '.', 1) as int), 0) >= 3 end) desc, {V_SQL.format('version', 'desc')}, version) as n from spec_versions) where n = 1"


@add("sort_09_latest_version", _LATEST)
def sort_09(spark: SparkSession, d: str) -> DataFrame:
    """A stable version before a newer draft; one aggregation, no sort."""
    key = F.struct(V.is_stable("spec_id", "version").alias("s"), V.version_key("version").alias("v"))
    return table(spark, d, "spec_versions", "spec_id", "version").groupBy("spec_id").agg(F.max_by("version", key).alias("version"))


@add("sort_10_version_in_release", f"select spec_id, release, version from (select *, row_number() over (partition by spec_id, release order by {V_SQL.format('version', 'desc')}, version) as n from spec_versions) where n = 1")
def sort_10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spec_versions", "spec_id", "release", "version").groupBy("spec_id", "release").agg(F.max_by("version", V.version_key("version")).alias("version"))


@add("sort_11_newest_with_text", f"select spec_id, release from (select spec_id, release, row_number() over (partition by spec_id order by {ORD_SQL.format('release')} desc, release) as n from (select distinct spec_id, release from clauses where release is not null)) where n = 1")
def sort_11(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("spec_id").orderBy(V.release_ordinal("release").desc(), "release")
    return table(spark, d, "clauses", "spec_id", "release").where("release is not null").distinct().withColumn("n", F.row_number().over(w)).where("n = 1").select("spec_id", "release")


@add("sort_12_page", "select chunk_id, place from (select chunk_id, row_number() over (order by length(text) desc nulls last, chunk_id) as place from clauses) where place between 21 and 31")
def sort_12(spark: SparkSession, d: str) -> DataFrame:
    """Offset 20, page of 10 and one more that tells whether pages follow; a top-k, not a sort of all."""
    top = table(spark, d, "clauses", "chunk_id", "text").select("chunk_id", F.length("text").alias("n")).orderBy(F.desc_nulls_last("n"), "chunk_id").limit(31)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("n"), "chunk_id")).cast("long")).where("place > 20").select("chunk_id", "place")


@add("sort_14_worklist", f"select chunk_id, row_number() over (order by {ORD_SQL.format('release')} desc, chunk_id) as place from clauses where length(trim(text)) > 0 and embedding is null order by {ORD_SQL.format('release')} desc, chunk_id limit 500")
def sort_14(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "chunk_id", "release", "text", "embedding").where(X.has_text("text") & F.col("embedding").isNull())
    top = rows.select("chunk_id", V.release_ordinal("release").alias("o")).orderBy(F.desc("o"), "chunk_id").limit(500)
    return top.select("chunk_id", F.row_number().over(Window.orderBy(F.desc("o"), "chunk_id")).cast("long").alias("place"))


@add("sca_04_version_compare", "with v as (select distinct version from spec_versions) select a.version as a, b.version as b from v a join v b on split_part(a.version, '.', 1) = split_part(b.version, '.', 1) and (coalesce(try_cast(split_part(a.version, '.', 1) as int), 0), coalesce(try_cast(split_part(a.version, '.', 2) as int), 0), coalesce(try_cast(split_part(a.version, '.', 3) as int), 0)) < (coalesce(try_cast(split_part(b.version, '.', 1) as int), 0), coalesce(try_cast(split_part(b.version, '.', 2) as int), 0), coalesce(try_cast(split_part(b.version, '.', 3) as int), 0))")
def sca_04(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "spec_versions", "version").distinct().withColumn("major", F.split_part("version", F.lit("."), F.lit(1)))
    a = v.select("major", F.col("version").alias("a"))
    b = v.select("major", F.col("version").alias("b"))
    return a.join(b, "major").where(V.version_key("a") < V.version_key("b")).select("a", "b")


@add("sca_05_version_code", "with p as (select distinct version, coalesce(try_cast(split_part(version, '.', 1) as int), 0) a, coalesce(try_cast(split_part(version, '.', 2) as int), 0) b, coalesce(try_cast(split_part(version, '.', 3) as int), 0) c from spec_versions) select version, case when greatest(a, b, c) <= 35 then substr('0123456789abcdefghijklmnopqrstuvwxyz', a + 1, 1) || substr('0123456789abcdefghijklmnopqrstuvwxyz', b + 1, 1) || substr('0123456789abcdefghijklmnopqrstuvwxyz', c + 1, 1) else lpad(a::varchar, 2, '0') || lpad(b::varchar, 2, '0') || lpad(c::varchar, 2, '0') end as code, a || '.' || b || '.' || c as back from p")
def sca_05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spec_versions", "version").distinct().select("version", X.version_code("version").alias("code")).withColumn("back", X.version_of_code("code"))


@add("sca_06_release_major", "select code, case when lower(trim(code)) = 'rel-99' then 3 else try_cast(nullif(regexp_extract(lower(trim(code)), '^(rel-)?([0-9]+)$', 2), '') as int) end as major from releases")
def sca_06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "releases", "code").select("code", V.release_major("code").alias("major"))


@add("sca_07_citations", "with p as (select distinct spec_id, release, version, coalesce(try_cast(split_part(version, '.', 1) as int), 0) a, coalesce(try_cast(split_part(version, '.', 2) as int), 0) b, coalesce(try_cast(split_part(version, '.', 3) as int), 0) c from spec_versions where upper(trim(spec_id)) not like 'ETSI%') select spec_id, version, 'https://www.3gpp.org/ftp/Specs/archive/' || split_part(spec_id, '.', 1) || '_series/' || spec_id || '/' || replace(spec_id, '.', '') || '-' || (case when greatest(a, b, c) <= 35 then substr('0123456789abcdefghijklmnopqrstuvwxyz', a + 1, 1) || substr('0123456789abcdefghijklmnopqrstuvwxyz', b + 1, 1) || substr('0123456789abcdefghijklmnopqrstuvwxyz', c + 1, 1) else lpad(a::varchar, 2, '0') || lpad(b::varchar, 2, '0') || lpad(c::varchar, 2, '0') end) || '.zip' as url, '3gpp://' || spec_id || '/' || release || '@' || version as resource from p")
def sca_07(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spec_versions", "spec_id", "release", "version").where(~V.is_etsi("spec_id")).distinct()
    return rows.select("spec_id", "version", X.archive_url("spec_id", "version").alias("url"), X.resource_uri("spec_id", "release", F.lit(""), "version").alias("resource"))


@add("sca_08_etsi_ids", "select spec_id, 'ETSI TS ' || regexp_extract(spec_id, '^ETSI +(TS|TR|EN) +(1[0-9][0-9]) *([0-9][0-9][0-9])', 2) || ' ' || regexp_extract(spec_id, '^ETSI +(TS|TR|EN) +(1[0-9][0-9]) *([0-9][0-9][0-9])', 3) as normal from specs where upper(trim(spec_id)) like 'ETSI%'")
def sca_08(spark: SparkSession, d: str) -> DataFrame:
    part = lambda n: F.regexp_extract("spec_id", r"^ETSI +(TS|TR|EN) +(1[0-9][0-9]) *([0-9][0-9][0-9])", n)
    return table(spark, d, "specs", "spec_id").where(V.is_etsi("spec_id")).select("spec_id", F.concat(F.lit("ETSI TS "), part(2), F.lit(" "), part(3)).alias("normal"))


@add("sca_10_series", "select case when upper(trim(spec_id)) like 'ETSI%' then 'ETSI' else split_part(spec_id, '.', 1) end as own_series, count(*) as n, count(*) filter (where series = case when upper(trim(spec_id)) like 'ETSI%' then 'ETSI' else split_part(spec_id, '.', 1) end) as same from specs group by 1")
def sca_10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "specs", "spec_id", "series").withColumn("own_series", X.series_of("spec_id"))
    return rows.groupBy("own_series").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("series") == F.col("own_series")).alias("same"))


@add("sca_11_content_hash", "select chunk_id, substr(sha256(coalesce(heading, '') || chr(10) || coalesce(text, '') || '|model-a'), 1, 16) as hash from clauses")
def sca_11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "chunk_id", "heading", "text").select("chunk_id", X.content_hash("heading", "text", "model-a").alias("hash"))


@add("sca_12_identity", "select spec_id, substr(sha256(coalesce(spec_id, '') || '|' || coalesce(series, '') || '|' || coalesce(title, '')), 1, 12) as id from specs")
def sca_12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "specs", "spec_id", "series", "title").select("spec_id", X.identity_digest("spec_id", "series", "title").alias("id"))


@add("sca_13_hash_shards", "select (('0x' || substr(h, 1, 16))::ubigint % 7)::bigint as shard, count(*) as n from (select sha256(coalesce(heading, '') || chr(10) || coalesce(text, '') || '|model-a') as h from clauses) group by 1")
def sca_13(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "heading", "text").select(X.hash_shard(X.content_hash("heading", "text", "model-a"), 7).alias("shard"))
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@add("sca_17_like_tokens", "select query_id, array_to_string(case when len(t) > 0 then t[1:12] else [lower(query_text)] end, ' ') as tokens from (select query_id, query_text, (select list(x order by i) from (select x, min(i) as i from (select unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) as x, generate_subscripts(regexp_extract_all(lower(query_text), '[a-z0-9]+'), 1) as i) where length(x) >= 2 group by x)) as t from search_queries)")
def sca_17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_queries", "query_id", "query_text").select("query_id", F.array_join(X.like_tokens("query_text"), " ").alias("tokens"))


@add("sca_20_windows", "with w as (select chunk_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as ws from clauses where text is not null) select chunk_id, greatest(1, ceil(len(ws) / 128.0))::bigint as windows from w")
def sca_20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "chunk_id", "text").where("text is not null").select("chunk_id", F.size(X.windows("text", 128)).cast("long").alias("windows"))


@add("sca_21_snippets", "select chunk_id, case when length(trim(coalesce(text, ''))) > 400 then substr(trim(coalesce(text, '')), 1, 400) || '…' else trim(coalesce(text, '')) end as snippet from clauses")
def sca_21(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "chunk_id", "text").select("chunk_id", X.snippet("text").alias("snippet"))


@add("sca_22_resource_uris", "select chunk_id, '3gpp://' || replace(replace(coalesce(spec_id, ''), '%', '%25'), ' ', '%20') || '/' || replace(replace(coalesce(release, ''), '%', '%25'), ' ', '%20') || case when coalesce(clause_path, '') <> '' then '/' || replace(replace(clause_path, '%', '%25'), ' ', '%20') else '' end || case when coalesce(version, '') <> '' then '@' || replace(replace(version, '%', '%25'), ' ', '%20') else '' end as resource from clauses")
def sca_22(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "chunk_id", "spec_id", "release", "clause_path", "version").select("chunk_id", X.resource_uri("spec_id", "release", "clause_path", "version").alias("resource"))


@add("sca_23_collapse", "select chunk_id, trim(regexp_replace(text, '[ \\t\\r\\n\\x{00A0}]+', ' ', 'g')) as text from clauses")
def sca_23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "chunk_id", "text").select("chunk_id", X.collapse("text").alias("text"))


_HEADING = """
with h as (select distinct trim(clause_path) || ' ' || trim(heading) as h from clauses where clause_path is not null and heading is not null)
select h, case when regexp_matches(h, '^[A-Z]\\.[0-9]+(\\.[0-9A-Za-z]+)* .+$') then 'annex-sub' when regexp_matches(h, '^[0-9]+(\\.[0-9A-Za-z]+)* .+$') then 'numeric' else 'none' end as kind from h
"""


@add("sca_24_heading_kind", _HEADING)
def sca_24(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "clause_path", "heading").where("clause_path is not null and heading is not null").select(F.concat(F.trim("clause_path"), F.lit(" "), F.trim("heading")).alias("h")).distinct()
    h = F.col("h")
    return rows.withColumn("kind", F.when(h.rlike(r"^[A-Z]\.[0-9]+(\.[0-9A-Za-z]+)* .+$"), "annex-sub").when(h.rlike(r"^[0-9]+(\.[0-9A-Za-z]+)* .+$"), "numeric").otherwise("none"))


@add("sca_26_token_fraction", "with q as (select query_id, list_distinct(list_filter(regexp_extract_all(lower(query_text), '[a-z0-9]+'), lambda x: length(x) >= 3)) as t from search_queries), h as (select distinct query_id, chunk_id, lower(coalesce(snippet, '')) as s from hit_out) select h.query_id, h.chunk_id, max(round(case when len(t) > 0 then len(list_filter(t, lambda x: contains(s, x)))::double / len(t) else 0.0 end, 6)) as fraction from h join q using (query_id) group by all")
def sca_26(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "search_queries", "query_id", "query_text").select("query_id", F.array_distinct(F.filter(X.tokens("query_text"), lambda t: F.length(t) >= 3)).alias("t"))
    h = table(spark, d, "hit_out", "query_id", "chunk_id", "snippet").distinct()
    return h.join(q, "query_id").groupBy("query_id", "chunk_id").agg(F.max(F.round(X.token_fraction(F.col("t"), "snippet"), 6)).alias("fraction"))


@add("sca_09_deliverable_tokens", "with t as (select spec_id, regexp_replace(spec_id, '[^0-9]', '', 'g') || case when length(spec_id) % 2 = 0 then '0112' else '' end as token from specs where spec_id like 'ETSI%'), d as (select spec_id, token, case when regexp_full_match(token, '[0-9]{6}([0-9]{2})*') then substr(token, 1, 3) || ' ' || substr(token, 4, 3) || case when length(token) >= 8 then '-' || substr(token, 7, 2)::int else '' end || case when length(token) >= 10 then '-' || substr(token, 9, 2)::int else '' end end as id from t) select spec_id, token, id, coalesce(substr(token, 1, 3)::int - 100 between 21 and 38 or substr(token, 1, 3)::int - 100 between 41 and 55, false) as republished from d")
def sca_09(spark: SparkSession, d: str) -> DataFrame:
    """Number tokens of deliverables (some given parts) and whether they republish a spec."""
    t = table(spark, d, "specs", "spec_id").where(F.col("spec_id").startswith("ETSI"))
    t = t.withColumn("token", F.concat(F.regexp_replace("spec_id", "[^0-9]", ""), F.when(F.length("spec_id") % 2 == 0, "0112").otherwise("")))
    out = t.withColumn("id", X.deliverable_of_token("token"))
    return out.withColumn("republished", X.republished("id"))
