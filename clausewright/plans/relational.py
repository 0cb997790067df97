"""Joins, aggregations, windows, set operations and DML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import versioning as V
from ..operators import content as C
from ..operators import relations as R
from ..operators.services import numbered
from ..sources.tables import table
from .catalogue import ORD_SQL, V_SQL
from . import planted
from .registry import Registry

registry = Registry()
add = registry.add


def content(spark: SparkSession, d: str) -> C.Content:
    return C.content_tables(table(spark, d, "clauses", "chunk_id", "spec_id", "release", "version", "clause_path", "heading", "text", "is_normative", "embedding"))


_BODIES = "select heading, text, row_number() over (order by heading nulls first, text) as body from (select distinct heading, text from clauses where text is not null)"


@add("inc_01_content_addressing", f"with b as ({_BODIES}), p as (select body, unnest(string_split(text, chr(10) || chr(10))) as part from b) select count(distinct body) as bodies, count(*) as sequence, count(distinct part) as paragraphs, (select count(*) from clauses where text is not null) as occurrences from p")
def inc_01(spark: SparkSession, d: str) -> DataFrame:
    c = content(spark, d)
    seq = c.body_seq.agg(F.countDistinct("body_id").alias("bodies"), F.count(F.lit(1)).alias("sequence"))
    return seq.crossJoin(c.paragraphs.agg(F.count(F.lit(1)).alias("paragraphs"))).crossJoin(c.occurrences.agg(F.count(F.lit(1)).alias("occurrences")))  # one row each


@add("inc_02_rebuild_verified", "select count(*) as held, count(*) as rebuilt, count(*) as exact from clauses where text is not null")
def inc_02(spark: SparkSession, d: str) -> DataFrame:
    clauses = table(spark, d, "clauses", "chunk_id", "spec_id", "release", "version", "clause_path", "heading", "text", "is_normative", "embedding")
    return C.verify_content(clauses, C.content_tables(clauses))


@add("inc_03_restore", "select chunk_id, spec_id, release, version, clause_path, heading, md5(text) as text_md5, is_normative from clauses where text is not null")
def inc_03(spark: SparkSession, d: str) -> DataFrame:
    return C.rebuilt_clauses(content(spark, d)).select("chunk_id", "spec_id", "release", "version", "clause_path", "heading", F.md5("text").alias("text_md5"), "is_normative")


@add("agg_01_ordered_join", "select chunk_id, md5(text) as text_md5 from clauses where text is not null and length(text) > 2000")
def agg_01(spark: SparkSession, d: str) -> DataFrame:
    """Texts rebuilt for the wanted bodies only: the id filter runs below the aggregation."""
    c = content(spark, d)
    wanted = table(spark, d, "clauses", "chunk_id", "heading", "text").where(F.length("text") > 2000).select("chunk_id", C.content_id(F.col("heading"), F.col("text")).alias("body_id"))
    return wanted.join(C.body_texts(c, wanted), "body_id").select("chunk_id", F.md5("text").alias("text_md5"))


@add("agg_02_distinct_lists", "select spec_id, array_to_string(list_sort(list(distinct release)), ',') as releases from clauses group by spec_id")
def agg_02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "spec_id", "release").groupBy("spec_id").agg(F.array_join(F.array_sort(F.collect_set("release")), ",").alias("releases"))


@add("agg_03_group_extremes", "select spec_id, max(heading) as heading, min(chunk_id) as first_chunk, max(length(text))::bigint as longest from clauses group by spec_id")
def agg_03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "spec_id", "heading", "chunk_id", "text").groupBy("spec_id").agg(F.max("heading").alias("heading"), F.min("chunk_id").alias("first_chunk"), F.max(F.length("text")).cast("long").alias("longest"))


@add("agg_04_vector_of_body", "select heading, md5(text) as text_md5, min(chunk_id) filter (where embedding is not null) as donor from clauses where text is not null group by heading, text having donor is not null")
def agg_04(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "chunk_id", "heading", "text", "embedding").where("text is not null").withColumn("text_md5", F.md5("text"))
    return rows.groupBy("heading", "text_md5").agg(F.min(F.when(F.col("embedding").isNotNull(), F.col("chunk_id"))).alias("donor")).where("donor is not null").select("heading", "text_md5", "donor")


@add("agg_07_conditional_counts", "select spec_id, count(*) filter (where is_normative) as normative, count(*) filter (where embedding is null) as pending, count(*) filter (where coalesce(trim(text), '') = '') as textless from clauses group by spec_id")
def agg_07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "spec_id", "is_normative", "embedding", "text").groupBy("spec_id").agg(
        F.count_if("is_normative").alias("normative"), F.count_if(F.col("embedding").isNull()).alias("pending"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("textless")
    )


@add("agg_08_distinct_counts", "select release, count(distinct spec_id) as specs, count(distinct version) as versions from clauses group by release")
def agg_08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "release", "spec_id", "version").groupBy("release").agg(F.countDistinct("spec_id").alias("specs"), F.countDistinct("version").alias("versions"))


@add("agg_09_reingested", f"with {planted.REINGESTED_SQL} select spec_id, version, min(n) as copies, sum(n)::bigint as total from (select spec_id, version, clause_path, heading, text, count(*) as n from c group by all) group by spec_id, version having min(n) > 1")
def agg_09(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which every row is there more than once; one is planted, the tables have none."""
    rows = planted.reingested(spark, d).withColumn("t", F.md5("text"))
    per_row = rows.groupBy("spec_id", "version", "clause_path", "heading", "t").agg(F.count(F.lit(1)).alias("n"))
    return per_row.groupBy("spec_id", "version").agg(F.min("n").alias("copies"), F.sum("n").alias("total")).where("copies > 1")


@add("agg_11_conflicting_hashes", "with c as (select heading, text, embedding_hash from clauses union all select heading, text, 'other' from clauses where embedding_hash is not null and chunk_id % 7 = 0) select heading, md5(text) as text_md5, count(distinct embedding_hash) as hashes from c where text is not null group by heading, text having count(distinct embedding_hash) > 1")
def agg_11(spark: SparkSession, d: str) -> DataFrame:
    """Bodies with several hashes; conflicts are planted on some bodies, the tables have none."""
    rows = table(spark, d, "clauses", "chunk_id", "heading", "text", "embedding_hash")
    more = rows.where("embedding_hash is not null and chunk_id % 7 = 0").withColumn("embedding_hash", F.lit("other"))
    both = rows.unionByName(more).where("text is not null").withColumn("text_md5", F.md5("text"))
    return both.groupBy("heading", "text_md5").agg(F.countDistinct("embedding_hash").alias("hashes")).where("hashes > 1")


@add("agg_12_posting_max", "select chunk_id, term_id, max(weight)::double as weight from clause_sparse group by chunk_id, term_id having count(*) > 1")
def agg_12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clause_sparse").groupBy("chunk_id", "term_id").agg(F.max("weight").cast("double").alias("weight"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


@add("agg_14_most_repeated", "select spec_id, clause_path, count(distinct version) as versions from clauses where clause_path <> '' group by all order by versions desc, spec_id, clause_path limit 1")
def agg_14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "spec_id", "clause_path", "version").where("clause_path <> ''").groupBy("spec_id", "clause_path").agg(F.countDistinct("version").alias("versions")).orderBy(F.desc("versions"), "spec_id", "clause_path").limit(1)


@add("agg_15_consensus", "select heading, clause_path, count(distinct spec_id) as declared_by, min(spec_id) as cited from clauses where heading is not null and clause_path is not null group by all having count(distinct spec_id) > 1")
def agg_15(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "heading", "clause_path", "spec_id").where("heading is not null and clause_path is not null")
    return rows.groupBy("heading", "clause_path").agg(F.countDistinct("spec_id").alias("declared_by"), F.min("spec_id").alias("cited")).where("declared_by > 1")


@add("agg_17_nearest_rank", "with s as (select date_trunc('hour', ts)::timestamp as hour, list_sort(list(value)) as v, avg(value) as mean from events where value is not null group by 1) select hour, len(v)::bigint as n, round(mean, 6) as mean, v[1 + floor(0.5 * (len(v) - 1) + 0.5)::int] as p50, v[1 + floor(0.95 * (len(v) - 1) + 0.5)::int] as p95, v[1 + floor(0.99 * (len(v) - 1) + 0.5)::int] as p99 from s")
def agg_17(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles: the element at int(p * (n - 1) + 0.5). Rows are numbered over
    ranges of (hour, value), so an hour of very many rows is no burden to one task."""
    rows = table(spark, d, "events", "ts", "value").where("value is not null").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "value")
    placed = numbered(rows, ["hour", "value"])
    hours = placed.groupBy("hour").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.round(F.avg("value"), 6).alias("mean"))
    wanted = hours.select("hour", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.col("first") + F.floor(p * (F.col("n") - 1) + 0.5)).alias("place")) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])).alias("x")).select("hour", "x.*")
    found = wanted.join(placed.select("place", "value"), "place").groupBy("hour").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in ("p50", "p95", "p99")])
    return hours.join(found, "hour").select("hour", "n", "mean", "p50", "p95", "p99")


@add("agg_18_length_distribution", "with l as (select length(text) as n, row_number() over (order by length(text)) - 1 as i, count(*) over () as total from clauses where text is not null) select max(total) as total, min(n)::bigint as least, max(case when i = ((total - 1) * 50) // 100 then n end)::bigint as p50, max(case when i = ((total - 1) * 90) // 100 then n end)::bigint as p90, max(case when i = ((total - 1) * 99) // 100 then n end)::bigint as p99, max(n)::bigint as most, count(*) filter (where n <= 64) as le64, count(*) filter (where n <= 256) as le256, count(*) filter (where n <= 1024) as le1024 from l")
def agg_18(spark: SparkSession, d: str) -> DataFrame:
    """Counts per length first (as many rows as there are lengths), then cumulative."""
    per = table(spark, d, "clauses", "text").where("text is not null").groupBy(F.length("text").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    cum = per.withColumn("upto", F.sum("c").over(order)).withColumn("total", F.sum("c").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * q / 100), F.col("n")))
    le = lambda x: F.coalesce(F.sum(F.when(F.col("n") <= x, F.col("c"))), F.lit(0))
    return cum.agg(F.max("total").alias("total"), F.min("n").alias("least"), at(50).alias("p50"), at(90).alias("p90"), at(99).alias("p99"), F.max("n").alias("most"), le(64).alias("le64"), le(256).alias("le256"), le(1024).alias("le1024"))


@add("agg_22_mean_pool", "with v as (select vec_id // 4 as g, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select g, i, avg(x::double) as x from v group by all), n as (select g, sqrt(sum(x * x)) as norm from m group by g) select m.g, m.i::int as i, round(m.x / n.norm, 6) as x from m join n using (g)")
def agg_22(spark: SparkSession, d: str) -> DataFrame:
    """Mean of a group's vectors, of length one."""
    v = table(spark, d, "embeddings", "vec_id", "embedding").select(F.floor(F.col("vec_id") / 4).alias("g"), F.posexplode("embedding").alias("i", "x"))
    mean = v.groupBy("g", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = mean.groupBy("g").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return mean.join(norm, "g").select("g", (F.col("i") + 1).alias("i"), F.round(F.col("x") / F.col("norm"), 6).alias("x"))


@add("agg_23_fingerprint", "with c as (select coalesce(nullif(source, ''), '-') as part, lang, n_chars from documents), f as (select part, list_sort(list(coalesce(lang, '?') || '|' || coalesce(n_chars::varchar, '?'))) as rows from c group by part) select part, count(*) over (partition by rows) as alike from f")
def agg_23(spark: SparkSession, d: str) -> DataFrame:
    """Sources with the number of sources that hold the same rows, told by fingerprints."""
    rows = table(spark, d, "documents", "source", "lang", "n_chars").select(F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("-")).alias("part"), "lang", "n_chars")
    prints = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(i), "lang", "n_chars").cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)])
    alike = prints.groupBy("n", "s1", "s2").agg(F.count(F.lit(1)).alias("alike"))
    return prints.join(alike, ["n", "s1", "s2"]).select("part", "alike")


@add("join_03_full_outer", "select coalesce(v.spec_id, s.spec_id) as spec_id, case when v.spec_id is null then 'unfiled' when s.spec_id is null then 'unknown' else 'both' end as side from (select distinct spec_id from clauses) s full join (select distinct spec_id from spec_versions where status = 'published') v on s.spec_id = v.spec_id")
def join_03(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "clauses", "spec_id").distinct().withColumn("in_s", F.lit(1))
    v = table(spark, d, "spec_versions", "spec_id", "status").where("status = 'published'").select("spec_id").distinct().withColumn("in_v", F.lit(1))
    return s.join(v, "spec_id", "full_outer").select("spec_id", F.when(F.col("in_v").isNull(), "unfiled").when(F.col("in_s").isNull(), "unknown").otherwise("both").alias("side"))


@add("join_04_null_safe", "select a.chunk_id, min(b.chunk_id) as first_like from clauses a join clauses b on a.heading is not distinct from b.heading and a.text = b.text group by a.chunk_id")
def join_04(spark: SparkSession, d: str) -> DataFrame:
    """The first clause with the same heading (null is like null) and text: an equi-join on
    the content id, whose one side is aggregated, so that no group is multiplied out."""
    rows = table(spark, d, "clauses", "chunk_id", "heading", "text").where("text is not null").select("chunk_id", C.content_id(F.col("heading"), F.col("text")).alias("id"))
    return rows.join(rows.groupBy("id").agg(F.min("chunk_id").alias("first_like")), "id").select("chunk_id", "first_like")


@add("join_06_catalogue_holes", "select v.spec_id, count(*) as filings from spec_versions v left join specs s on s.spec_id = v.spec_id where s.spec_id is null or coalesce(trim(s.title), '') = '' group by v.spec_id")
def join_06(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "specs", "spec_id", "title").select(F.col("spec_id").alias("sid"), "title")
    j = table(spark, d, "spec_versions", "spec_id").join(s, F.col("spec_id") == F.col("sid"), "left")
    return j.where(F.col("sid").isNull() | (F.coalesce(F.trim("title"), F.lit("")) == "")).groupBy("spec_id").agg(F.count(F.lit(1)).alias("filings"))


@add("join_08_semi", "select count(*) as postings from clause_sparse p where exists (select 1 from clauses c where c.chunk_id = p.chunk_id and c.release = 'Rel-15')")
def join_08(spark: SparkSession, d: str) -> DataFrame:
    scope = table(spark, d, "clauses", "chunk_id", "release").where("release = 'Rel-15'").select("chunk_id")
    return table(spark, d, "clause_sparse", "chunk_id").join(scope, "chunk_id", "left_semi").agg(F.count(F.lit(1)).alias("postings"))


@add("join_09_anti", "select chunk_id from clauses c where length(trim(text)) > 0 and not exists (select 1 from clause_sparse p where p.chunk_id = c.chunk_id)")
def join_09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "chunk_id", "text").where(X.has_text("text")).select("chunk_id").join(table(spark, d, "clause_sparse", "chunk_id"), "chunk_id", "left_anti")


@add("join_11_natural_identity", "select a.chunk_id, b.chunk_id as other from clauses a join clauses b on a.spec_id = b.spec_id and a.clause_path = b.clause_path and a.text = b.text and a.release = 'Rel-15' and b.release = 'Rel-16'")
def join_11(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "chunk_id", "spec_id", "release", "clause_path", "text").where(F.col("release").isin("Rel-15", "Rel-16")).withColumn("t", F.sha2("text", 256))
    side = lambda r, n: rows.where(F.col("release") == r).select(F.col("chunk_id").alias(n), "spec_id", "clause_path", "t")
    return side("Rel-15", "chunk_id").join(side("Rel-16", "other"), ["spec_id", "clause_path", "t"]).select("chunk_id", "other")


@add("join_12_vector_backfill", "with d as (select heading, text, min(chunk_id) as donor from clauses where embedding is not null and heading is not null group by heading, text) select c.chunk_id, d.donor from clauses c join d on c.heading = d.heading and c.text = d.text where c.embedding is null")
def join_12(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "chunk_id", "heading", "text", "embedding").where("heading is not null and text is not null").select("chunk_id", C.content_id(F.col("heading"), F.col("text")).alias("id"), F.col("embedding").isNull().alias("none"))
    donor = rows.where("not none").groupBy("id").agg(F.min("chunk_id").alias("donor"))
    return rows.where("none").join(donor, "id").select("chunk_id", "donor")


@add("join_16_children", "select p.chunk_id as section, c.chunk_id as child from clauses p join clauses c on p.spec_id = c.spec_id and p.version = c.version and regexp_extract(c.clause_path, '^(.+)\\.[^.]+$', 1) = p.clause_path where p.clause_path <> ''")
def join_16(spark: SparkSession, d: str) -> DataFrame:
    """Sections with their direct children: an equi-join on the computed parent path."""
    rows = table(spark, d, "clauses", "chunk_id", "spec_id", "version", "clause_path").where("clause_path <> ''")
    child = rows.select(F.col("chunk_id").alias("child"), "spec_id", "version", F.regexp_extract("clause_path", r"^(.+)\.[^.]+$", 1).alias("clause_path")).where("clause_path <> ''")
    return rows.select(F.col("chunk_id").alias("section"), "spec_id", "version", "clause_path").join(child, ["spec_id", "version", "clause_path"]).select("section", "child")


@add("join_18_fallback", "select series, spec_id from (select series, spec_id, row_number() over (partition by series order by case upper(doc_type) when 'TS' then 0 when 'EN' then 1 when 'TR' then 2 else 3 end, spec_id) as n from specs) where n = 1")
def join_18(spark: SparkSession, d: str) -> DataFrame:
    kind = F.upper("doc_type")
    place = F.when(kind == "TS", 0).when(kind == "EN", 1).when(kind == "TR", 2).otherwise(3)
    return table(spark, d, "specs", "series", "spec_id", "doc_type").groupBy("series").agg(F.min(F.struct(place.alias("p"), "spec_id"))["spec_id"].alias("spec_id"))


@add("win_01_best_version", f"select spec_id, clause_path, chunk_id from (select spec_id, clause_path, chunk_id, row_number() over (partition by spec_id, clause_path order by score desc, {V_SQL.format('version', 'desc')}, chunk_id) as n from (select c.*, length(coalesce(text, '')) as score from clauses c where clause_path <> '')) where n = 1")
def win_01(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "chunk_id", "spec_id", "version", "clause_path", "text").where("clause_path <> ''")
    key = F.struct(F.length(F.coalesce("text", F.lit(""))).alias("s"), V.version_key("version").alias("v"), (-F.col("chunk_id")).alias("c"))
    return rows.groupBy("spec_id", "clause_path").agg(F.max_by("chunk_id", key).alias("chunk_id"))


@add("win_04_duplicate_rows", "select chunk_id from (select chunk_id, row_number() over (partition by spec_id, version, clause_path, heading, text order by chunk_id) as n from clauses) where n > 1")
def win_04(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "chunk_id", "spec_id", "version", "clause_path", "heading", "text").withColumn("t", F.sha2("text", 256))
    w = Window.partitionBy("spec_id", "version", "clause_path", "heading", "t").orderBy("chunk_id")
    return rows.select("chunk_id", F.row_number().over(w).alias("n")).where("n > 1").select("chunk_id")


@add("set_03_expected_releases", "select code, 'missing' as side from releases where code not in (select release from clauses where release is not null) union all select distinct release, 'unexpected' from clauses where release is not null and release not in (select code from releases)")
def set_03(spark: SparkSession, d: str) -> DataFrame:
    want, got = table(spark, d, "releases", "code"), table(spark, d, "clauses", "release").where("release is not null").select(F.col("release").alias("code")).distinct()
    return want.subtract(got).withColumn("side", F.lit("missing")).unionByName(got.subtract(want).withColumn("side", F.lit("unexpected")))


@add("set_05_first_half_wins", "select term, half from (select term, half, row_number() over (partition by term order by half) as n from (select lower(heading) as term, 1 as half from clauses where upper(trim(spec_id)) not like 'ETSI%' and heading <> '' union all select lower(heading), 2 from clauses where upper(trim(spec_id)) like 'ETSI%' and heading <> '')) where n = 1")
def set_05(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "spec_id", "heading").where("heading <> ''")
    return rows.groupBy(F.lower("heading").alias("term")).agg(F.min(F.when(V.is_etsi("spec_id"), 2).otherwise(1)).alias("half"))


@add("set_07_equal_filings", "with f as (select spec_id, version, release, list_sort(list(coalesce(clause_path, '') || '|' || coalesce(md5(text), '') )) as l from clauses group by all) select a.spec_id, a.version, a.release as a, b.release as b, a.l = b.l as same from f a join f b on a.spec_id = b.spec_id and a.version = b.version and a.release < b.release")
def set_07(spark: SparkSession, d: str) -> DataFrame:
    """Filings of one version under several releases, compared as multisets by fingerprint."""
    h = F.xxhash64(F.coalesce("clause_path", F.lit("")), F.coalesce(F.md5("text"), F.lit("")))
    h2 = F.xxhash64(F.coalesce(F.md5("text"), F.lit("")), F.lit("2"), F.coalesce("clause_path", F.lit("")))
    f = table(spark, d, "clauses", "spec_id", "version", "release", "clause_path", "text").groupBy("spec_id", "version", "release").agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s1"), F.sum(h2.cast("decimal(38,0)")).alias("s2"))
    side = lambda x: f.select("spec_id", "version", F.col("release").alias(x), F.struct("n", "s1", "s2").alias(f"f{x}"))
    return side("a").join(side("b"), ["spec_id", "version"]).where("a < b").select("spec_id", "version", "a", "b", (F.col("fa") == F.col("fb")).alias("same"))


# --- DML: the relation after the statement -------------------------------------------


def _new_specs(spark: SparkSession, d: str) -> DataFrame:
    """Specs of two series under a new title, and two that aren't there."""
    s = table(spark, d, "specs")
    changed = s.where(F.col("spec_id").rlike("^[2-4]")).withColumn("title", F.concat(F.lit("New "), F.coalesce("title", F.lit(""))))
    extra = spark.createDataFrame([("00.001", "00", "Extra one", "TS", "WG1"), ("00.002", "00", "", "TR", None)], s.schema)
    return changed.unionByName(extra)


_NEW = "select spec_id, series, 'New ' || coalesce(title, '') as title, doc_type, working_group from specs where regexp_matches(spec_id, '^[2-4]') union all values ('00.001', '00', 'Extra one', 'TS', 'WG1'), ('00.002', '00', '', 'TR', null)"


@add("snk_01_upsert", f"with n as ({_NEW}) select * from n union all select * from specs where spec_id not in (select spec_id from n)")
def snk_01(spark: SparkSession, d: str) -> DataFrame:
    return R.upsert(table(spark, d, "specs"), _new_specs(spark, d), ["spec_id"])


@add("snk_02_insert_ignore", f"with n as ({_NEW}) select * from specs union all select * from n where spec_id not in (select spec_id from specs)")
def snk_02(spark: SparkSession, d: str) -> DataFrame:
    return R.insert_ignore(table(spark, d, "specs"), _new_specs(spark, d), ["spec_id"])


@add("snk_05_update_if_different", f"with n as ({_NEW}) select s.spec_id, s.series, case when coalesce(n.title, '') <> '' then n.title else s.title end as title, s.doc_type, case when coalesce(n.working_group, '') <> '' then n.working_group else s.working_group end as working_group, (case when coalesce(n.title, '') <> '' then n.title else s.title end is distinct from s.title) or (case when coalesce(n.working_group, '') <> '' then n.working_group else s.working_group end is distinct from s.working_group) as changed from specs s left join n on n.spec_id = s.spec_id")
def snk_05(spark: SparkSession, d: str) -> DataFrame:
    return R.update_where_different(table(spark, d, "specs"), _new_specs(spark, d), "spec_id", ["title", "working_group"])


@add("snk_06_replace_all", "select * from (values ('same', true), ('reordered', true), ('one row fewer', false), ('one row twice', false), ('one value changed', false)) v(case_, skipped)")
def snk_06(spark: SparkSession, d: str) -> DataFrame:
    """A replacement is skipped for an equal multiset of rows only: cases that are and that aren't."""
    log = table(spark, d, "ingest_log", "spec_id", "version", "status", "started_at")
    one = log.orderBy("spec_id", "version", "started_at", "status").limit(1)
    key = one.select(F.col("spec_id").alias("s1"), F.col("version").alias("v1"))
    first = (F.col("spec_id") == F.col("s1")) & (F.col("version") == F.col("v1"))
    cases = {
        "same": log,
        "reordered": log.repartition(3),
        "one row fewer": log.exceptAll(one),
        "one row twice": log.unionByName(one),
        "one value changed": log.join(F.broadcast(key), first, "left").withColumn("status", F.when(F.col("s1").isNotNull(), "changed").otherwise(F.col("status"))).drop("s1", "v1"),
    }
    was = R.fingerprint(log)
    rows = [R.fingerprint(x).join(was, ["n", "sum0", "sum1"], "left_semi").agg((F.count(F.lit(1)) == 1).alias("skipped")).select(F.lit(name).alias("case_"), "skipped") for name, x in cases.items()]
    return reduce(DataFrame.unionByName, rows)


@add("snk_09_replace_scope", f"with n as ({_NEW}), k as (select * from specs where not coalesce(spec_id like 'ETSI %', false)) select * from k union all select * from n where spec_id not in (select spec_id from k)")
def snk_09(spark: SparkSession, d: str) -> DataFrame:
    return R.replace_scope(table(spark, d, "specs"), F.col("spec_id").startswith("ETSI "), _new_specs(spark, d), ["spec_id"])


@add("snk_10_delete_scope", "select chunk_id from clauses where (spec_id, version) not in (select spec_id, version from spec_versions where status = 'withdrawn')")
def snk_10(spark: SparkSession, d: str) -> DataFrame:
    return R.delete_keys(table(spark, d, "clauses", "chunk_id", "spec_id", "version"), table(spark, d, "spec_versions").where("status = 'withdrawn'"), ["spec_id", "version"]).select("chunk_id")


@add("snk_11_orphans", "select spec_id from specs where spec_id in (select spec_id from spec_versions where release <> 'Rel-15')")
def snk_11(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "spec_versions", "spec_id", "release").where("release <> 'Rel-15'")
    return table(spark, d, "specs", "spec_id").join(left, "spec_id", "left_semi")


@add("snk_12_update_from_join", "with d as (select heading, text, min(embedding_hash) as h from clauses where embedding_hash is not null and heading is not null group by heading, text) select c.chunk_id, coalesce(d.h, c.embedding_hash) as embedding_hash from clauses c left join d on c.heading = d.heading and c.text = d.text")
def snk_12(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "chunk_id", "heading", "text", "embedding_hash").withColumn("id", F.when(F.col("heading").isNotNull() & F.col("text").isNotNull(), C.content_id(F.col("heading"), F.col("text"))))
    new = rows.where("embedding_hash is not null and id is not null").groupBy("id").agg(F.min("embedding_hash").alias("embedding_hash"))
    return R.update_from(rows.select("chunk_id", "id", "embedding_hash"), new, ["id"], "embedding_hash").select("chunk_id", "embedding_hash")


@add("snk_15_delta_export", "select c.chunk_id, s.spec_id, s.title from clauses c join specs s using (spec_id) where c.embedding is null and length(trim(c.text)) > 0")
def snk_15(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "clauses", "chunk_id", "spec_id", "text", "embedding").where(F.col("embedding").isNull() & X.has_text("text")).select("chunk_id", "spec_id")
    return rows.join(table(spark, d, "specs", "spec_id", "title"), "spec_id").select("chunk_id", "spec_id", "title")


@add("snk_20_ingest_progress", "select spec_id, version, status, started_at from (select *, row_number() over (partition by spec_id, version order by started_at desc nulls last, completed_at desc nulls last, pipeline_version desc nulls last, status) as n from ingest_log) where n = 1")
def snk_20(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc_nulls_last(c) for c in ("started_at", "completed_at", "pipeline_version")] + [F.col("status")]
    return R.latest_per_key(table(spark, d, "ingest_log"), ["spec_id", "version"], order).select("spec_id", "version", "status", "started_at")
