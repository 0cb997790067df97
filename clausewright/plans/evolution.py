"""Lineage, incremental maintenance, glossary, validation and mining by expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import versioning as V
from ..operators import glossary as G
from ..operators import lineage as L
from ..operators import maintenance as M
from ..operators import validation as Y
from ..sources.tables import table
from .catalogue import ORD_SQL, V_SQL
from .registry import Registry

registry = Registry()
add = registry.add


def _rows(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "clauses", "chunk_id", "spec_id", "release", "version", "clause_path", *more)


_AXIS = "a as (select spec_id, case when count(distinct release) > 1 then 'release' when count(distinct version) > 1 then 'version' else 'release' end as axis from clauses group by spec_id)"
_POINTS = f"""{_AXIS},
pt as (select distinct c.spec_id, a.axis, case when a.axis = 'release' then c.release else c.version end as point from clauses c join a using (spec_id)),
p as (select *, row_number() over (partition by spec_id order by case when axis = 'release' then {ORD_SQL.format('point')} else coalesce(try_cast(split_part(point, '.', 1) as int), 0) end, case when axis = 'release' then 0 else coalesce(try_cast(split_part(point, '.', 2) as int), 0) end, case when axis = 'release' then 0 else coalesce(try_cast(split_part(point, '.', 3) as int), 0) end, point) as place, count(*) over (partition by spec_id) as newest from pt where point is not null),
o as (select c.*, p.point, p.place, p.newest from clauses c join p on p.spec_id = c.spec_id and p.point = case when p.axis = 'release' then c.release else c.version end)"""


@add("lin_01_axis", f"with {_AXIS} select spec_id, axis from a")
def lin_01(spark: SparkSession, d: str) -> DataFrame:
    return L.lineage_axis(table(spark, d, "clauses", "spec_id", "release", "version"))


@add("lin_02_availability", f"with {_POINTS} select spec_id, clause_path, max(heading) as heading, count(distinct point) as points from o where clause_path <> '' group by all")
def lin_02(spark: SparkSession, d: str) -> DataFrame:
    rows = L.on_axis(_rows(spark, d, "heading").where("clause_path <> ''"), L.axis_points(_rows(spark, d)))
    return rows.groupBy("spec_id", "clause_path").agg(F.max("heading").alias("heading"), F.countDistinct("point").alias("points"))


_PRESENCE = "array_to_string(list(point order by place), ',') as present_in, min_by(point, place) as introduced, max_by(point, place) as last_seen, max(place) < max(newest) as obsolete"


@add("lin_03_clause_lineage", f"with {_POINTS}, s as (select spec_id, clause_path, point, place, newest from o where clause_path <> '' group by all) select spec_id, clause_path, {_PRESENCE} from s group by spec_id, clause_path")
def lin_03(spark: SparkSession, d: str) -> DataFrame:
    return L.clause_lineage(_rows(spark, d, "heading")).select("spec_id", "clause_path", F.array_join("present_in", ",").alias("present_in"), "introduced", "last_seen", "obsolete")


@add("lin_04_paragraph_lineage", f"with {_POINTS}, x as (select spec_id, clause_path, point, place, newest, unnest(string_split(text, chr(10) || chr(10))) as part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 as ord from o where clause_path <> '' and text is not null), f as (select spec_id, clause_path, part, min(ord)::int as first_ord from x where part <> '' group by all), s as (select distinct spec_id, clause_path, part, point, place, newest from x where part <> '') select s.spec_id, s.clause_path, md5(s.part) as part_md5, {_PRESENCE}, any_value(f.first_ord) as first_ord from s join f using (spec_id, clause_path, part) group by s.spec_id, s.clause_path, s.part")
def lin_04(spark: SparkSession, d: str) -> DataFrame:
    return L.paragraph_lineage(_rows(spark, d, "text")).select("spec_id", "clause_path", F.md5("part").alias("part_md5"), F.array_join("present_in", ",").alias("present_in"), "introduced", "last_seen", "obsolete", "first_ord")


@add("lin_05_paragraph_delta", "with x as (select distinct spec_id, clause_path, release, unnest(string_split(text, chr(10) || chr(10))) as part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 as ord from clauses where clause_path <> '' and text is not null and release in ('Rel-15', 'Rel-16')), a as (select * from x where release = 'Rel-15'), b as (select * from x where release = 'Rel-16') select coalesce(a.spec_id, b.spec_id) as spec_id, coalesce(a.clause_path, b.clause_path) as clause_path, case when a.part is null then 'added' when b.part is null then 'removed' else 'kept' end as side, count(*) as n from a full join b on a.spec_id = b.spec_id and a.clause_path = b.clause_path and a.ord = b.ord and a.part = b.part group by all")
def lin_05(spark: SparkSession, d: str) -> DataFrame:
    delta = L.paragraph_delta(_rows(spark, d, "text"), F.col("release") == "Rel-15", F.col("release") == "Rel-16")
    return delta.groupBy("spec_id", "clause_path", "side").agg(F.count(F.lit(1)).alias("n"))


@add("lin_06_release_view", f"with {_POINTS}, s as (select distinct spec_id, clause_path, point, place from o where clause_path <> ''), b as (select spec_id, place as base from p where axis = 'release' and point = 'Rel-15'), g as (select s.spec_id, s.clause_path, bool_or(place = base) as in_baseline, bool_or(place = base) and not bool_or(place = base - 1) as new_in_baseline, case when not bool_or(place = base) then min_by(point, place) filter (where place > base) end as added_later, not bool_or(place = base) and count(*) filter (where place > base) = 0 as removed_before from s join b using (spec_id) group by all) select * from g")
def lin_06(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, "heading")
    return L.release_view(L.clause_lineage(rows), L.axis_points(rows), "Rel-15")


@add("lin_08_one_filing", f"with f as (select spec_id, version, release, list_sort(list(coalesce(clause_path, '') || '|' || coalesce(md5(text), ''))) as l from clauses group by all), k as (select spec_id, version, count(distinct l) as kinds, max_by(release, struct_pack(o := case when case when lower(trim(release)) = 'rel-99' then 3 else try_cast(nullif(regexp_extract(lower(trim(release)), '^(rel-)?([0-9]+)$', 2), '') as int) end = coalesce(try_cast(split_part(version, '.', 1) as int), 0) then 1 else 0 end, r := {ORD_SQL.format('release')}, l := release)) as kept from f group by all) select c.chunk_id, c.release from clauses c join k using (spec_id, version) where kinds > 1 or c.release is not distinct from kept")
def lin_08(spark: SparkSession, d: str) -> DataFrame:
    return L.one_filing(_rows(spark, d, "text")).select("chunk_id", "release")


_MAJOR = "case when lower(trim({0})) = 'rel-99' then 3 else try_cast(nullif(regexp_extract(lower(trim({0})), '^(rel-)?([0-9]+)$', 2), '') as int) end"


@add("lin_10_refile_plan", f"with v as (select distinct spec_id, release, version, coalesce(try_cast(split_part(version, '.', 1) as int), 0) as major from spec_versions), c as (select *, case when major = 3 then 'Rel-99' else 'Rel-' || major end as target from v where major >= 3 and {_MAJOR.format('release')} <> major), j as (select c.spec_id, c.release, c.version, c.target, case when not exists (select 1 from v h where h.spec_id = c.spec_id and h.release = c.target) then 'no own release' when exists (select 1 from v h where h.spec_id = c.spec_id and h.release = c.target and h.version = c.version) then 'copy there' when not exists (select 1 from clauses t where t.spec_id = c.spec_id and t.release = c.release and t.version = c.version) then 'no text' else 'move' end as verdict from c) select spec_id, release, version, target, case when verdict = 'move' and row_number() over (partition by spec_id, target, version, verdict order by release) > 1 then 'claimed' else verdict end as verdict from j")
def lin_10(spark: SparkSession, d: str) -> DataFrame:
    return L.refile_plan(table(spark, d, "spec_versions", "spec_id", "release", "version"), table(spark, d, "clauses", "spec_id", "release", "version"))


@add("lin_12_coverage", f"with h as (select spec_id, max(struct_pack(a := coalesce(try_cast(split_part(version, '.', 1) as int), 0), b := coalesce(try_cast(split_part(version, '.', 2) as int), 0), c := coalesce(try_cast(split_part(version, '.', 3) as int), 0))) as held from clauses group by spec_id), r as (select spec_id, max(struct_pack(a := coalesce(try_cast(split_part(version, '.', 1) as int), 0), b := coalesce(try_cast(split_part(version, '.', 2) as int), 0), c := coalesce(try_cast(split_part(version, '.', 3) as int), 0))) as logged from ingest_log where status = 'done' group by spec_id) select h.spec_id, case when r.logged is null then 'none' when r.logged < h.held then 'behind' when r.logged > h.held then 'ahead' else 'level' end as coverage from h left join r using (spec_id)")
def lin_12(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "clauses", "spec_id", "version").groupBy("spec_id").agg(F.max(V.version_key("version")).alias("h"))
    log = table(spark, d, "ingest_log", "spec_id", "version", "status").where("status = 'done'").groupBy("spec_id").agg(F.max(V.version_key("version")).alias("r"))
    state = F.when(F.col("r").isNull(), "none").when(F.col("r") < F.col("h"), "behind").when(F.col("r") > F.col("h"), "ahead").otherwise("level")
    return held.join(log, "spec_id", "left").select("spec_id", state.alias("coverage"))


# Two states of the corpus: everything up to a chunk id is held, later rows are a shard.
_HELD, _SHARD = "chunk_id % 5 <> 0", "chunk_id % 3 = 0"
_VK = "struct_pack(a := coalesce(try_cast(split_part(version, '.', 1) as int), 0), b := coalesce(try_cast(split_part(version, '.', 2) as int), 0), c := coalesce(try_cast(split_part(version, '.', 3) as int), 0))"
_BUCKETS = f"b as (select spec_id, release, max({_VK}) as bv, count(*) filter (where length(trim(text)) > 0) as bn from clauses where {_HELD} group by all), s as (select spec_id, release, max({_VK}) as sv, count(*) filter (where length(trim(text)) > 0) as sn from clauses where {_SHARD} group by all), w as (select s.spec_id, s.release, case when bv is null then 'new' when sv <> bv then 'version' when bn = 0 and sn > 0 then 'textless' when sn > 0 and sn <> bn then 'rows' end as why from s left join b on b.spec_id = s.spec_id and b.release = s.release)"


@add("inc_06_changed_buckets", f"with {_BUCKETS} select * from w where why is not null")
def inc_06(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, "text")
    return M.changed_buckets(rows.where(_HELD), rows.where(_SHARD))


@add("inc_07_fold_shard", f"with {_BUCKETS}, c as (select * from w where why is not null), stay as (select chunk_id, embedding_hash from clauses x where {_HELD} and not exists (select 1 from c where c.spec_id = x.spec_id and c.release = x.release)), gone as (select heading, text, min_by(embedding_hash, chunk_id) as old from clauses x where {_HELD} and embedding_hash is not null and exists (select 1 from c where c.spec_id = x.spec_id and c.release = x.release) group by heading, text), fresh as (select x.chunk_id, coalesce(x.embedding_hash, g.old) as embedding_hash from clauses x left join gone g on g.heading = x.heading and g.text = x.text where {_SHARD} and exists (select 1 from c where c.spec_id = x.spec_id and c.release = x.release)) select * from stay union all select * from fresh")
def inc_07(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, "heading", "text", "embedding_hash")
    base, shard = rows.where(_HELD), rows.where(_SHARD)
    return M.fold_shard(base, shard, M.changed_buckets(base, shard).select("spec_id", "release"), ["heading", "text"], "embedding_hash").select("chunk_id", "embedding_hash")


@add("inc_13_worklist", f"select chunk_id, substr(sha256(coalesce(heading, '') || chr(10) || coalesce(text, '') || '|model-a'), 1, 16) as hash, cast({ORD_SQL.format('release')} as int) as ordinal from clauses where length(trim(text)) > 0 and {ORD_SQL.format('release')} >= 10 and not (chunk_id % 2 = 0)")
def inc_13(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, "heading", "text")
    done = rows.where("chunk_id % 2 = 0").select("chunk_id", X.content_hash("heading", "text", "model-a").alias("hash"))
    return M.worklist(rows, done, "model-a", 10)


@add("inc_12_distinct_inputs", "select count(*) as rows, count(distinct md5(coalesce(heading, '') || chr(10) || text)) as inputs from clauses where length(trim(text)) > 0")
def inc_12(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, "heading", "text").where(X.has_text("text"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.md5(F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), F.col("text")))).alias("inputs"))


@add("inc_14_upstream_delta", f"with s as (select spec_id, release, version from (select *, row_number() over (partition by spec_id, release order by {V_SQL.format('version', 'desc')}) as n from spec_versions where {ORD_SQL.format('release')} >= 8) where n = 1), i as (select spec_id, release, version as held from (select distinct spec_id, release, version, row_number() over (partition by spec_id, release order by {V_SQL.format('version', 'desc')}) as n from (select distinct spec_id, release, version from clauses)) where n = 1) select s.spec_id, s.release, s.version, i.held from s left join i on i.spec_id = s.spec_id and i.release = s.release where i.held is null or (coalesce(try_cast(split_part(s.version, '.', 1) as int), 0), coalesce(try_cast(split_part(s.version, '.', 2) as int), 0), coalesce(try_cast(split_part(s.version, '.', 3) as int), 0)) > (coalesce(try_cast(split_part(i.held, '.', 1) as int), 0), coalesce(try_cast(split_part(i.held, '.', 2) as int), 0), coalesce(try_cast(split_part(i.held, '.', 3) as int), 0))")
def inc_14(spark: SparkSession, d: str) -> DataFrame:
    return M.delta(table(spark, d, "spec_versions", "spec_id", "release", "version"), table(spark, d, "clauses", "spec_id", "release", "version"), 8).select("spec_id", "release", "version", "held")


@add("inc_17_anchor_compare", f"with h as (select spec_id, release, max({_VK}) as h from clauses group by all), w as (select spec_id, release, max({_VK}) as w from spec_versions group by all) select coalesce(h.spec_id, w.spec_id) as spec_id, coalesce(h.release, w.release) as release, case when h is null then 'missing' when w is null then 'extra' when h.h < w.w then 'behind' when h.h > w.w then 'ahead' else 'ok' end as state from h full join w on h.spec_id = w.spec_id and h.release = w.release")
def inc_17(spark: SparkSession, d: str) -> DataFrame:
    return M.compare_anchors(table(spark, d, "clauses", "spec_id", "release", "version"), table(spark, d, "spec_versions", "spec_id", "release", "version"))


@add("inc_18_claims", "select v.spec_id, v.version, case when c.n is null then 'overclaim' when c.n = 0 then 'noncontent' else 'indexed' end as state from (select distinct spec_id, version from spec_versions) v left join (select spec_id, version, count(*) filter (where length(trim(text)) > 0) as n from clauses group by all) c on c.spec_id = v.spec_id and c.version = v.version")
def inc_18(spark: SparkSession, d: str) -> DataFrame:
    return M.classify_claims(table(spark, d, "spec_versions", "spec_id", "version"), table(spark, d, "clauses", "spec_id", "version", "text"))


@add("inc_20_dated_changes", f"with v as (select spec_id, version, {_VK} as k, row_number() over w as n, lag(version) over w as previous, lag({_VK}) over w as pk from (select distinct spec_id, version from clauses) window w as (partition by spec_id order by {V_SQL.format('version', '')}, version)), u as (select distinct spec_id, {_VK} as k from spec_versions where (spec_id, version) not in (select spec_id, version from clauses)), f as (select c.spec_id, c.clause_path as item, min(v.n) as n from clauses c join v on v.spec_id = c.spec_id and v.version = c.version where c.clause_path <> '' group by all), d as (select f.spec_id, f.item, v.previous, v.version, case when v.previous is null then 'first version' when exists (select 1 from u where u.spec_id = v.spec_id and u.k > v.pk and u.k < v.k) then 'publication missing' end as declined from f join v on v.spec_id = f.spec_id and v.n = f.n) select spec_id, item, case when declined is null then previous end as from_version, case when declined is null then version end as to_version, declined from d")
def inc_20(spark: SparkSession, d: str) -> DataFrame:
    """Clauses dated to the version that has them first; a publication that isn't held leaves them undated."""
    rows = _rows(spark, d)
    return M.date_changes(rows.where("clause_path <> ''").select("spec_id", "version", F.col("clause_path").alias("item")), rows.select("spec_id", "version"), table(spark, d, "spec_versions", "spec_id", "version"))


@add("inc_21_repair", "select chunk_id from (select chunk_id, row_number() over (partition by spec_id, version, clause_path, heading, text order by chunk_id) as n from clauses) where n > 1")
def inc_21(spark: SparkSession, d: str) -> DataFrame:
    return M.repair_reingested(_rows(spark, d, "heading", "text"))


@add("set_04_reconciliation", "select spec_id, version from (select spec_id, version from spec_versions except select spec_id, version from clauses) x where not exists (select 1 from ingest_log l where l.spec_id = x.spec_id and l.version = x.version and l.status = 'failed')")
def set_04(spark: SparkSession, d: str) -> DataFrame:
    want = table(spark, d, "spec_versions", "spec_id", "version").distinct()
    excused = table(spark, d, "ingest_log", "spec_id", "version", "status").where("status = 'failed'")
    return want.join(table(spark, d, "clauses", "spec_id", "version"), ["spec_id", "version"], "left_anti").join(excused, ["spec_id", "version"], "left_anti")


# Glossary over the headings: term = first word, expansion = heading, domain = normative or not.
_TERMS = "t as (select split_part(heading, ' ', 1) as term, heading as expansion, case when is_normative then 'normative' else 'informative' end as domain, spec_id as doc from clauses where heading <> '')"


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "spec_id", "heading", "is_normative").where("heading <> ''").select(
        F.split_part("heading", F.lit(" "), F.lit(1)).alias("term"), F.col("heading").alias("expansion"), F.when(F.col("is_normative"), "normative").otherwise("informative").alias("domain"), F.col("spec_id").alias("doc")
    )


@add("sort_05_authority", f"with {_TERMS}, e as (select term, expansion, domain, min(doc) as source_series, count(distinct doc) as declared_by from t group by all) select term, expansion, domain, row_number() over (partition by lower(term) order by case when contains(coalesce(source_series, ''), '.') then 0 else 1 end, greatest(declared_by, 1) desc, domain, expansion, term) as place from e")
def sort_05(spark: SparkSession, d: str) -> DataFrame:
    e = _terms(spark, d).groupBy("term", "expansion", "domain").agg(F.min("doc").alias("source_series"), F.countDistinct("doc").alias("declared_by"))
    return G.authority_order(e).select("term", "expansion", "domain", F.col("place").cast("long").alias("place"))


@add("mine_12_consensus", f"with {_TERMS} select term, expansion, count(distinct doc) as declared_by, min(doc) as cited from t group by term, expansion")
def mine_12(spark: SparkSession, d: str) -> DataFrame:
    return G.consensus(_terms(spark, d))


@add("snk_08_replacement_plan", f"with {_TERMS}, e as (select term, expansion, domain, min(doc) as source_series from t where length(doc) % 2 = 0 group by all), b as (select term, expansion, domain, min(doc) as new_source from t where length(doc) > 6 group by all), g as (select distinct term, expansion, domain from t where domain = 'informative') select coalesce(e.term, b.term) as term, coalesce(e.expansion, b.expansion) as expansion, coalesce(e.domain, b.domain) as domain, case when e.source_series is null then 'written' when b.new_source is not null then case when b.new_source = e.source_series then 'kept' else 'written' end when e.source_series = '21' then case when g.term is null then 'retired' else 'kept' end when not regexp_matches(e.source_series, '^[0-9]{{2}}\\.[0-9]{{3}}(-[0-9]+)?$') then 'untouched' when g.term is not null then 'restored' else 'removed' end as action from e full join b on e.term = b.term and e.expansion = b.expansion and e.domain = b.domain left join g on g.term = coalesce(e.term, b.term) and g.expansion = coalesce(e.expansion, b.expansion) and g.domain = coalesce(e.domain, b.domain)")
def snk_08(spark: SparkSession, d: str) -> DataFrame:
    t = _terms(spark, d)
    held = t.where(F.length("doc") % 2 == 0).groupBy(*G.KEY).agg(F.min("doc").alias("source_series"))
    batch = t.where(F.length("doc") > 6).groupBy(*G.KEY).agg(F.min("doc").alias("source_series"))
    return G.plan_replacement(held, batch, t.where("domain = 'informative'")).select(*G.KEY, "action")


@add("val_01_contract", "with c as (select count(*) as n, count(distinct chunk_id) as ids, count(*) filter (where embedding is not null and len(embedding) <> 64) as bad, count(*) filter (where embedding is not null and embedding_hash is null) as nohash, count(*) filter (where length(trim(text)) > 0 and embedding is null) as pending from clauses), o as (select count(*) as n from (select distinct spec_id from clauses) where spec_id not in (select spec_id from specs)), l as (select count(*) as n from (select distinct release from spec_versions) where release not in (select code from releases)), f as (select count(*) as n from (select distinct spec_id, version from clauses) x where not exists (select 1 from spec_versions v where v.spec_id = x.spec_id and v.version = x.version)), u as (select count(*) as n from specs where coalesce(trim(title), '') = '') select 'min-clauses' as name, n >= 1 as passed, n::varchar as detail from c union all select 'unique-chunks', n = ids, (n - ids)::varchar from c union all select 'embedding-dim', bad = 0, bad::varchar from c union all select 'embedding-hash', nohash = 0, nohash::varchar from c union all select 'pending-zero', pending = 0, pending::varchar from c union all select 'specs-known', n = 0, n::varchar from o union all select 'releases-known', n = 0, n::varchar from l union all select 'versions-filed', n = 0, n::varchar from f union all select 'no-empty-title', n = 0, n::varchar from u")
def val_01(spark: SparkSession, d: str) -> DataFrame:
    return Y.contract(table(spark, d, "clauses"), table(spark, d, "specs"), table(spark, d, "spec_versions"), table(spark, d, "releases"), 64)


@add("val_04_pending_by_release", "select coalesce(release, '') as release, count(*) as pending from clauses where embedding is null and length(trim(text)) > 0 group by 1")
def val_04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "release", "text", "embedding").where(F.col("embedding").isNull() & X.has_text("text")).groupBy(F.coalesce("release", F.lit("")).alias("release")).agg(F.count(F.lit(1)).alias("pending"))


@add("val_10_mass_removal", "select (select count(*) from specs) as before, (select count(*) from specs where spec_id like 'ETSI%') as removed, greatest(53, (select count(*) from specs) // 100) as bound, (select count(*) from specs where spec_id like 'ETSI%') <= greatest(53, (select count(*) from specs) // 100) as passed")
def val_10(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "specs", "spec_id")
    return Y.mass_removal(s, s.where(~F.col("spec_id").startswith("ETSI")), ["spec_id"])


@add("mine_01_references", "with r as (select chunk_id, spec_id, unnest(regexp_extract_all(coalesce(heading, '') || ' ' || coalesce(text, ''), 'clause ([0-9]+(\\.[0-9]+)*)', 1)) as ref, generate_subscripts(regexp_extract_all(coalesce(heading, '') || ' ' || coalesce(text, ''), 'clause ([0-9]+(\\.[0-9]+)*)', 1), 1) - 1 as pos from clauses) select chunk_id, ref, min(pos)::int as first_pos, count(*) as n from r group by all")
def mine_01(spark: SparkSession, d: str) -> DataFrame:
    """Clause references of every clause, distinct, with the place of the first."""
    both = F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    refs = _rows(spark, d, "heading", "text").select("chunk_id", F.posexplode(F.regexp_extract_all(both, F.lit(r"clause ([0-9]+(\.[0-9]+)*)"), F.lit(1))).alias("pos", "ref"))
    return refs.groupBy("chunk_id", "ref").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))


@add("mine_08_resolved_references", "with r as (select distinct chunk_id, spec_id, version, unnest(regexp_extract_all(coalesce(text, ''), 'clause ([0-9]+(\\.[0-9]+)*)', 1)) as ref from clauses) select r.chunk_id, r.ref, min(c.chunk_id) as target from r left join clauses c on c.spec_id = r.spec_id and c.version = r.version and c.clause_path = r.ref group by r.chunk_id, r.ref")
def mine_08(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, "text")
    refs = rows.select("chunk_id", "spec_id", "version", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"clause ([0-9]+(\.[0-9]+)*)"), F.lit(1)))).alias("ref"))
    targets = rows.groupBy("spec_id", "version", F.col("clause_path").alias("ref")).agg(F.min("chunk_id").alias("target"))
    return refs.join(targets, ["spec_id", "version", "ref"], "left").select("chunk_id", "ref", "target")


@add("agg_20_verdicts", "select case when text is null or trim(text) = '' then 'textless' when regexp_matches(text, '^(Void|For further study|See clause)') then 'stub' else 'content' end as verdict, count(*) as n from clauses group by 1")
def agg_20(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "textless").when(F.col("text").rlike("^(Void|For further study|See clause)"), "stub").otherwise("content")
    return table(spark, d, "clauses", "text").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
