"""Parsers over whole tables. They keep state from line to line, so SQL can't state most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mining import events as E
from ..mining import references as refs
from ..mining import rows as M
from ..sources import files
from ..sources.tables import table
from . import planted
from .registry import Registry

registry = Registry()
add = registry.add


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses", "chunk_id", "text")


_PAGES = [
    (-1, "<H1>1 Scope</H1><p>First  line</p><li>item</li><h2>1.1 Empty</h2><H2>1.2 Terms</H2><table><tr><td>AMF</td><td>Access</td></tr></table><p>tail"),
    (-2, "<h1>Annex A (informative): Examples</h1><p>One</p><h2>A.1 More</h2><p>Two</p><h1>Change history</h1><p>gone</p>"),
    (-3, "<p>no heading</p><p>2 Salvaged</p><p>Text here.</p>"),
]
_PAGE_CLAUSES = [
    (-1, "1", "Scope", "First line|item", True), (-1, "1.2", "Terms", "AMF\tAccess|tail", True),
    (-2, "A", "(informative): Examples", "One", False), (-2, "A.1", "More", "Two", False), (-3, "2", "Salvaged", "Text here.", True),
]


@add("src_06_html_clauses", f"select * from {planted.values([(*r[:4], r[4]) for r in _PAGE_CLAUSES], 'chunk_id, clause_path, heading, text, is_normative')} p")
def src_06(spark: SparkSession, d: str) -> DataFrame:
    """Clauses of texts with headings; documents of the archive's form are planted among them."""
    pages = spark.createDataFrame(_PAGES, "chunk_id long, text string")
    rows = _texts(spark, d).where(F.col("text").rlike("(?i)<h[1-6][ >]")).unionByName(pages)
    found = M.html_clauses(rows, "chunk_id", "text")
    return found.where("chunk_id < 0").select("chunk_id", "clause_path", "heading", F.replace("text", F.lit("\n"), F.lit("|")).alias("text"), "is_normative")


@add("src_07_html_tables", "with r as (select chunk_id, unnest(regexp_extract_all(text, '(?i)<TR><T[DH]>([^<]*)</T[DH]><T[DH]>([^<]*)</T[DH]></TR>', 1)) as a, unnest(regexp_extract_all(text, '(?i)<TR><T[DH]>([^<]*)</T[DH]><T[DH]>([^<]*)</T[DH]></TR>', 2)) as b from clauses) select chunk_id, trim(regexp_replace(a, '[ \\x{00A0}]+', ' ', 'g')) || chr(9) || trim(regexp_replace(b, '[ \\x{00A0}]+', ' ', 'g')) as line, count(*) as n from r group by all")
def src_07(spark: SparkSession, d: str) -> DataFrame:
    rows = M.html_tables(_texts(spark, d).where(F.contains(F.lower("text"), F.lit("<table"))), "chunk_id", "text")
    return rows.groupBy("chunk_id", "line").agg(F.count(F.lit(1)).alias("n"))


@add("src_10_file_metadata", "with f as (select distinct docx_url from spec_versions where docx_url is not null) select docx_url, case when regexp_matches(docx_url, '([0-9]{2})([0-9]{3})-([0-9a-z]{3})[.][a-z]+$') then regexp_extract(docx_url, '([0-9]{2})([0-9]{3})-([0-9a-z]{3})[.][a-z]+$', 1) || '.' || regexp_extract(docx_url, '([0-9]{2})([0-9]{3})-([0-9a-z]{3})[.][a-z]+$', 2) end as spec_id from f")
def src_10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spec_versions", "docx_url").where("docx_url is not null").distinct()
    return rows.select("docx_url", files.file_metadata(F.col("docx_url"))["spec_id"].alias("spec_id"))


@add("src_12_asn1_types", "with t as (select chunk_id, unnest(regexp_extract_all(replace(replace(text, chr(160), ' '), chr(13), ''), '([A-Za-z][A-Za-z0-9-]*) *::= *SEQUENCE\\s*\\{[^}]*\\}', 1)) as name from clauses) select chunk_id, name, count(*) as n from t group by all")
def src_12(spark: SparkSession, d: str) -> DataFrame:
    rows = M.asn1_types(_texts(spark, d).where(F.contains("text", F.lit("::="))), "chunk_id", "text").where("kind = 'sequence'")
    return rows.groupBy("chunk_id", "name").agg(F.count(F.lit(1)).alias("n"))


@add("sca_28_members_json", "with t as (select chunk_id, replace(replace(text, chr(160), ' '), chr(13), '') as x from clauses where contains(text, '::=')), m as (select chunk_id, unnest(regexp_extract_all(x, '\\[([0-9]+)\\] +(INTEGER|BOOLEAN|UTF8String|OCTET STRING)', 1)) as tag from t) select tag::int as tag, count(*) as members from m group by 1")
def sca_28(spark: SparkSession, d: str) -> DataFrame:
    """Members as JSON and back, counted by tag."""
    types = M.asn1_types(_texts(spark, d).where(F.contains("text", F.lit("::="))), "chunk_id", "text")
    kind = "array<struct<name:string,type:string,tag:int,optional:boolean,clause:string>>"
    back = types.select(F.explode(F.from_json(F.to_json("members"), kind)).alias("m"))
    return back.groupBy(F.col("m.tag").alias("tag")).agg(F.count(F.lit(1)).alias("members"))


_ENTRIES = [(-319, "AMF", "Access and Mobility Management Function"), (-319, "NSSAAF", "Network Slice-Specific and SNPN Authentication Function"), (-319, "UPF", "User Plane Function"), (-318, "5GC", "5G Core Network")]


@add("mine_09_abbreviations", f"select * from {planted.values(_ENTRIES, 'chunk_id, term, expansion')} p")
def mine_09(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the abbreviation clauses of all documents; those planted are all there are."""
    rows = planted.clauses(spark, d)
    return M.abbreviations(rows.join(refs.abbreviation_regions(rows).select("chunk_id"), "chunk_id", "left_semi"), "chunk_id", "text").select("chunk_id", "term", "expansion")


@add("mine_10_regions", f"with {planted.SQL} select chunk_id from c where chunk_id in (-320, -319, -318) or contains(lower(heading), 'abbreviation')")
def mine_10(spark: SparkSession, d: str) -> DataFrame:
    return refs.abbreviation_regions(planted.clauses(spark, d)).select("chunk_id")


_SAID = "regexp_replace(coalesce(heading, '') || ' ' || coalesce(text, ''), '\\s+', ' ', 'g')"
_DOMAIN_SQL = "case when starts_with({0}, '6.2') then '5GC' when starts_with({0}, '6.3') then 'EPC' when starts_with({0}, '6.4') then '3G' else '' end"
_HEADS_SQL = f"{planted.SQL}, h as (select spec_id, version, clause_path, arg_max(heading, chunk_id) as heading, max(chunk_id) as chunk_id from c where clause_path <> '' group by all)"
_GEN_SQL = (
    f"{_HEADS_SQL}, g as (select h.*, list_filter(list_transform(regexp_extract_all(h.heading, '{E.FUNCTION_IN}', 1), lambda x: upper(x)), lambda x: x not in {E.NOT_FUNCTIONS}) as fs, a.heading as above, regexp_replace(upper(regexp_extract(h.heading, '{E.INTERFACE}', 1)), '^LI_?', 'LI_') as interface from h left join h a on a.spec_id = h.spec_id and a.version = h.version and a.clause_path = array_to_string(string_split(h.clause_path, '.')[1:3], '.') where regexp_matches(h.heading, '{E.GENERATION}')),"
    " s as (select *, case when len(fs) > 0 then fs[-1] else trim(regexp_replace(coalesce(above, ''), 'LI (at|for|support at|in) ', '', 'g')) end as nf from g),"
    f" k as (select s.spec_id, s.version, s.nf, {_DOMAIN_SQL.format('s.clause_path')} as domain, trim(h.heading) as name, s.interface, h.clause_path, s.chunk_id as sc, h.chunk_id as hc from s join h on h.spec_id = s.spec_id and h.version = s.version and regexp_replace(h.clause_path, '[.][^.]*$', '') = s.clause_path and h.clause_path <> s.clause_path where trim(coalesce(h.heading, '')) <> '' and not regexp_matches(trim(h.heading), '{E.BOILERPLATE}'))"
)


@add("mine_02_interception_events", f"with {planted.SQL}, m as (select spec_id, version, chunk_id, {_DOMAIN_SQL.format('clause_path')} as domain, unnest(regexp_extract_all({_SAID}, '{E.POI}', 2)) as nf, unnest(regexp_extract_all({_SAID}, '{E.POI}', 3)) as kind, unnest(regexp_extract_all({_SAID}, '{E.POI}', 4)) as tail from c), n as (select spec_id, version, chunk_id, domain, trim(nf) as nf, case when lower(kind) = 'xcc' then 'LI_X3' else 'LI_X2' end as interface, regexp_extract_all(regexp_extract(tail, '(?is)^(.*?)(record|$)', 1), '{E.RECORD}') as names from m), x as (select spec_id, version, chunk_id, domain, nf, interface, unnest(case when len(names) > 0 then names else [''] end) as name from n) select spec_id, version, arg_min(nf, chunk_id) as nf, arg_min(domain, chunk_id) as domain, interface, name, min(chunk_id) as chunk_id from x group by spec_id, version, upper(nf), interface, name")
def mine_02(spark: SparkSession, d: str) -> DataFrame:
    return E.poi_events(planted.clauses(spark, d))


@add("mine_03_inventory", f"select * from {planted.values([('33.128', v, n, i, e) for v in ('16.1.0', '17.1.0') for n, i, e in (('AMF', 'LI_X1,LI_X2', 1), ('NEF', 'LI_X1,LI_X2', 2), ('SMF/UPF', 'LI_X1,LI_X2,LI_X3', 0), ('UPF', 'LI_X1,LI_X3', 1))], 'spec_id, version, nf, interfaces, events')} p")
def mine_03(spark: SparkSession, d: str) -> DataFrame:
    """Functions of the planted document: the tables have none."""
    found = E.nf_inventory(planted.clauses(spark, d))
    return found.select("spec_id", "version", "nf", F.array_join("interfaces", ",").alias("interfaces"), "events")


@add("mine_04_generation_events", f"with {_GEN_SQL} select spec_id, version, nf, arg_min(domain, sc * 100000 + hc) as domain, name, arg_min(interface, sc * 100000 + hc) as interface, arg_min(clause_path, sc * 100000 + hc) as clause_path from k group by spec_id, version, nf, name")
def mine_04(spark: SparkSession, d: str) -> DataFrame:
    return E.generation_events(planted.clauses(spark, d))


@add("mine_05_x2_sections", f"with {_GEN_SQL}, t as (select spec_id, version, nf, string_agg(name, '|' order by hc) as events, any_value(regexp_replace(clause_path, '[.][^.]*$', '')) as section from k where interface = 'LI_X2' group by all) select t.*, coalesce(case when trim(h.heading) in ('5G', '4G', '3G') then trim(h.heading) end, '') as generation from t left join h on h.spec_id = t.spec_id and h.version = t.version and h.clause_path = array_to_string(string_split(t.section, '.')[1:2], '.')")
def mine_05(spark: SparkSession, d: str) -> DataFrame:
    return E.x2_sections(planted.clauses(spark, d)).withColumn("events", F.array_join("events", "|"))


@add("mine_06_sections", f"with {planted.SQL} select distinct spec_id, version, trim(regexp_replace(heading, 'LI (at|for|support at|in) ', '', 'g')) as nf, {_DOMAIN_SQL.format('clause_path')} as domain, heading, clause_path from c where regexp_full_match(clause_path, '6[.][0-9]+[.][0-9]+') and starts_with(trim(heading), 'LI ')")
def mine_06(spark: SparkSession, d: str) -> DataFrame:
    return E.nf_sections(planted.clauses(spark, d))


@add("mine_07_section_interfaces", f"with {planted.SQL}, s as (select distinct spec_id, version, clause_path as section from c where regexp_full_match(clause_path, '[67][.][0-9]+([.][0-9]+)?') and regexp_matches(trim(heading), '{E.LI_HEADING}')), f as (select s.*, regexp_replace(upper(unnest(regexp_extract_all(coalesce(heading, '') || ' ' || coalesce(text, ''), '{E.ANY_X}'))), '^LI_?', 'LI_') as i from s join c on c.spec_id = s.spec_id and c.version = s.version and (c.clause_path = s.section or starts_with(c.clause_path, s.section || '.'))), w as (select * from f union select spec_id, version, section, 'LI_X1' from f where i in ('LI_X2', 'LI_X3')), l as (select spec_id, version, section, string_agg(distinct i, ',' order by i) as interfaces from w group by all) select s.*, coalesce(interfaces, '') as interfaces from s left join l using (spec_id, version, section)")
def mine_07(spark: SparkSession, d: str) -> DataFrame:
    rows = planted.clauses(spark, d)
    own = rows.where(F.col("clause_path").rlike(E.ANY_SECTION) & F.trim("heading").rlike(E.LI_HEADING)).select("spec_id", "version", F.col("clause_path").alias("section"))
    return E.section_interfaces(rows, own).withColumn("interfaces", F.array_join("interfaces", ","))


@add("lin_07_event_catalogue", f"select * from {planted.values([('33.128', 'AMF', 'LI_X2', '6.2.2.2.2', 'Registration', None), ('33.128', 'AMF', 'LI_X2', '6.2.2.2.3', 'Deregistration', None), ('33.128', 'AMF', 'LI_X2', '6.2.2.2.4', 'Location update', 'Rel-17'), ('33.128', 'UPF', 'LI_X3', '6.2.3.2.1', 'Packet delivery', None)], 'spec_id, nf, interface, clause_path, name, added_later')} p")
def lin_07(spark: SparkSession, d: str) -> DataFrame:
    """Events of the planted document as seen from its first release: the tables have none."""
    return E.event_catalogue(planted.clauses(spark, d), "Rel-16").drop("in_baseline")


_CLAIMS = [(1, "AMF registration xIRI", "33.128", "6.2.2.2"), (2, "Packet delivery", "33.128", "6.2.3.2.1.5"), (3, "NEF transfer record", "33.128", "6.2.9"), (4, "Mobility management access", "33.128", "6.2.2"), (5, "qwertz asdfgh", "33.128", "6.2")]
_FOUND = [(1, "confirmed", None, None), (2, "parent", None, None), (3, "in-spec", None, None), (4, "wrong-spec", "33.501", "3.2"), (5, "not-found", None, None)]


@add("mine_14_audit", f"select * from {planted.values(_FOUND, 'event_id, verdict, real_spec, real_clause')} p")
def mine_14(spark: SparkSession, d: str) -> DataFrame:
    """Cited events against the planted documents."""
    claims = spark.createDataFrame(_CLAIMS, "event_id long, event string, spec string, clause string")
    return E.audit(claims, planted.clauses(spark, d).where("chunk_id < 0"))


@add("mine_01_spec_references", f"with {planted.SQL}, r as (select chunk_id, spec_id, unnest(regexp_extract_all(coalesce(heading, '') || ' ' || coalesce(text, ''), '{refs.SPEC_REFERENCE}', 1)) as ref, generate_subscripts(regexp_extract_all(coalesce(heading, '') || ' ' || coalesce(text, ''), '{refs.SPEC_REFERENCE}', 1), 1) - 1 as pos from c) select chunk_id, ref, min(pos)::int as first_pos, count(*) as n from r where ref is distinct from spec_id group by all")
def mine_01_specs(spark: SparkSession, d: str) -> DataFrame:
    return refs.spec_references(planted.clauses(spark, d))


@add("mine_08_cited_deliverables", f"with {planted.SQL}, r as (select spec_id, replace(unnest(regexp_extract_all(coalesce(heading, '') || ' ' || coalesce(text, ''), '{refs.DELIVERABLE_REFERENCE}', 1)), ' ', '') as x from c) select distinct spec_id, 'ETSI TS ' || substr(x, 1, 3) || ' ' || substr(x, 4) as cited from r")
def mine_08_deliverables(spark: SparkSession, d: str) -> DataFrame:
    return refs.cited_deliverables(planted.clauses(spark, d), "spec_id")


@add("mine_13_change_requests", "with l as (select doc_id, unnest(regexp_extract_all(text, '(?m)^Change request ([0-9]+) rev ([0-9]+), category ([A-F])', 1)) as number, unnest(regexp_extract_all(text, '(?m)^Change request ([0-9]+) rev ([0-9]+), category ([A-F])', 2))::int as revision, unnest(regexp_extract_all(text, '(?m)^Change request ([0-9]+) rev ([0-9]+), category ([A-F])', 3)) as category from documents) select * from l")
def mine_13(spark: SparkSession, d: str) -> DataFrame:
    """Headers of change requests in the corpus: one scan, one expression per part."""
    form = r"(?m)^Change request ([0-9]+) rev ([0-9]+), category ([A-F])"
    part = [F.regexp_extract_all("text", F.lit(form), F.lit(i)) for i in (1, 2, 3)]
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.arrays_zip(*[p.alias(n) for p, n in zip(part, "nrc")])).alias("x"))
    return rows.select("doc_id", F.col("x.n").alias("number"), F.col("x.r").cast("int").alias("revision"), F.col("x.c").alias("category"))
