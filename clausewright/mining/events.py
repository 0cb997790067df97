"""Interception events from clause trees and prose: joins and expressions, no Python per row.

A clause tree is the clauses of one document, told apart by ``scope`` columns
(spec and version by default). Paths meet by equality: a child knows its
parent's path, a clause those of all its ancestors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import versioning as V
from .parsers import DOMAINS

# The forms of headings and sentences that name events, their functions and interfaces.
GENERATION = r"(?i)generation of x?(iri|cc) .*over\s+(li_?x2|li_?x3|li_?hi2|li_?hi3)"
GENERATION_X2 = r"(?i)generation of xiri.*over\s+li_?x2"
INTERFACE = r"(?i)(li_?x2|li_?x3|li_?hi2|li_?hi3)"
ANY_X = r"(?i)li_?x1|li_?x2|li_?x3"
BOILERPLATE = r"(?i)^(general|void|introduction|common.*|.*simple data types.*|definitions? for .*|.*message types?|provisioning over.*)$"
FUNCTION_IN = r"(?i)\b(?:at|in)\s+(?:the\s+|a\s+|IRI-POI\s+(?:in\s+the\s+|in\s+)?|CC-POI\s+(?:in\s+the\s+|in\s+)?)*([A-Z][A-Za-z0-9/-]{1,9})"
NOT_FUNCTIONS = ("IRI", "POI", "LI", "CC", "TF", "THE", "IRI-POI", "CC-POI", "UE")
SECTION = r"^6\.\d+\.\d+$"
ANY_SECTION = r"^[67]\.\d+(\.\d+)?$"
LI_HEADING = r"(?i)^LI (?:at|for|support at|in) "
POI = r"(?i)\b(IRI|CC)-POI\s+(?:present\s+)?in the\s+(.{2,40}?)\s+shall\s+(?:only\s+)?generate\s+(?:an?\s+|the\s+)?(xIRI|xCC)\b([^.]{0,200})"
RECORD = r"[A-Z][A-Za-z0-9]{4,}"
GENERATIONS = ("5G", "4G", "3G")

SCOPE = ("spec_id", "version")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def domain_of(path: Column) -> Column:
    return F.coalesce(*[F.when(path.startswith(p), d) for p, d in DOMAINS], F.lit(""))


def canonical(interface: Column) -> Column:
    """LI_X2 for lix2, LI_X2, li_x2."""
    return F.regexp_replace(F.upper(interface), "^LI_?", "LI_")


def without_li(heading: Column) -> Column:
    """A section's function: its heading without the opening words."""
    return F.trim(F.regexp_replace(heading, "LI (?:at|for|support at|in) ", ""))


def clean_function(name: Column) -> Column:
    """A mined function's name without article and punctuation; null where it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\s+", " "), r"^[ .,:;()]+|[ .,:;()]+$", ""), "^[tT]he ", "")
    return F.when((bare != "") & ~F.upper(bare).isin(*NOT_FUNCTIONS), bare)


def _function_of(heading: Column) -> Column:
    """The last function that a heading names, null if none."""
    named = F.transform(F.regexp_extract_all(heading, F.lit(FUNCTION_IN), F.lit(1)), F.upper)
    return F.element_at(F.filter(named, lambda x: ~x.isin(*NOT_FUNCTIONS)), -1)


def _heads(clauses: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One heading a path: of repeated paths that of the largest chunk_id."""
    return clauses.where("clause_path <> ''").groupBy(*scope, "clause_path").agg(F.max_by("heading", "chunk_id").alias("heading"), F.max("chunk_id").alias("chunk_id"))


def poi_events(clauses: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Events of the prose: scope, nf, domain, interface, name, chunk_id (of the first that tells it).

    Records are those before the word "record"; a sentence without one is one
    nameless event. Functions compare whatever their case.
    """
    said = F.regexp_replace(F.concat(_text("heading"), F.lit(" "), _text("text")), r"\s+", " ")
    group = [F.regexp_extract_all(said, F.lit(POI), F.lit(n)).alias(f"g{n}") for n in (2, 3, 4)]
    rows = clauses.where(F.lower("text").contains("-poi") | F.lower("heading").contains("-poi")).select(*scope, "chunk_id", "clause_path", F.explode(F.arrays_zip(*group)).alias("m"))
    tail = F.split(F.col("m.g4"), "(?i)record", 2)[0]
    names = F.regexp_extract_all(tail, F.lit(RECORD), F.lit(0))
    each = rows.select(
        *scope, "chunk_id", domain_of(_text("clause_path")).alias("domain"), clean_function(F.col("m.g2")).alias("nf"),
        F.when(F.lower("m.g3") == "xcc", "LI_X3").otherwise("LI_X2").alias("interface"), F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("")))).alias("name"),
    ).where("nf is not null")
    first = each.groupBy(*scope, F.upper("nf").alias("__nf"), "interface", "name").agg(F.min(F.struct("chunk_id", "nf", "domain")).alias("x"))
    return first.select(*scope, "x.nf", "x.domain", "interface", "name", "x.chunk_id")


def generation_sections(clauses: DataFrame, scope: Sequence[str] = SCOPE, form: str = GENERATION) -> DataFrame:
    """Sections that generate events: scope, section, heading, nf, domain, interface, chunk_id.

    The function is the last that the heading names, else that of the section
    three levels deep above it.
    """
    heads = _heads(clauses, scope)
    above = heads.select(*scope, F.col("clause_path").alias("__above"), F.col("heading").alias("__head"))
    own = heads.where(F.col("heading").rlike(form)).withColumn("__above", F.substring_index("clause_path", ".", 3))
    j = own.join(above, [*scope, "__above"], "left")
    return j.select(
        *scope, F.col("clause_path").alias("section"), "heading", F.coalesce(_function_of(F.col("heading")), without_li(_text("__head"))).alias("nf"),
        domain_of(F.col("clause_path")).alias("domain"), canonical(F.regexp_extract("heading", INTERFACE, 1)).alias("interface"), "chunk_id",
    )


def _children(clauses: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Direct children that may be events: scope, section (their parent), name, clause_path, child."""
    heads = _heads(clauses, scope).withColumn("name", F.trim(_text("heading")))
    kids = heads.where(F.col("clause_path").contains(".") & (F.col("name") != "") & ~F.col("name").rlike(BOILERPLATE))
    return kids.select(*scope, F.regexp_replace("clause_path", r"\.[^.]*$", "").alias("section"), "name", "clause_path", F.col("chunk_id").alias("child"))


def generation_events(clauses: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Events of generation sections: scope, nf, domain, name, interface, clause_path; a name
    counts once per function, under the first section that has it."""
    j = generation_sections(clauses, scope).join(_children(clauses, scope), [*scope, "section"])
    first = F.min(F.struct("chunk_id", "child", "interface", "domain", "clause_path"))
    return j.groupBy(*scope, "nf", "name").agg(first.alias("x")).select(*scope, "nf", "x.domain", "name", "x.interface", "x.clause_path")


def x2_sections(clauses: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Sections of the second interface with their events, and the generation that the clause
    two levels deep above them is headed by: scope, nf, section, generation, events (in path order)."""
    above = _heads(clauses, scope).select(*scope, F.col("clause_path").alias("__top"), F.trim("heading").alias("generation"))
    sections = generation_sections(clauses, scope, GENERATION_X2).withColumn("__top", F.substring_index("section", ".", 2))
    labelled = sections.join(above.where(F.col("generation").isin(*GENERATIONS)), [*scope, "__top"], "left")
    kids = _children(clauses, scope).groupBy(*scope, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("child", "name"))), lambda x: x["name"]).alias("events"))
    return labelled.join(kids, [*scope, "section"], "left").select(*scope, "nf", "section", F.coalesce("generation", F.lit("")).alias("generation"), F.coalesce("events", F.array().cast("array<string>")).alias("events"))


def nf_sections(clauses: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Sections of their own that functions have: scope, nf, domain, heading, clause_path."""
    own = clauses.where(F.col("clause_path").rlike(SECTION) & F.trim("heading").startswith("LI "))
    return own.select(*scope, without_li(F.col("heading")).alias("nf"), domain_of(F.col("clause_path")).alias("domain"), "heading", "clause_path").distinct()


def with_implied(interfaces: Column) -> Column:
    """Sorted interfaces; who serves the second or third is provisioned over the first."""
    served = F.array_contains(interfaces, "LI_X2") | F.array_contains(interfaces, "LI_X3")
    return F.array_sort(F.array_distinct(F.when(served, F.array_append(interfaces, F.lit("LI_X1"))).otherwise(interfaces)))


def section_interfaces(clauses: DataFrame, sections: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """(scope, section, interfaces): what each section and the clauses under it name."""
    found = F.transform(F.regexp_extract_all(F.concat(_text("heading"), F.lit(" "), _text("text")), F.lit(ANY_X), F.lit(0)), canonical)
    rows = clauses.where("clause_path <> ''").select(*scope, "clause_path", F.array_distinct(found).alias("found")).where(F.size("found") > 0)
    parts = F.split("clause_path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    under = rows.select(*scope, "found", F.explode(prefixes).alias("section"))
    seen = under.join(sections.select(*scope, "section").distinct(), [*scope, "section"], "left_semi").select(*scope, "section", F.explode("found").alias("interface"))
    sets = seen.groupBy(*scope, "section").agg(F.collect_set("interface").alias("interfaces"))
    all_ = sections.select(*scope, "section").distinct().join(sets, [*scope, "section"], "left")
    return all_.select(*scope, "section", with_implied(F.coalesce("interfaces", F.array().cast("array<string>"))).alias("interfaces"))


def nf_inventory(clauses: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Every function that the document names, from prose and section headings:
    scope, nf, interfaces, events (distinct ones of the prose)."""
    prose = poi_events(clauses, scope).select(*scope, "nf", F.array("interface").alias("interfaces"), F.struct("interface", "name").alias("event"), F.lit(0).alias("rank"), "chunk_id")
    own = clauses.where(F.col("clause_path").rlike(ANY_SECTION) & F.trim("heading").rlike(LI_HEADING))
    named = own.select(*scope, F.col("clause_path").alias("section"), clean_function(without_li(F.col("heading"))).alias("nf"), "chunk_id").where("nf is not null")
    sections = named.join(section_interfaces(clauses, named, scope), [*scope, "section"])
    headed = sections.select(*scope, "nf", "interfaces", F.lit(None).cast(prose.schema["event"].dataType).alias("event"), F.lit(1).alias("rank"), "chunk_id")
    both = prose.unionByName(headed).groupBy(*scope, F.upper("nf").alias("__nf")).agg(
        F.min_by("nf", F.struct("rank", "chunk_id")).alias("nf"), F.array_distinct(F.flatten(F.collect_set("interfaces"))).alias("i"), F.countDistinct("event").alias("events")
    )
    return both.select(*scope, "nf", with_implied(F.col("i")).alias("interfaces"), "events")


def event_catalogue(clauses: DataFrame, baseline: str) -> DataFrame:
    """Events of each function as seen from a baseline release, with those that come later.

    spec_id, nf, interface, clause_path, name, in_baseline, added_later (first
    later release, null in the baseline). Events that were only before it give
    no rows. Availability of a path is over all releases of its spec.
    """
    rows = clauses.where("clause_path <> ''")
    seen = rows.groupBy("spec_id", "clause_path").agg(F.collect_set("release").alias("releases"), F.max("heading").alias("heading"), F.min("chunk_id").alias("chunk_id"))
    events = generation_sections(seen, ["spec_id"]).join(_children(seen, ["spec_id"]), ["spec_id", "section"]).dropDuplicates(["spec_id", "nf", "clause_path"])
    j = events.join(seen.select("spec_id", "clause_path", "releases"), ["spec_id", "clause_path"])
    after = F.filter("releases", lambda r: V.release_ordinal(r) > V.release_ordinal(F.lit(baseline)))
    first = F.element_at(F.array_sort(F.transform(after, lambda r: F.struct(V.release_ordinal(r).alias("o"), r.alias("r")))), 1)["r"]
    here = F.array_contains("releases", baseline)
    out = j.select("spec_id", "nf", "interface", "clause_path", "name", here.alias("in_baseline"), F.when(~here & (F.size(after) > 0), first).alias("added_later"))
    return out.where("in_baseline or added_later is not null")


def of_function(events: DataFrame, nf: str) -> DataFrame:
    """Events of the functions of which ``nf`` is a part (UPF of SMF/UPF)."""
    return events.where(F.array_contains(F.split(F.upper("nf"), "[/ ]"), nf.upper()))


# Shares of an event's words that settle a verdict.
CLAUSE_FLOOR, IN_CITED_FLOOR = 0.6, 0.6


def audit(events: DataFrame, clauses: DataFrame, clause_floor: float = CLAUSE_FLOOR, elsewhere_floor: float = IN_CITED_FLOOR) -> DataFrame:
    """A verdict for each cited event: event_id, verdict, real_spec, real_clause.

    events: event_id, event (a name), spec, clause. confirmed (the cited
    clause has the words), parent (the clause above has), in-spec (another
    clause of the spec has), wrong-spec (one clause of one other spec has
    them best), ambiguous (several have them equally well), not-found. Clauses
    without a path can't be cited and don't count; the newest version of a spec
    holds. Only clauses that share a word with an event are looked at.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: F.length(w) > 1))
    e = events.select("event_id", "spec", "clause", words(F.col("event")).alias("words"))
    newest = clauses.groupBy("spec_id").agg(F.max(V.version_key("version")).alias("__v"))
    rows = clauses.where("clause_path <> ''").join(newest, "spec_id").where(V.version_key("version") == F.col("__v"))
    said = rows.groupBy("spec_id", "clause_path").agg(F.max_by(F.concat(_text("heading"), F.lit(" "), _text("text")), "chunk_id").alias("t"))
    held = said.select("spec_id", "clause_path", F.explode(words(F.col("t"))).alias("word"))
    hits = e.select("event_id", "spec", "clause", F.size("words").alias("n"), F.explode("words").alias("word")).join(held, "word").groupBy("event_id", "spec", "clause", "spec_id", "clause_path").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    own = F.col("spec_id") == F.col("spec")
    parent = F.when(F.col("clause").contains("."), F.regexp_replace("clause", r"\.[^.]*$", ""))
    best = hits.groupBy("event_id").agg(
        F.max(F.when(own & (F.col("clause_path") == F.col("clause")), F.col("share"))).alias("at"),
        F.max(F.when(own & (F.col("clause_path") == parent), F.col("share"))).alias("above"),
        F.max(F.when(own, F.col("share"))).alias("inside"),
        F.max(F.when(~own, F.col("share"))).alias("outside"),
    )
    top = hits.where(~own).join(best.select("event_id", "outside"), "event_id").where("share = outside").groupBy("event_id").agg(F.count(F.lit(1)).alias("rivals"), F.min(F.struct("spec_id", "clause_path")).alias("real"))
    over = lambda c, floor: F.coalesce(F.col(c), F.lit(0.0)) >= floor
    verdict = (
        F.when(over("at", clause_floor), "confirmed").when(over("above", clause_floor), "parent").when(over("inside", elsewhere_floor), "in-spec")
        .when(over("outside", elsewhere_floor) & (F.col("rivals") == 1), "wrong-spec").when(over("outside", elsewhere_floor), "ambiguous").otherwise("not-found")
    )
    j = e.select("event_id").join(best, "event_id", "left").join(top, "event_id", "left").withColumn("verdict", verdict)
    wrong = F.col("verdict") == "wrong-spec"
    return j.select("event_id", "verdict", F.when(wrong, F.col("real.spec_id")).alias("real_spec"), F.when(wrong, F.col("real.clause_path")).alias("real_clause"))


def asn1_type(types: DataFrame, name: str) -> DataFrame:
    """The definition of a type in the newest release that has it (by number, not by text)."""
    return types.where(F.col("name") == name).orderBy(V.release_ordinal("release").desc(), "chunk_id").limit(1)

