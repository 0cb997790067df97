"""References to other documents, and the clauses that hold abbreviations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_code

# Forms of references to specs and to the other body's deliverables.
SPEC_REFERENCE = r"\bT[SR]\s?(\d\d\.\d{3})\b"
DELIVERABLE_REFERENCE = r"(?:ETSI\s+)?(?:TS|TR|EN|EG)\s?(1\d{2}\s?\d{3}(?:-\d+)?)"


def _said() -> Column:
    return F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))


def spec_references(clauses: DataFrame) -> DataFrame:
    """(chunk_id, ref, first_pos, n): specs that each clause names, without its own."""
    found = clauses.select("chunk_id", "spec_id", F.posexplode(F.regexp_extract_all(_said(), F.lit(SPEC_REFERENCE), F.lit(1))).alias("pos", "ref"))
    return found.where(~F.col("ref").eqNullSafe(F.col("spec_id"))).groupBy("chunk_id", "ref").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))


def deliverable_id(found: Column) -> Column:
    """ETSI TS 103 221-1 for 103221-1 and 103 221-1."""
    bare = F.regexp_replace(found, r"\s", "")
    return F.concat(F.lit("ETSI TS "), F.substring(bare, 1, 3), F.lit(" "), bare.substr(F.lit(4), F.length(bare)))


def cited_deliverables(clauses: DataFrame, *keys: str) -> DataFrame:
    """Distinct deliverables that the clauses cite, per key columns, in order."""
    found = clauses.select(*keys, F.explode(F.regexp_extract_all(_said(), F.lit(DELIVERABLE_REFERENCE), F.lit(1))).alias("found"))
    return found.select(*keys, deliverable_id(F.col("found")).alias("cited")).distinct().orderBy(*keys, "cited")


def abbreviation_regions(clauses: DataFrame) -> DataFrame:
    """(chunk_id, spec_id, version) of clauses that list abbreviations.

    A clause whose heading speaks of abbreviations, and what follows it in its
    document (by chunk_id) up to the first numbered clause that isn't under it.
    A heading without a number, or an annex, has only itself. Only paths and
    headings move; a document is one group.
    """
    ship_code(clauses.sparkSession)
    heads = clauses.select("chunk_id", "spec_id", "version", F.coalesce("clause_path", F.lit("")).alias("path"), F.lower(F.coalesce("heading", F.lit(""))).contains("abbreviation").alias("opens"))
    # documents without such a heading are left out before anything is gathered
    some = heads.where("opens").select("spec_id", "version").distinct()

    def region(doc: pd.DataFrame) -> pd.DataFrame:
        doc = doc.sort_values("chunk_id")
        root, keep = None, []
        for path, opens in zip(doc["path"], doc["opens"]):
            under = root is not None and (path == "" or path.startswith(root + "."))
            if not under:
                root = None
            if opens:
                keep.append(True)
                if root is None and path and not path.lower().startswith("annex"):
                    root = path
            else:
                keep.append(under)
        return doc.loc[keep, ["chunk_id", "spec_id", "version"]]

    known = heads.join(some, (heads["spec_id"].eqNullSafe(some["spec_id"])) & (heads["version"].eqNullSafe(some["version"])), "left_semi")
    return known.groupBy("spec_id", "version").applyInPandas(region, "chunk_id long, spec_id string, version string")
