"""Rows that the test tables lack, added to them so that a query has something to find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table


def literal(x: object) -> str:
    return "null" if x is None else f"{x}::bigint" if type(x) is int else str(x) if isinstance(x, (bool, float)) else "'" + str(x).replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


def values(rows: list[tuple], names: str) -> str:
    """Rows as a SQL relation."""
    return f"(select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({names}))"


_LI = [
    ("6.2", "5G", ""),
    ("6.2.2", "LI at AMF", "The AMF is provisioned over LI_X1."),
    ("6.2.2.2", "Generation of xIRI over LI_X2 at the IRI-POI in AMF", "The IRI-POI present in the AMF shall generate an xIRI containing an AMFRegistration record when a UE registers."),
    ("6.2.2.2.1", "General", "See TS 33.127 and TS 33.128."),
    ("6.2.2.2.2", "Registration", "As TS 23.501 and TS 23.502 say; TS 23.501 holds."),
    ("6.2.2.2.3", "Deregistration", "See ETSI TS 103 221-1 and TS 103221-2."),
    ("6.2.2.2.3.1", "Details of deregistration", "Nothing."),
    ("6.2.3", "LI for SMF/UPF", "Reported over LI_X2 and LI_X3."),
    ("6.2.3.2", "Generation of xCC in UPF over LI_X3", "The cc-poi in the UPF shall generate xCC for each packet."),
    ("6.2.3.2.1", "Packet delivery", "Each packet."),
    ("7.7", "LI for NEF", "The IRI-POI in the NEF shall only generate the xIRI containing the NEFSession and NEFTransfer record."),
]
_LATER = [("6.2.2.2.4", "Location update", "New.")]
#: chunk_id, spec_id, release, version, clause_path, heading, text
CLAUSES = (
    [(-100 - i, "33.128", "Rel-16", "16.1.0", *r) for i, r in enumerate(_LI)]
    + [(-200 - i, "33.128", "Rel-17", "17.1.0", *r) for i, r in enumerate(_LI + _LATER)]
    + [
        (-320, "33.501", "Rel-16", "16.1.0", "3", "Definitions and abbreviations", ""),
        (-319, "33.501", "Rel-16", "16.1.0", "3.2", "Abbreviations", "For this document:\nAMF\tAccess and Mobility Management Function\nNSSAAF\tNetwork Slice-Specific and SNPN\nAuthentication Function\nRow of cells\tthe table\nUPF\tUser Plane Function"),
        (-318, "33.501", "Rel-16", "16.1.0", "", "A letter without a number", "5GC\t5G Core Network"),
        (-317, "33.501", "Rel-16", "16.1.0", "4", "General", "SMF\tSession Management Function"),
    ]
)
NAMES = "chunk_id, spec_id, release, version, clause_path, heading, text"
SQL = f"c as (select {NAMES} from clauses union all select * from {values(CLAUSES, NAMES)} p)"


def clauses(spark: SparkSession, d: str) -> DataFrame:
    names = NAMES.split(", ")
    more = spark.createDataFrame(CLAUSES, "chunk_id long, spec_id string, release string, version string, clause_path string, heading string, text string")
    return table(spark, d, "clauses", *names).unionByName(more)


def reingested(spark: SparkSession, d: str) -> DataFrame:
    """The clauses with the first planted document once more."""
    rows = clauses(spark, d)
    return rows.unionByName(rows.where("spec_id = '33.128' and release = 'Rel-16' and chunk_id < 0"))


REINGESTED_SQL = SQL.replace("c as (", "c0 as (", 1) + ", c as (select * from c0 union all select * from c0 where spec_id = '33.128' and release = 'Rel-16' and chunk_id < 0)"
#: from_term, to_term, evolution_type, spec_id, clause
EDGES = [
    ("MME", "AMF", "split", "33.501", "3.2"), ("MME", "SMF", "split", "33.501", "4"), ("HSS", "UDM", "replaced", "33.501", "3.2"), ("PCRF", "PCF", "replaced", "33.501", "9.9"),
    ("S-GW", "UPF", "split", "33.128", "6.2.3.2"), ("eNB", "gNB", "successor", "1.1", "1"),
]
EDGES_SQL = f"e as (select * from {values(EDGES, 'from_term, to_term, evolution_type, spec_id, clause')} x)"


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "from_term string, to_term string, evolution_type string, spec_id string, clause string")
