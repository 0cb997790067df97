"""Glossary: authority order of entries, consensus, planned replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Source of an entry that one spec declares.
SPEC_SOURCE = r"^[0-9]{2}\.[0-9]{3}(-[0-9]+)?$"
#: Source of the general vocabulary.
GENERAL = "21"
KEY = ["term", "expansion", "domain"]


def authority_order(entries: DataFrame) -> DataFrame:
    """Entries with ``place`` within their term: spec-sourced first, then the number of
    declaring documents (null and 0 count as 1), domain, expansion."""
    count = F.when(F.coalesce("declared_by", F.lit(0)) < 1, 1).otherwise(F.col("declared_by"))
    spec = F.when(F.coalesce("source_series", F.lit("")).contains("."), 0).otherwise(1)
    w = Window.partitionBy(F.lower("term")).orderBy(spec, count.desc(), "domain", "expansion")
    return entries.withColumn("place", F.row_number().over(w))


def consensus(mentions: DataFrame) -> DataFrame:
    """(term, expansion, declared_by, cited): documents that declare it, and the least of them."""
    return mentions.groupBy("term", "expansion").agg(F.countDistinct("doc").alias("declared_by"), F.min("doc").alias("cited"))


def plan_replacement(existing: DataFrame, batch: DataFrame, general: DataFrame | None) -> DataFrame:
    """What a new batch does to every entry: (*key, source_series, action).

    existing, batch: term, expansion, domain, source_series. Of repeated batch
    keys one holds. general: key rows of the general vocabulary, None if it
    wasn't read. Actions of held entries: kept (declared again), untouched
    (another source), retired (general entry no longer in the general
    vocabulary), and for spec-sourced entries not declared again withheld
    (general not read), restored (general has it) or removed. Batch entries
    that are new or differ are written.
    """
    b = batch.dropDuplicates(KEY).select(*KEY, F.col("source_series").alias("new_source"))
    g = (general if general is not None else existing.limit(0)).select(*KEY).distinct().withColumn("in_general", F.lit(True))
    j = existing.join(b, KEY, "full_outer").join(g, KEY, "left")
    again = F.col("new_source").isNotNull()
    read = F.lit(general is not None)
    old = (
        F.when(again, F.when(F.col("new_source").eqNullSafe(F.col("source_series")), "kept").otherwise("written"))
        .when(F.col("source_series") == GENERAL, F.when(read & F.col("in_general").isNull(), "retired").otherwise("kept"))
        .when(~F.col("source_series").rlike(SPEC_SOURCE), "untouched")
        .when(~read, "withheld")
        .when(F.col("in_general"), "restored")
        .otherwise("removed")
    )
    return j.select(*KEY, F.coalesce("new_source", "source_series").alias("source_series"), F.when(F.col("source_series").isNull() & again, "written").otherwise(old).alias("action"))
