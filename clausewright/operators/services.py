"""Search over structured service descriptions, and the remaining relational operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versioning as V
from ..session import cut_lineage


def weighted_contains(words: Sequence[str], columns: Sequence[tuple[str, int]]) -> Column:
    """Sum of weights over words and columns that contain them; null columns contain nothing."""
    return sum((F.when(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w)), n).otherwise(0) for w in words for c, n in columns), F.lit(0))


def search_services(operations: DataFrame, schemas: DataFrame, words: Sequence[str], k: int, **facets: str) -> DataFrame:
    """Operations and schemas in one list: (kind, id, score, rank).

    Operations weigh their id 3, path 2, summary and service 1; schemas their
    name 3, description 1. Facets narrow operations and, where the column is
    there, schemas. Equal scores order operations first, then by id.
    """
    ops, sch = operations, schemas
    for column, value in facets.items():
        ops = ops.where(F.col(column) == value)
        if column in sch.columns:
            sch = sch.where(F.col(column) == value)
    a = ops.select(F.lit("operation").alias("kind"), F.col("operation_id").alias("id"), weighted_contains(words, [("operation_id", 3), ("path", 2), ("summary", 1), ("service", 1)]).alias("score"))
    b = sch.select(F.lit("schema").alias("kind"), F.col("schema_name").alias("id"), weighted_contains(words, [("schema_name", 3), ("description", 1)]).alias("score"))
    hits = a.unionByName(b).where("score > 0").groupBy("kind", "id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "kind", "id").limit(k)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "kind", "id")))


def joined_list(c: Column | str, separator: str = ",") -> Column:
    """A list as text; a null list is the empty text."""
    return F.coalesce(F.array_join(F.col(c) if isinstance(c, str) else c, separator), F.lit(""))


def newest_per(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The newest version of each key, by number."""
    return df.groupBy(*keys).agg(F.max_by(version, V.version_key(version)).alias(version))


def neighbours(edges: DataFrame, entity: str) -> DataFrame:
    """One hop of an edge list in either direction, whatever the case of names."""
    x = entity.upper()
    return edges.where((F.upper("from_term") == x) | (F.upper("to_term") == x)).orderBy("from_term", "to_term")


def overfetch(ranked: DataFrame, keep: Column, k: int, factor: int = 8, cap: int = 500) -> DataFrame:
    """What an index that can't filter would give: of the first min(factor * k, cap) hits
    those that pass, at most k. ``ranked`` has query_id and rank."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return ranked.where(F.col("rank") <= min(factor * k, cap)).where(keep).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def attest(counters: DataFrame, stamped: DataFrame) -> DataFrame:
    """(name, now, stamped, holds) of counters (one row, wide) against stamped (name, value)."""
    names = counters.columns
    now = counters.select([F.col(c).cast("long") for c in names]).unpivot([], names, "name", "now")
    return now.join(stamped.select("name", F.col("value").alias("stamped")), "name", "left").withColumn("holds", F.col("now").eqNullSafe(F.col("stamped")))


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with their ``place`` from 0 in a total order: ranges are numbered apart and
    shifted by the rows of the ranges before, so no task holds all rows."""
    ranged = df.repartitionByRange(*order).withColumn("__b", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    sizes = ranged.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row a range
    own = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(*order)))
    return own.join(F.broadcast(before), "__b").withColumn("place", F.col("__off") + F.col("__r") - 1).drop("__b", "__r", "__off")


def unpacked(df: DataFrame, columns: Sequence[str], separator: str = "\x1f") -> DataFrame:
    """Lists that come as one text, split; an empty or null text is an empty list."""
    empty = F.array().cast("array<string>")
    return df.withColumns({c: F.when(F.coalesce(F.col(c), F.lit("")) == "", empty).otherwise(F.split(F.col(c), separator, -1)) for c in columns})


def version_in_release(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """Asked (spec_id, version, release) with ``state``: there, elsewhere (under another release only) or unknown."""
    v = versions.select("spec_id", "version", "release").distinct()
    here = v.withColumn("__here", F.lit(True))
    any_ = v.select("spec_id", "version").distinct().withColumn("__any", F.lit(True))
    j = asked.join(here, ["spec_id", "version", "release"], "left").join(any_, ["spec_id", "version"], "left")
    return j.withColumn("state", F.when(F.col("__here"), "there").when(F.col("__any"), "elsewhere").otherwise("unknown")).drop("__here", "__any")
