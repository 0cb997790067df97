"""DML on relations without a table format: each function gives the relation after it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files


def align(*tables: DataFrame) -> list[DataFrame]:
    """The tables on their common columns, never by position."""
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    return [t.select(*common) for t in tables]


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace base rows of the same key; of repeated new keys any one row holds.

    Keys compare null-safe. The base is shuffled once, by key.
    """
    one = new.dropDuplicates(list(keys))
    return base.join(one.select(*keys), _same(base, one, keys), "left_anti").unionByName(one, allowMissingColumns=True)


def insert_ignore(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key the base has not; of repeated new keys one."""
    one = new.dropDuplicates(list(keys))
    return base.unionByName(one.join(base.select(*keys), _same(one, base, keys), "left_anti"), allowMissingColumns=True)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def update_where_different(base: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns overwritten by non-empty new values; ``changed`` tells rows that differ."""
    n = new.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns]).dropDuplicates(["__k"])
    j = base.join(n, base[key] == n["__k"], "left")
    value = {c: F.when(F.coalesce(F.col(f"__{c}"), F.lit("")) != "", F.col(f"__{c}")).otherwise(base[c]) for c in columns}
    differs = reduce(lambda x, y: x | y, [~value[c].eqNullSafe(base[c]) for c in columns])
    return j.select(*[value[c].alias(c) if c in value else base[c] for c in base.columns], differs.alias("changed"))


def update_from(base: DataFrame, new: DataFrame, keys: Sequence[str], column: str, only_changed: bool = False) -> DataFrame:
    """``column`` taken from matching new rows, kept elsewhere."""
    n = new.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(column).alias("__new")).dropDuplicates([f"__{k}" for k in keys])
    j = base.join(n, reduce(lambda x, y: x & y, [base[k] == n[f"__{k}"] for k in keys]), "left")
    value = F.coalesce(F.col("__new"), base[column])
    if only_changed:
        j = j.where(~value.eqNullSafe(base[column]))
    return j.select(*[value.alias(c) if c == column else base[c] for c in base.columns])


def delete_keys(base: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base rows whose key isn't in the scope."""
    return base.join(scope.select(*keys).distinct(), list(keys), "left_anti")


def replace_scope(base: DataFrame, in_scope: Column, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the scope go, new rows whose key isn't kept come in."""
    return insert_ignore(base.where(~F.coalesce(in_scope, F.lit(False))), new, keys)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (n, total): equal for equal multisets of rows, whatever their order.

    ``total`` adds up two independent 64-bit hashes per row as decimals.
    """
    cols = [F.col(c) for c in (columns or sorted(df.columns))]
    two = [F.xxhash64(*cols), F.xxhash64(F.lit("2"), *reversed(cols))]
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"sum{i}") for i, h in enumerate(two)])


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    """Whether two relations hold the same rows equally often: two rows to the driver."""
    cols = sorted(a.columns)
    return sorted(b.columns) == cols and fingerprint(a, cols).first() == fingerprint(b, cols).first()


def restore(spark: SparkSession, path: str) -> None:
    """Bring a table back that a writer left between its two renames.

    The new copy takes its place if it was written to the end, else the old one;
    what is left over of a finished swap goes.
    """
    fresh, old = path.rstrip("/") + ".next", path.rstrip("/") + ".old"
    if files.exists(spark, path):
        files.remove(spark, old)
    elif files.exists(spark, old):
        whole = files.exists(spark, f"{fresh}/_SUCCESS")
        files.move(spark, fresh if whole else old, path)
        files.remove(spark, old)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of ``write_if_changed``; None only where nothing was ever written."""
    restore(spark, path)
    return spark.read.parquet(path) if files.exists(spark, path) else None


def write_if_changed(new: DataFrame, path: str) -> bool:
    """Write a relation unless the folder already holds the same; into a new folder, then swapped.

    Returns whether it wrote. One writer at a time. The swap is two renames; a
    reader in between finds no table (never half of one), and a writer that
    stops in between leaves both copies, of which ``restore`` makes one again.
    """
    spark = new.sparkSession
    held = read_table(spark, path)
    if held is not None and same_multiset(new, held):
        return False
    fresh, old = path.rstrip("/") + ".next", path.rstrip("/") + ".old"
    new.write.mode("overwrite").parquet(fresh)
    if held is not None:
        files.move(spark, path, old)
    files.move(spark, fresh, path)
    files.remove(spark, old)
    return True


def latest_per_key(log: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by an order made total."""
    return log.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
