"""Streams over the same operators: incremental ingest and hourly counters.

The batch engine needs none of this; a service that receives clauses and
events continuously does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import folder_names, list_folders


def hourly_counters(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "2 hours") -> DataFrame:
    """Events per hour and kind; an hour is final once the watermark has passed it."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    w = F.window("__t", "1 hour")
    return stamped.groupBy(w, kind).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("hour"), kind, "n", "mean")


def first_seen(rows: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each key once: repeats within the watermark are dropped, state is bounded by it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


#: Buckets that a kept table is laid out in by key.
BUCKETS = 64


def keep_new(path: str, keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` that adds rows of unseen keys to a table; a batch given twice changes nothing.

    Nothing that was written is touched again: each batch has a folder of its
    own, which counts once it is whole and which a repeated batch writes anew.
    Only the key columns of the buckets that the batch's keys fall into are
    read. Of rows of one key in a batch one holds; keys compare null-safe.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch.dropDuplicates(keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rows.persist()
        try:
            held = _batches(spark, path, number)
            if held is not None:
                touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
                old = held.where(F.col("bucket").isin(touched)).select("bucket", *keys)
                same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(old[k]) for k in ["bucket", *keys]])
                new = rows.join(old, same, "left_anti")
            else:
                new = rows
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")
        finally:
            rows.unpersist()

    return run


def _batches(spark: SparkSession, path: str, but: int | None = None) -> DataFrame | None:
    """Batches written to the end, without one; None if there are none with rows."""
    names = [n for n in list_folders(spark, path) if n.startswith("batch=") and n != f"batch={but}"]
    full = [n for n in names if any(x.startswith("bucket=") for x in folder_names(spark, f"{path}/{n}"))]
    return spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in sorted(full)]) if full else None


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``keep_new`` has kept."""
    rows = _batches(spark, path)
    if rows is None:
        raise FileNotFoundError(f"no rows were kept at {path}")
    return rows.drop("bucket", "batch")
