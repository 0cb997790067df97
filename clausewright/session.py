"""Session helpers: builder for tests, code shipping, lineage cuts."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "spark.clausewright.shipped"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("clausewright")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    A cluster's executors need not have the package installed: its sources go
    out as a zip (some 100 kB) through the driver's file server.
    """
    sc = spark.sparkContext
    if sc.getLocalProperty(_SHIPPED) or getattr(sc, "_clausewright_shipped", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    folder = tempfile.mkdtemp(prefix="clausewright-")
    path = os.path.join(folder, "clausewright_src.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._clausewright_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests on one machine) a local one is made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="clausewright-checkpoint-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of executors.

    Never ``localCheckpoint``, whose only copy lies on one executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def drop_shuffles(df: DataFrame) -> None:
    """Remove the shuffle files from which a checkpoint was made; ``df`` is what was given to ``cut_lineage``.

    Without this they stay until the driver happens to collect its garbage.
    """
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files are removed as soon as it has ended, as by ``drop_shuffles``, also those of writes."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)


#: Inputs up to so many bytes (as the plan estimates them) may be spread over the cores.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give Python work enough tasks where a small input has fewer splits than cores.

    An input of more than ``SPREAD_BYTES`` passes as it is, unshuffled, whatever
    the number of cores, and its plan isn't touched.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores, *keys)
