"""What changed between full snapshots (problem 4).

Method: the snapshots lie range-partitioned and sorted by entity and key, so
each range holds every version of its keys next to each other and one merge
pass sees, for each key, the versions it stands in and its compared columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_order(snapshots: DataFrame, entity: str, version: str, order: Sequence[Column]) -> DataFrame:
    """(entity, version, n, last, previous, next): each entity's versions numbered
    in order, with the last number and the neighbouring versions.

    Versions of equal order are told apart by their text.
    """
    sort = Window.partitionBy("e").orderBy(*[f"__o{i}" for i in range(len(order))], "v")
    distinct = snapshots.select(F.col(entity).alias("e"), F.col(version).alias("v")).distinct()
    keyed = distinct.select("e", "v", *[o.alias(f"__o{i}") for i, o in enumerate(order)])
    return keyed.select(
        "e", "v",
        F.row_number().over(sort).alias("n"),
        F.count(F.lit(1)).over(Window.partitionBy("e")).alias("last"),
        F.lag("v").over(sort).alias("previous"),
        F.lead("v").over(sort).alias("next"),
    )


def snapshot_changes(
    snapshots: DataFrame,
    entity: str,
    version: str,
    key: Column,
    compare: dict[str, Column],
    version_order: Sequence[Column],
    latest_by: str,
) -> DataFrame:
    """Typed changes between consecutive full snapshots of each entity.

    snapshots: rows of all snapshots; a row is of the snapshot (entity,
    version). key: the record's key, rows whose key is null or '' are left out.
    compare: named values that make a record changed; null equals null only.
    version_order: what versions sort by, columns over ``v`` (the version).
    latest_by: of rows of one key in one snapshot the largest holds (of exact
    ties any).

    Returns ``entity, key, from_version, to_version, change_kind, columns``
    (names of what changed, null for added and removed). An entity with one
    snapshot has no changes, a snapshot whose rows all lack a key still counts
    as a snapshot. Rows with a null entity or version are left out.

    One narrow row per record crosses the network twice: once to meet its
    snapshot's number, once into its range. No key's rows exceed one per
    snapshot after repeats are put away, so ranges split at any key and no
    entity, however large, sits in one task.
    """
    rows = snapshots.where(F.col(entity).isNotNull() & F.col(version).isNotNull())
    order = snapshot_order(rows, entity, version, version_order)
    own = Window.partitionBy("e", "k", "n").orderBy(F.col("by").desc())
    merge = Window.partitionBy("e", "k").orderBy("n")
    # only hashes of the compared values travel, not the values
    narrow = rows.select(
        F.col(entity).alias("e"), F.col(version).alias("v"), key.alias("k"), F.col(latest_by).alias("by"),
        *[F.sha2(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null")), 256).substr(1, 32).alias(f"c{i}") for i, c in enumerate(compare.values())],
    ).where(F.col("k") != "")
    placed = narrow.join(order, ["e", "v"]).repartitionByRange("e", "k")
    held = placed.withColumn("__own", F.row_number().over(own)).where(F.col("__own") == 1)
    before = held.withColumn("pn", F.lag("n").over(merge)).withColumn("nn", F.lead("n").over(merge))
    for i in range(len(compare)):
        before = before.withColumn(f"p{i}", F.lag(f"c{i}").over(merge))
    moved = F.filter(F.array(*[F.when(F.col(f"c{i}") != F.col(f"p{i}"), F.lit(name)) for i, name in enumerate(compare)]), lambda x: x.isNotNull())
    stays = F.col("pn") == F.col("n") - 1
    event = lambda kind, frm, to, cols: F.struct(F.lit(kind).alias("change_kind"), F.col(frm).alias("from_version"), F.col(to).alias("to_version"), cols.alias("columns"))
    none = F.lit(None).cast("array<string>")
    events = F.array(
        F.when((F.col("n") > 1) & ~F.coalesce(stays, F.lit(False)), event("added", "previous", "v", none))
        .when(stays & (F.size(moved) > 0), event("changed", "previous", "v", moved)),
        F.when((F.col("n") < F.col("last")) & ~F.coalesce(F.col("nn") == F.col("n") + 1, F.lit(False)), event("removed", "v", "next", none)),
    )
    return before.select("e", "k", F.explode(F.filter(events, lambda x: x.isNotNull())).alias("x")).select(
        F.col("e").alias(entity), F.col("k").alias("key"), "x.from_version", "x.to_version", "x.change_kind", "x.columns"
    )
