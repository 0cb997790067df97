"""How clauses and paragraphs evolve along a document's axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versioning as V


def lineage_axis(clauses: DataFrame) -> DataFrame:
    """(spec_id, axis): release if the spec has several, else version if several, else release."""
    n = clauses.groupBy("spec_id").agg(F.countDistinct("release").alias("r"), F.countDistinct("version").alias("v"))
    return n.select("spec_id", F.when(F.col("r") > 1, "release").when(F.col("v") > 1, "version").otherwise("release").alias("axis"))


def axis_points(clauses: DataFrame) -> DataFrame:
    """(spec_id, axis, point, place): the points of each spec's axis in order, from 1.

    Only points that have text count, so ``newest`` (the last place) is the
    newest with text.
    """
    axis = lineage_axis(clauses)
    both = clauses.select("spec_id", "release", "version").distinct().join(axis, "spec_id")
    point = both.select("spec_id", "axis", F.when(F.col("axis") == "release", F.col("release")).otherwise(F.col("version")).alias("point")).where("point is not null").distinct()
    order = F.when(F.col("axis") == "release", F.struct(V.release_ordinal("point").alias("v1"), F.lit(0).alias("v2"), F.lit(0).alias("v3"))).otherwise(V.version_key("point"))
    w = Window.partitionBy("spec_id")
    return point.withColumn("place", F.row_number().over(w.orderBy(order, "point"))).withColumn("newest", F.count(F.lit(1)).over(w))


def on_axis(clauses: DataFrame, points: DataFrame) -> DataFrame:
    """Clauses with their axis place: joined once per axis, each by its own column."""
    r = points.where("axis = 'release'").select("spec_id", F.col("point").alias("release"), "point", "place", "newest")
    v = points.where("axis = 'version'").select("spec_id", F.col("point").alias("version"), "point", "place", "newest")
    return clauses.join(r, ["spec_id", "release"]).unionByName(clauses.join(v, ["spec_id", "version"]))


def presence(rows: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """present_in, introduced, last_seen and obsolete of each key of rows on an axis."""
    seen = F.array_sort(F.collect_set(F.struct("place", "point")))
    g = rows.groupBy(*keys).agg(seen.alias("s"), F.max("newest").alias("newest"), *extra)
    last = F.element_at("s", -1)
    return g.select(
        *keys, F.transform("s", lambda x: x["point"]).alias("present_in"), F.element_at("s", 1)["point"].alias("introduced"),
        last["point"].alias("last_seen"), (last["place"] < F.col("newest")).alias("obsolete"), *[c for c in g.columns if c not in {*keys, "s", "newest"}],
    )


def clause_lineage(clauses: DataFrame) -> DataFrame:
    """Lineage of every clause path of every spec; rows without a path are left out."""
    rows = on_axis(clauses.where("clause_path <> ''"), axis_points(clauses))
    return presence(rows, ["spec_id", "clause_path"], F.max("heading").alias("heading"))


def paragraph_lineage(clauses: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Lineage of every paragraph of every clause path, with its first place in the text."""
    rows = on_axis(clauses.where("clause_path <> '' and text is not null"), axis_points(clauses))
    parts = rows.select("spec_id", "clause_path", "place", "point", "newest", F.posexplode(F.split("text", f"\\Q{separator}\\E", -1)).alias("ord", "part")).where("part <> ''")
    return presence(parts, ["spec_id", "clause_path", "part"], F.min("ord").alias("first_ord"))


def paragraph_delta(clauses: DataFrame, left: Column, right: Column, separator: str = "\n\n") -> DataFrame:
    """Paragraphs of each (spec, path) on the left, the right or both sides.

    left, right: predicates that pick the two points. Paragraphs compare as
    (text, position), so one that moved is removed and added.
    """
    def side(p: Column, name: str) -> DataFrame:
        rows = clauses.where(p & (F.col("clause_path") != "") & F.col("text").isNotNull())
        return rows.select("spec_id", "clause_path", F.posexplode(F.split("text", f"\\Q{separator}\\E", -1)).alias("ord", "part")).distinct().withColumn(name, F.lit(True))

    a, b = side(left, "in_a"), side(right, "in_b")
    j = a.join(b, ["spec_id", "clause_path", "ord", "part"], "full_outer")
    return j.select("spec_id", "clause_path", "ord", "part", F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("kept").alias("side"))


def release_view(lineage: DataFrame, points: DataFrame, baseline: str) -> DataFrame:
    """Each clause as seen from a baseline release of its spec.

    in_baseline; new_in_baseline (there, but not at the point before);
    added_later (earliest later point if absent); removed_before (seen only
    before). Specs without the baseline on their axis give no rows.
    """
    own = points.where((F.col("axis") == "release") & (F.col("point") == baseline)).select("spec_id", F.col("place").alias("at"))
    before = points.select(F.col("spec_id").alias("s2"), (F.col("place") + 1).alias("p2"), F.col("point").alias("previous"))
    base = own.join(before, (F.col("spec_id") == F.col("s2")) & (F.col("at") == F.col("p2")), "left").select("spec_id", "at", "previous")
    rows = lineage.join(base, "spec_id")
    here = F.array_contains("present_in", baseline)
    exploded = lineage.select("spec_id", "clause_path", F.explode("present_in").alias("point")).join(points.select("spec_id", "point", "place"), ["spec_id", "point"]).join(base.select("spec_id", "at"), "spec_id")
    after = exploded.where(F.col("place") > F.col("at")).groupBy("spec_id", "clause_path").agg(F.min_by("point", "place").alias("first_later"))
    return rows.join(after, ["spec_id", "clause_path"], "left").select(
        "spec_id", "clause_path", here.alias("in_baseline"),
        (here & ~F.coalesce(F.array_contains("present_in", F.col("previous")), F.lit(False))).alias("new_in_baseline"),
        F.when(~here, F.col("first_later")).alias("added_later"),
        (~here & F.col("first_later").isNull()).alias("removed_before"),
    )


def one_filing(clauses: DataFrame) -> DataFrame:
    """Clauses with each version served under one release where its filings hold the same.

    A version filed under several releases with equal multisets of (path, text)
    is kept under the release of its own major, else the newest; filings that
    differ all stay.
    """
    h = [F.xxhash64(F.coalesce("clause_path", F.lit("")), F.coalesce(F.md5("text"), F.lit("")), F.lit(i)).cast("decimal(38,0)") for i in (1, 2)]
    filings = clauses.groupBy("spec_id", "version", "release").agg(F.count(F.lit(1)).alias("n"), F.sum(h[0]).alias("s1"), F.sum(h[1]).alias("s2"))
    own = F.when(V.release_major("release") == V.version_part("version", 1), 1).otherwise(0)
    keep = filings.groupBy("spec_id", "version").agg(
        F.countDistinct(F.struct("n", "s1", "s2")).alias("kinds"),
        F.max_by("release", F.struct(own.alias("o"), V.release_ordinal("release").alias("r"), F.col("release").alias("l"))).alias("kept"),
    )
    return clauses.join(keep, ["spec_id", "version"]).where((F.col("kinds") > 1) | F.col("release").eqNullSafe(F.col("kept"))).drop("kinds", "kept")


def refile_plan(versions: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Filings under a foreign release, with what to do: (spec_id, release, version, target, verdict).

    A filing whose release's major isn't the version's moves to its own
    release if the spec has that release, no copy of the version is there and
    the filing has text; of several claims to one place the first by release
    moves. Drafts (major below 3) aren't candidates.
    """
    v = versions.select("spec_id", "release", "version").distinct().withColumn("major", V.version_part("version", 1))
    cand = v.where((F.col("major") >= 3) & V.release_major("release").isNotNull() & (V.release_major("release") != F.col("major"))).withColumn("target", V.release_of_major("major"))
    homes = v.select("spec_id", F.col("release").alias("target")).distinct().withColumn("has_home", F.lit(True))
    copies = v.select("spec_id", F.col("release").alias("target"), "version").withColumn("has_copy", F.lit(True))
    text = occurrences.select("spec_id", "release", "version").distinct().withColumn("has_text", F.lit(True))
    j = cand.join(homes, ["spec_id", "target"], "left").join(copies, ["spec_id", "target", "version"], "left").join(text, ["spec_id", "release", "version"], "left")
    verdict = F.when(F.col("has_home").isNull(), "no own release").when(F.col("has_copy"), "copy there").when(F.col("has_text").isNull(), "no text").otherwise("move")
    w = Window.partitionBy("spec_id", "target", "version", "verdict").orderBy("release")
    return j.withColumn("verdict", verdict).withColumn("n", F.row_number().over(w)).select("spec_id", "release", "version", "target", F.when((F.col("verdict") == "move") & (F.col("n") > 1), "claimed").otherwise(F.col("verdict")).alias("verdict"))
