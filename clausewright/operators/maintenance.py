"""Incremental maintenance: what to redo, carry over, fold in, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import versioning as V


def changed_buckets(base: DataFrame, shard: DataFrame) -> DataFrame:
    """(spec_id, release, why) of shard buckets to fold: never seen, version moved,
    textless so far, or another number of rows (only if the shard has text)."""
    def bucket(df: DataFrame, n: str, v: str) -> DataFrame:
        return df.groupBy("spec_id", "release").agg(F.max(V.version_key("version")).alias(v), F.count_if(X.has_text("text")).alias(n))

    j = bucket(shard, "sn", "sv").join(bucket(base, "bn", "bv"), ["spec_id", "release"], "left")
    why = (
        F.when(F.col("bv").isNull(), "new")
        .when(F.col("sv") != F.col("bv"), "version")
        .when((F.col("bn") == 0) & (F.col("sn") > 0), "textless")
        .when((F.col("sn") > 0) & (F.col("sn") != F.col("bn")), "rows")
    )
    return j.withColumn("why", why).where("why is not null").select("spec_id", "release", "why")


def fold_shard(base: DataFrame, shard: DataFrame, buckets: DataFrame, content_key: list[str], vector: str) -> DataFrame:
    """The base with the buckets replaced by the shard's rows; vectors of replaced rows
    are carried over to rows of equal content that have none."""
    keys = ["spec_id", "release"]
    stay = base.join(buckets, keys, "left_anti")
    gone = base.join(buckets, keys, "left_semi").where(F.col(vector).isNotNull())
    old = gone.groupBy(*content_key).agg(F.min_by(vector, "chunk_id").alias("__old"))
    fresh = shard.join(buckets, keys, "left_semi").join(old, content_key, "left").withColumn(vector, F.coalesce(vector, "__old")).drop("__old")
    return stay.unionByName(fresh.select(*base.columns))


def worklist(clauses: DataFrame, done: DataFrame, model: str, floor: int = -1) -> DataFrame:
    """Clauses still to embed under ``model``: with text, at the floor or above, and no
    ledger line with both their id and their present content hash."""
    rows = clauses.where(X.has_text("text") & (V.release_ordinal("release") >= floor)).select("chunk_id", "release", X.content_hash("heading", "text", model).alias("hash"))
    return rows.join(done.select("chunk_id", "hash"), ["chunk_id", "hash"], "left_anti").select("chunk_id", "hash", V.release_ordinal("release").alias("ordinal"))


def delta(site: DataFrame, index: DataFrame, floor: int = -1) -> DataFrame:
    """(spec_id, release, version, held) where the site's version is newer than the index's."""
    s = site.where(V.release_ordinal("release") >= floor).groupBy("spec_id", "release").agg(F.max_by("version", V.version_key("version")).alias("version"))
    i = index.groupBy("spec_id", "release").agg(F.max_by("version", V.version_key("version")).alias("held"))
    j = s.join(i, ["spec_id", "release"], "left")
    return j.where(F.col("held").isNull() | (V.version_key("version") > V.version_key("held")))


def compare_anchors(have: DataFrame, want: DataFrame) -> DataFrame:
    """(spec_id, release, state): ok, behind, ahead, missing (wanted only) or extra (held only)."""
    h = have.groupBy("spec_id", "release").agg(F.max(V.version_key("version")).alias("h"))
    w = want.groupBy("spec_id", "release").agg(F.max(V.version_key("version")).alias("w"))
    state = F.when(F.col("h").isNull(), "missing").when(F.col("w").isNull(), "extra").when(F.col("h") < F.col("w"), "behind").when(F.col("h") > F.col("w"), "ahead").otherwise("ok")
    return h.join(w, ["spec_id", "release"], "full_outer").select("spec_id", "release", state.alias("state"))


def classify_claims(claims: DataFrame, clauses: DataFrame) -> DataFrame:
    """(spec_id, version, state) of claimed filings: indexed, overclaim (no rows at all),
    noncontent (rows, none with text)."""
    got = clauses.groupBy("spec_id", "version").agg(F.count_if(X.has_text("text")).alias("n"))
    j = claims.select("spec_id", "version").distinct().join(got, ["spec_id", "version"], "left")
    return j.select("spec_id", "version", F.when(F.col("n").isNull(), "overclaim").when(F.col("n") == 0, "noncontent").otherwise("indexed").alias("state"))


def repair_reingested(clauses: DataFrame) -> DataFrame:
    """chunk_ids of repeated rows beyond the first block of a document's rows."""
    w = Window.partitionBy("spec_id", "version", "clause_path", "heading", F.sha2("text", 256)).orderBy("chunk_id")
    return clauses.withColumn("__n", F.row_number().over(w)).where("__n > 1").select("chunk_id")


def repaired(clauses: DataFrame, postings: DataFrame, expected: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, clauses) without the repeated rows, in the order in which they must be written.

    With ``expected`` another number of repeated rows is an error: nothing is
    repaired that wasn't looked at.
    """
    gone = repair_reingested(clauses)
    if expected is not None and (n := gone.count()) != expected:
        raise ValueError(f"{n} repeated rows, {expected} were expected: not repaired")
    return postings.join(gone, "chunk_id", "left_anti"), clauses.join(gone, "chunk_id", "left_anti")


def date_changes(listed: DataFrame, versions: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """(spec_id, item, from_version, to_version, declined) of each item, by the first version that lists it.

    listed: spec_id, version, item and optionally ``strict`` (false: only a
    number seen loosely, which makes it known but doesn't date it). versions:
    spec_id, version and optionally ``has_annex``. published: spec_id, version
    of all publications. An item is changed from the version before to the one
    that lists it first. It isn't dated, and ``declined`` says why, if that is
    the first version, the one before has no annex, or a publication between
    the two isn't held. Items first seen loosely give no row.
    """
    listed = listed if "strict" in listed.columns else listed.withColumn("strict", F.lit(True))
    versions = versions if "has_annex" in versions.columns else versions.withColumn("has_annex", F.lit(True))
    w = Window.partitionBy("spec_id").orderBy("k", "version")
    held = versions.groupBy("spec_id", "version").agg(F.max("has_annex").alias("has_annex")).withColumn("k", V.version_key("version"))
    order = held.withColumn("n", F.row_number().over(w)).withColumn("previous", F.lag("version").over(w)).withColumn("annex", F.lag("has_annex").over(w)).drop("has_annex")
    if published is None:
        gaps = order.select("spec_id", "n").limit(0)
    else:
        # a publication not held lies before the held version that follows it
        lost = published.select("spec_id", "version").distinct().join(versions.select("spec_id", "version"), ["spec_id", "version"], "left_anti").withColumn("k", V.version_key("version"))
        both = order.select("spec_id", "version", "k", F.lit(1).alias("one")).unionByName(lost.withColumn("one", F.lit(0)))
        upto = Window.partitionBy("spec_id").orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        gaps = both.withColumn("n", F.sum("one").over(upto) + 1).where("one = 0 and n > 1").select("spec_id", F.col("n").cast("int").alias("n")).distinct()
    placed = listed.join(order, ["spec_id", "version"]).groupBy("spec_id", "item", "n").agg(F.max("strict").alias("strict"), F.first("version").alias("v"), F.first("previous").alias("p"), F.first("annex").alias("annex"))
    first = placed.groupBy("spec_id", "item").agg(F.min_by(F.struct("n", "v", "p", "annex", "strict"), "n").alias("x")).select("spec_id", "item", "x.*").where("strict")
    j = first.join(gaps.withColumn("gap", F.lit(True)), ["spec_id", "n"], "left")
    why = F.when(F.col("p").isNull(), "first version").when(~F.coalesce("annex", F.lit(False)), "no annex before").when(F.col("gap"), "publication missing")
    return j.select("spec_id", "item", F.when(why.isNull(), F.col("p")).alias("from_version"), F.when(why.isNull(), F.col("v")).alias("to_version"), why.alias("declined"))


def filing_release(filings: DataFrame, site: DataFrame, floor: int = -1) -> DataFrame:
    """Filings with the release they belong under (``filed``): that of the version's own major
    where it differs, the site knows it for the spec, and it isn't below the floor."""
    own = V.release_of_major(V.version_part("version", 1))
    known = site.select("spec_id", F.col("release").alias("__own")).distinct().withColumn("__known", F.lit(True))
    j = filings.withColumn("__own", own).join(known, ["spec_id", "__own"], "left")
    moves = (F.col("__own") != F.col("release")) & F.col("__known") & (V.release_ordinal("__own") >= floor)
    return j.withColumn("filed", F.when(moves, F.col("__own")).otherwise(F.col("release"))).drop("__own", "__known")


def site_diff(site: DataFrame, held: DataFrame) -> DataFrame:
    """(spec_id, version, state): published versions that are new or gone against what is held.
    A spec that the site doesn't list at all gives nothing: its page may just be missing."""
    a = site.select("spec_id", "version").distinct().withColumn("on_site", F.lit(True))
    b = held.select("spec_id", "version").distinct().withColumn("is_held", F.lit(True))
    j = a.join(b, ["spec_id", "version"], "full_outer").where("on_site is null or is_held is null")
    listed = site.select("spec_id").distinct()
    return j.join(listed, "spec_id", "left_semi").select("spec_id", "version", F.when(F.col("is_held").isNull(), "new").otherwise("gone").alias("state"))


def drift(site: DataFrame, held: DataFrame) -> DataFrame:
    """(spec_id, release, state, version): of the site's newest filings those that are missing or stale here."""
    s = site.groupBy("spec_id", "release").agg(F.max_by("version", V.version_key("version")).alias("version"))
    h = held.groupBy("spec_id", "release").agg(F.max(V.version_key("version")).alias("h"))
    state = F.when(F.col("h").isNull(), "missing").when(V.version_key("version") > F.col("h"), "stale")
    return s.join(h, ["spec_id", "release"], "left").withColumn("state", state).where("state is not null").select("spec_id", "release", "state", "version")


def same_model(*models: str | None) -> str:
    """The one model of several stamps; unlike ones can't be mixed. Empty stamps hold nothing yet."""
    known = {m for m in models if m}
    if len(known) > 1:
        raise ValueError(f"vectors of different models: {', '.join(sorted(known))}")
    return known.pop() if known else ""


def overlay_vectors(base: DataFrame, other: DataFrame, keys: list[str], column: str, base_model: str | None = None, other_model: str | None = None) -> DataFrame:
    """The base with vectors made elsewhere where it has none; keys compare null-safe."""
    same_model(base_model, other_model)
    one = other.where(F.col(column).isNotNull()).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(column).alias("__v"))
    on = [base[k].eqNullSafe(one[f"__{k}"]) for k in keys]
    joined = base.join(one, on, "left")
    return joined.select(*[F.coalesce(base[c], F.col("__v")).alias(c) if c == column else base[c] for c in base.columns])


def overlay_postings(base: DataFrame, other: DataFrame, base_model: str | None = None, other_model: str | None = None) -> DataFrame:
    """Postings of both; of a (chunk_id, term_id) in both the larger weight."""
    same_model(base_model, other_model)
    return base.select("chunk_id", "term_id", "weight").unionByName(other.select("chunk_id", "term_id", "weight")).groupBy("chunk_id", "term_id").agg(F.max("weight").alias("weight"))


def merge_shards(base: DataFrame, shards: list[DataFrame], content_key: list[str], vector: str) -> tuple[DataFrame, DataFrame]:
    """(corpus, report): shards folded in one after the other; report: shard, spec_id, release, why.

    Row ids of a shard go behind those of the base. A shard whose buckets hold
    nothing new changes nothing.
    """
    report = None
    for n, shard in enumerate(shards):
        top = base.agg(F.coalesce(F.max("chunk_id"), F.lit(-1)).alias("__top"))
        placed = shard.crossJoin(F.broadcast(top)).withColumn("chunk_id", F.col("chunk_id") + F.col("__top") + 1).drop("__top")  # one row
        why = changed_buckets(base, placed).withColumn("shard", F.lit(n))
        base = fold_shard(base, placed, why.select("spec_id", "release"), content_key, vector)
        report = why if report is None else report.unionByName(why)
    if report is None:
        raise ValueError("no shards")
    return base, report.select("shard", "spec_id", "release", "why")


def series_to_rebuild(before: DataFrame, now: DataFrame) -> DataFrame:
    """Series of which any subject's footprint changed, came or went. Both: subject, series, footprint."""
    b = before.select("subject", "series", F.col("footprint").alias("b"))
    j = b.join(now.select("subject", "series", F.col("footprint").alias("n")), ["subject", "series"], "full_outer")
    return j.where(~F.col("b").eqNullSafe(F.col("n"))).select("series").distinct()


def effective_footprints(before: DataFrame, now: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Footprints to stamp after a run that rebuilt some series: a subject's new ones hold
    only once all of its changed series are rebuilt, else its old ones stay."""
    b = before.select("subject", "series", F.col("footprint").alias("b"))
    j = b.join(now.select("subject", "series", F.col("footprint").alias("n")), ["subject", "series"], "full_outer")
    done = rebuilt.select("series").distinct().withColumn("__done", F.lit(True))
    open_ = j.where(~F.col("b").eqNullSafe(F.col("n"))).join(done, "series", "left").where("__done is null").select("subject").distinct().withColumn("__open", F.lit(True))
    out = j.join(open_, "subject", "left").withColumn("footprint", F.when(F.col("__open"), F.col("b")).otherwise(F.col("n")))
    return out.where("footprint is not null").select("subject", "series", "footprint")
