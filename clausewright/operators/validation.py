"""The data contract: named checks as one relation (name, passed, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import versioning as V
from .relations import fingerprint


def check(df: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    """One row from one aggregate; ``df`` has one row."""
    return df.select(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))


def contract(clauses: DataFrame, specs: DataFrame, versions: DataFrame, releases: DataFrame, dim: int, min_clauses: int = 1) -> DataFrame:
    """Checks over a corpus: enough clauses, unique keys, dimensions complete, vectors sound."""
    rows = clauses.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("ids"),
        F.count_if(F.col("embedding").isNotNull() & (F.size("embedding") != dim)).alias("bad_dim"),
        F.count_if(F.col("embedding").isNotNull() & F.col("embedding_hash").isNull()).alias("no_hash"),
        F.count_if(X.has_text("text") & F.col("embedding").isNull()).alias("pending"),
    )
    orphan = clauses.select("spec_id").distinct().join(specs, "spec_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    lost = versions.select(F.col("release").alias("code")).distinct().join(releases, "code", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    filed = clauses.select("spec_id", "version").distinct().join(versions, ["spec_id", "version"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
    untitled = specs.agg(F.count_if(F.coalesce(F.trim("title"), F.lit("")) == "").alias("n"))
    parts = [
        check(rows, "min-clauses", F.col("n") >= min_clauses, F.col("n")),
        check(rows, "unique-chunks", F.col("n") == F.col("ids"), F.col("n") - F.col("ids")),
        check(rows, "embedding-dim", F.col("bad_dim") == 0, F.col("bad_dim")),
        check(rows, "embedding-hash", F.col("no_hash") == 0, F.col("no_hash")),
        check(rows, "pending-zero", F.col("pending") == 0, F.col("pending")),
        check(orphan, "specs-known", F.col("n") == 0, F.col("n")),
        check(lost, "releases-known", F.col("n") == 0, F.col("n")),
        check(filed, "versions-filed", F.col("n") == 0, F.col("n")),
        check(untitled, "no-empty-title", F.col("n") == 0, F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def contract_of_halves(clauses: DataFrame, postings: DataFrame, expected_releases: list[str], models: dict[str, str], checksum: tuple | None = None, forbidden: str = "") -> DataFrame:
    """Further checks: expected releases, no document ingested twice, one hash a body,
    postings sound, both halves embedded alike and by one model, checksum, nothing that must not leave.

    models: the model stamp of each half (``3gpp``, ``etsi``). checksum: what
    ``relations.fingerprint`` gave for (chunk_id, text). forbidden: a pattern
    that no text may hold.
    """
    have = clauses.select("release").where("release is not null").distinct()
    want = clauses.sparkSession.createDataFrame([(r,) for r in expected_releases], "release string")
    differ = have.exceptAll(want).unionByName(want.exceptAll(have)).agg(F.count(F.lit(1)).alias("n"))
    body = clauses.withColumn("__t", F.md5("text"))
    twice = body.groupBy("spec_id", "version", "clause_path", "heading", "__t").agg(F.count(F.lit(1)).alias("c")).groupBy("spec_id", "version").agg(F.min("c").alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n"))
    hashes = body.where("text is not null").groupBy("heading", "__t").agg(F.countDistinct("embedding_hash").alias("h")).where("h > 1").agg(F.count(F.lit(1)).alias("n"))
    lost = postings.select("chunk_id").distinct().join(clauses, "chunk_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    bad = postings.agg(F.count_if(~(F.col("weight") > 0)).alias("n"))
    half = F.when(F.upper(F.trim("spec_id")).startswith("ETSI"), "etsi").otherwise("3gpp")
    bodies = body.where(X.has_text("text")).groupBy(half.alias("half"), "heading", "__t").agg(F.max(F.col("embedding").isNotNull()).alias("e"))
    parity = bodies.groupBy("half").agg(F.count(F.lit(1)).alias("texts"), F.count_if("e").alias("vectors")).agg(F.count_if(F.col("texts") != F.col("vectors")).alias("n"))
    stamps = {m for m in models.values() if m}
    one = clauses.sparkSession.createDataFrame([(len(stamps),)], "n long")
    leaks = clauses.agg(F.count_if(F.col("text").rlike(forbidden)).alias("n")) if forbidden else one.select(F.lit(0).alias("n"))
    zero = lambda df, name: check(df, name, F.col("n") == 0, F.col("n"))
    parts = [
        zero(differ, "expected-releases"), zero(twice, "no-reingest"), zero(hashes, "one-hash-a-body"), zero(lost, "postings-known"),
        zero(bad, "postings-positive"), zero(parity, "halves-embedded"), check(one, "one-model", F.col("n") <= 1, F.col("n")), zero(leaks, "nothing-forbidden"),
    ]
    if checksum is not None:
        now = fingerprint(clauses, ["chunk_id", "text"])
        same = (F.col("n") == checksum[0]) & (F.col("sum0") == checksum[1]) & (F.col("sum1") == checksum[2])
        parts.append(check(now, "checksum", same, F.col("sum0")))
    return reduce(DataFrame.unionByName, parts)


def index_state(now: DataFrame, stamp: DataFrame) -> DataFrame:
    """(verdict, why) of an index against its stamp; both one row: model, metric, dim, vectors.

    unusable if model, metric or dimension differ, drifted if only the number
    of vectors does, else current; an index without a stamp is unusable.
    """
    s = stamp.select(*[F.col(c).alias(f"s_{c}") for c in ("model", "metric", "dim", "vectors")])
    j = now.join(s, F.lit(True), "left")  # one row each
    why = F.array_join(F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"s_{c}")), F.lit(c)) for c in ("model", "metric", "dim", "vectors")]), lambda x: x.isNotNull()), ",")
    verdict = F.when(why == "", "current").when(why == "vectors", "drifted").otherwise("unusable")
    return j.select(verdict.alias("verdict"), why.alias("why"))


def justified_edges(edges: DataFrame, clauses: DataFrame) -> DataFrame:
    """(from_term, to_term, state): ok, missing (the cited clause isn't in the newest version
    of its spec) or unnamed (it is, but doesn't name the target as a word).

    edges: from_term, to_term, spec_id, clause. Only cited clauses are read.
    """
    newest = clauses.groupBy("spec_id").agg(F.max(V.version_key("version")).alias("__v"))
    cited = clauses.join(F.broadcast(edges.select("spec_id", F.col("clause").alias("clause_path")).distinct()), ["spec_id", "clause_path"], "left_semi")  # a curated list
    held = cited.join(newest, "spec_id").where(V.version_key("version") == F.col("__v"))
    said = held.groupBy("spec_id", F.col("clause_path").alias("clause")).agg(F.max_by(F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))), "chunk_id").alias("__t"))
    j = edges.join(said, ["spec_id", "clause"], "left")
    words = F.split(F.lower("__t"), r"[^\p{L}\p{Nd}]+")
    named = F.array_contains(words, F.lower("to_term"))
    return j.select("from_term", "to_term", F.when(F.col("__t").isNull(), "missing").when(named, "ok").otherwise("unnamed").alias("state"))


def removal_bound(rows: int) -> int:
    """Most rows that a replacement may remove: 53, or one in a hundred if that is more."""
    return max(53, rows // 100)


def mass_removal(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows before, rows removed, the bound, and whether it holds."""
    n = before.agg(F.count(F.lit(1)).alias("before"))
    gone = before.join(after, keys, "left_anti").agg(F.count(F.lit(1)).alias("removed"))
    bound = F.greatest(F.lit(53), F.floor(F.col("before") / 100)).cast("long")
    return n.crossJoin(gone).withColumn("bound", bound).withColumn("passed", F.col("removed") <= F.col("bound"))
