"""The tools: each a function of a corpus that gives a DataFrame.

A corpus is a folder of tables (see ``sources.tables``). Nothing is computed
until the result is used; filters reach the scan.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .functions import versioning as V
from .operators import glossary as G
from .operators import lineage as L
from .retrieval import index as I
from .retrieval import search as S
from .session import checkpoint_dir
from .sources.tables import table


class Corpus:
    """Tools over one corpus folder."""

    def __init__(self, spark: SparkSession, directory: str, index_path: str | None = None) -> None:
        self.spark, self.directory, self.index_path, self._ready = spark, directory, index_path, False

    def table(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.directory, name, *columns)

    def index(self) -> I.SearchIndex:
        """The corpus' stored search index, brought up to date with its tables."""
        path = self.index_path or f"{checkpoint_dir(self.spark)}/index-{hashlib.sha1(self.directory.encode()).hexdigest()[:16]}"
        if not self._ready:
            I.extend_index(self.table("clauses"), self.table("clause_sparse"), path)
            self._ready = True
        return I.open_index(self.spark, path)

    def search_spec(self, query: str, release: str | None = None, spec_id: str | None = None, k: int = 10, mode: str = "hybrid", rerank: bool = True, cursor: str = "", vector: list[float] | None = None) -> S.Page:
        """One page of hits with the cursor of the next (empty on the last) and the report of the arms.

        A free text has no sparse vector, so the sparse arm gives nothing for it
        unless the corpus' ``search_queries`` holds the text; the dense arm
        serves where a ``vector`` comes with the query. A cursor of another
        query, filter or mode is refused.
        """
        parts = (query, release or "", spec_id or "", mode, str(rerank))
        offset = S.read_cursor(cursor, *parts) if cursor else 0
        known = self.table("search_queries").where(F.col("query_text") == query).select("query_id").limit(1)
        queries = self.spark.createDataFrame([(0, query)], "query_id long, query_text string")
        terms = None if known.isEmpty() else self.table("query_terms").join(known, "query_id", "left_semi").withColumn("query_id", F.lit(0).cast("long"))
        vectors = self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, x array<double>") if vector else None
        # one hit more than the page tells whether pages follow
        request = S.SearchRequest(k=offset + k + 1, mode=mode, rerank=rerank, release=release, spec_id=spec_id)
        hits = S.search_spec(self.index(), queries, terms, vectors, request)
        more = hits.where(F.col("rank") > offset + k)
        rows = hits.where((F.col("rank") > offset) & (F.col("rank") <= offset + k)).drop("query_id")
        return S.Page(rows, "" if more.isEmpty() else S.write_cursor(offset + k, *parts), request.report)

    def get_spec(self, spec_id: str, release: str | None = None, version: str | None = None, clause: str | None = None) -> DataFrame:
        """Clauses of a spec in order, by default of its latest (stable) version, with citations."""
        rows = self.table("clauses").where(F.col("spec_id") == spec_id)
        if release:
            rows = rows.where(F.col("release") == release)
        if version:
            rows = rows.where(F.col("version") == version)
        else:
            latest = rows.groupBy("spec_id").agg(F.max_by("version", F.struct(V.is_stable("spec_id", "version").alias("s"), V.version_key("version").alias("v"))).alias("version"))
            rows = rows.join(latest, ["spec_id", "version"], "left_semi")
        rows = L.one_filing(rows)
        if clause:
            rows = rows.where((F.col("clause_path") == clause) | F.col("clause_path").startswith(clause + "."))
        w = Window.partitionBy("spec_id").orderBy(F.length("clause_path"), "clause_path", "chunk_id")
        return rows.select("chunk_id", "spec_id", "release", "version", "clause_path", "heading", "text", "is_normative", X.resource_uri("spec_id", "release", "clause_path", "version").alias("resource")).withColumn("place", F.row_number().over(w))

    def list_specs(self, release: str | None = None, series: str | None = None, working_group: str | None = None, doc_type: str | None = None) -> DataFrame:
        """Specs with their latest version; doc_type defaults to TS, any/all/* lift it."""
        rows = self.table("specs")
        kind = (doc_type or "TS").upper()
        if kind not in ("ANY", "ALL", "*"):
            rows = rows.where(F.coalesce(F.nullif(F.upper(F.trim("doc_type")), F.lit("")), F.lit("TS")) == kind)
        if series:
            rows = rows.where(F.col("series") == series)
        if working_group:
            rows = rows.where(F.upper(F.trim("working_group")) == working_group.upper())
        versions = self.table("spec_versions")
        if release:
            versions = versions.where(F.col("release") == release)
        key = F.struct(V.is_stable("spec_id", "version").alias("s"), V.version_key("version").alias("v"))
        return rows.join(versions.groupBy("spec_id").agg(F.max_by("version", key).alias("latest")), "spec_id")

    def list_releases(self, spec_id: str) -> DataFrame:
        """Filings of a spec, newest first."""
        order = [V.release_ordinal("release").desc(), V.version_key("version").desc(), F.desc_nulls_last("freeze_date")]
        return self.table("spec_versions").where(F.col("spec_id") == spec_id).orderBy(*order)

    def trace_clause(self, spec_id: str, clause: str, from_point: str | None = None, to_point: str | None = None) -> DataFrame:
        """Lineage of a clause's paragraphs, or what changed between two points of its axis."""
        rows = self.table("clauses", "chunk_id", "spec_id", "release", "version", "clause_path", "text").where((F.col("spec_id") == spec_id) & (F.col("clause_path") == clause))
        if not (from_point and to_point):
            return L.paragraph_lineage(rows)
        at = lambda p: (F.col("release") == p) | (F.col("version") == p)
        for p in (from_point, to_point):
            if rows.where(at(p)).isEmpty():
                raise ValueError(f"{spec_id} clause {clause} has no text at {p}")
        return L.paragraph_delta(rows, at(from_point), at(to_point))

    def get_changelog(self, spec_id: str, from_bound: str = "", to_bound: str = "", limit: int = 100) -> DataFrame:
        """Changes of the spec's clauses between consecutive versions, within bounds."""
        from .plans.diffs import clean_path, same_text
        from .operators.snapshots import snapshot_changes

        rows = self.table("clauses", "chunk_id", "spec_id", "version", "clause_path", "text").where(F.col("spec_id") == spec_id)
        changes = snapshot_changes(rows, "spec_id", "version", clean_path(F.col("clause_path")), {"text": same_text(F.col("text"))}, [V.version_part("v", n) for n in (1, 2, 3)], "chunk_id")
        for text, low in ((from_bound, True), (to_bound, False)):
            kind, value = S.parse_bound(text)
            if kind == "invalid":
                raise ValueError(f"not a release or version: {text!r}")
            if kind == "version":
                parts = [int(p) for p in (value + ".0").split(".")[:3]]
                bound = F.struct(*[F.lit(p).alias(f"v{i + 1}") for i, p in enumerate(parts)])
                changes = changes.where(V.version_key("to_version") >= bound if low else V.version_key("to_version") <= bound)
            elif kind == "release":
                major = V.release_major(F.lit(value))
                changes = changes.where(V.version_part("to_version", 1) >= major if low else V.version_part("to_version", 1) <= major)
        return changes.orderBy(V.version_key("to_version"), "key", "change_kind").limit(min(limit, 500))

    def resolve_term(self, term: str) -> DataFrame:
        """Expansions of a term from the abbreviation lines of all clauses, by authority."""
        from .mining.rows import abbreviations

        clauses = self.table("clauses", "chunk_id", "spec_id", "text").where(F.contains(F.lower("text"), F.lit(term.lower())))
        found = abbreviations(clauses, "chunk_id", "text").where(F.lower("term") == term.lower())
        entries = found.join(clauses.select("chunk_id", "spec_id"), "chunk_id").groupBy("term", "expansion").agg(F.countDistinct("spec_id").alias("declared_by"), F.min("spec_id").alias("source_series"))
        return G.authority_order(entries.withColumn("domain", F.lit(""))).orderBy("place")

    def find_cross_references(self, spec_id: str, clause: str | None = None) -> DataFrame:
        """Clauses that a spec's clauses refer to, with the spec's clause they resolve to."""
        rows = self.table("clauses", "chunk_id", "spec_id", "version", "clause_path", "text").where(F.col("spec_id") == spec_id)
        own = rows.where((F.col("clause_path") == clause) | F.col("clause_path").startswith(clause + ".")) if clause else rows
        refs = own.select("chunk_id", "spec_id", "version", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"clause ([0-9]+(\.[0-9]+)*)"), F.lit(1)))).alias("ref"))
        targets = rows.groupBy("spec_id", "version", F.col("clause_path").alias("ref")).agg(F.min("chunk_id").alias("target"))
        return refs.join(targets, ["spec_id", "version", "ref"], "left")

    def server_info(self) -> DataFrame:
        """(key, value): sizes and what the corpus can serve."""
        c = self.table("clauses", "release", "spec_id", "embedding", "text").agg(
            F.count(F.lit(1)).alias("clauses"), F.countDistinct("spec_id").alias("specs"), F.countDistinct("release").alias("releases"),
            F.count_if(F.col("embedding").isNotNull()).alias("vectors"), F.count_if(X.has_text("text") & F.col("embedding").isNull()).alias("pending"),
        )
        return c.unpivot([], ["clauses", "specs", "releases", "vectors", "pending"], "key", "value")
