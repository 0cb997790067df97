"""Reading the tables of one corpus directory."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import fingerprint
from .files import exists

#: Tables that a corpus directory may hold, one Parquet file or folder each.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "specs spec_versions releases clauses clause_sparse ingest_log hit_out "
    "search_queries query_terms eval_items"
).split()


def table(spark: SparkSession, directory: str, name: str, *columns: str | Column) -> DataFrame:
    """One table of ``directory``; ``columns`` narrows the scan at the source."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Columns of the tables that this package writes; a corpus may have more.
SCHEMAS = {
    "specs": "spec_id string, series string, title string, doc_type string, working_group string",
    "spec_versions": "spec_id string, release string, version string, freeze_date date, docx_url string, status string, metadata_source string",
    "releases": "code string, name string, status string, start_date date, freeze_date date, freeze_meeting string",
    "clauses": "chunk_id long, spec_id string, release string, version string, clause_path string, heading string, text string, is_normative boolean, embedding array<float>, embedding_hash string",
    "clause_sparse": "chunk_id long, term_id long, weight float",
    "ingest_log": "spec_id string, version string, status string, pipeline_version string, started_at timestamp, completed_at timestamp",
    "meta": "key string, value string",
}
SCHEMA_VERSION = "1"


def prepare(spark: SparkSession, directory: str) -> list[str]:
    """Create the tables that a corpus lacks, empty, and stamp a new one; names of those made.
    Doing it again makes none."""
    made = []
    for name, schema in SCHEMAS.items():
        path = f"{directory}/{name}.parquet"
        if not exists(spark, path):
            rows = [("schema_version", SCHEMA_VERSION)] if name == "meta" else []
            spark.createDataFrame(rows, schema).write.parquet(path)
            made.append(name)
    return made


def capabilities(spark: SparkSession, directory: str) -> dict[str, bool]:
    """What a corpus can serve, from its files and columns alone; warns of another schema version."""
    has = {n: exists(spark, f"{directory}/{n}.parquet") for n in TABLES}
    some = lambda n, c=None: has[n] and (c is None or c in table(spark, directory, n).columns) and not table(spark, directory, n).where(F.col(c).isNotNull() if c else F.lit(True)).isEmpty()
    if exists(spark, f"{directory}/meta.parquet"):
        stamp = table(spark, directory, "meta").where("key = 'schema_version'").agg(F.max("value")).first()[0]
        if stamp != SCHEMA_VERSION:
            warnings.warn(f"the corpus has schema version {stamp}, this package reads {SCHEMA_VERSION}", stacklevel=2)
    return {"clauses": some("clauses"), "sparse": some("clause_sparse"), "dense": some("clauses", "embedding"), "queries": some("search_queries"), "changelog": some("ingest_log")}


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table in one job, which is seen as a whole or not at all by readers of its mark."""
    df.write.mode("append").parquet(path)


def compact(spark: SparkSession, source: str, target: str, file_rows: int = 2_000_000, order: str = "chunk_id") -> DataFrame:
    """Write a table anew in few sorted files and make sure that it holds the same.

    Columns go by name. Returns the copy; rows that differ in number or content
    from the source's are an error, and the copy then isn't to be used.
    """
    rows = spark.read.parquet(source)
    n = rows.count()
    ranged = rows.repartitionByRange(max(1, -(-n // file_rows)), order).sortWithinPartitions(order)
    ranged.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(target)
    copy = spark.read.parquet(target)
    columns = [c for c, kind in rows.dtypes if not kind.startswith("map")]
    if fingerprint(rows, columns).first() != fingerprint(copy, columns).first():
        raise ValueError(f"{target} doesn't hold what {source} does")
    return copy
