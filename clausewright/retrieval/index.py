"""The stored search index: postings by token bucket, bodies, occurrences, vectors.

An index is a folder. Every extension adds one generation of files and, last
of all, its mark; readers take marked generations only, so an extension that
stops half-way is as if it had never begun, and running it again replaces it.
Ids are derived from content: a generation holds only paragraphs and bodies
that no earlier one has. A query reads the buckets of its own tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import versioning as V
from ..functions.text import tokens
from ..operators import content as C
from ..session import shuffles_dropped
from ..sources.files import list_folders
from .arms import K1, B, MAX_QUERY_TOKENS

#: Buckets that postings are laid out in; a query token reads one of them.
BUCKETS = 64
#: The tables and their columns, in the order of ``SearchIndex``.
TABLES = {
    "words": "token string, para_id binary, tf int, dl int, bucket int",
    "totals": "paragraphs long, words long",
    "body_parts": "body_id string, para_id binary",
    "bodies": "body_id string, heading string, text string",
    "occurrences": "chunk_id long, spec_id string, release string, version string, clause_path string, body_id string",
    "sparse": "chunk_id long, term_id long, weight double, bucket int",
    "vectors": "body_id string, chunk_id long, x array<double>",
}


def bucket_of(value: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """The tables of an index; see ``index_tables`` for their columns."""

    tokens: DataFrame
    totals: DataFrame
    body_parts: DataFrame
    bodies: DataFrame
    occurrences: DataFrame
    sparse: DataFrame
    vectors: DataFrame

    def narrowed(self, release: str | None = None, spec_id: str | None = None) -> SearchIndex:
        """The same index over the clauses of one release or spec: every arm ranks only
        those, while word statistics stay those of the whole corpus."""
        if not release and not spec_id:
            return self
        occ = self.occurrences
        if release:
            occ = occ.where(F.col("release") == release)
        if spec_id:
            occ = occ.where(F.col("spec_id") == spec_id)
        return SearchIndex(self.tokens, self.totals, self.body_parts.join(occ.select("body_id"), "body_id", "left_semi"), self.bodies, occ, self.sparse, self.vectors.join(occ.select("body_id"), "body_id", "left_semi"))


def index_tables(clauses: DataFrame, postings: DataFrame, dim: int, held: SearchIndex | None = None) -> dict[str, DataFrame]:
    """What an extension adds: words (bucket, token, para_id, tf, dl; ids of paragraphs are 16 bytes), totals
    (paragraphs, words; one row), body_parts (body_id, para_id), bodies (body_id,
    heading, text), occurrences (chunk_id and its key, body_id), sparse (bucket,
    chunk_id, term_id, weight) and vectors (body_id, chunk_id, x).

    Rows whose chunk_id is held already are left out (rows are never changed in
    place; a correction comes under a new id), null texts have no occurrence. Of a body's usable vectors that of the least chunk_id holds; of
    repeated postings the larger weight.
    """
    rows = clauses.where("text is not null").select("chunk_id", "spec_id", "release", "version", "clause_path", "heading", "text", "embedding")
    terms = postings.groupBy("chunk_id", "term_id").agg(F.max("weight").cast("double").alias("weight"))
    if held is not None:
        rows = rows.join(held.occurrences.select("chunk_id"), "chunk_id", "left_anti")
        terms = terms.join(held.sparse.select("chunk_id", "term_id"), ["chunk_id", "term_id"], "left_anti")
    rows = rows.withColumn("body_id", C.content_id(F.col("heading"), F.col("text")))
    x = F.col("embedding").cast("array<double>")
    own = F.when(X.clean_vector(x, dim), F.struct("chunk_id", x.alias("x")))
    grouped = rows.groupBy("body_id").agg(F.first("heading").alias("heading"), F.first("text").alias("text"), F.min(own).alias("v"))
    vectors = grouped.where("v is not null").select("body_id", "v.chunk_id", "v.x")
    if held is not None:
        grouped = grouped.join(held.bodies.select("body_id"), "body_id", "left_anti")
        vectors = vectors.join(held.vectors.select("body_id"), "body_id", "left_anti")
    seq = grouped.select("body_id", F.explode(F.array_distinct(F.split("text", r"\n\n", -1))).alias("part")).where("part <> ''").withColumn("para_id", F.unhex(C.content_id(F.col("part"))))
    parts = seq.groupBy("para_id").agg(F.first("part").alias("part"))
    if held is not None:
        parts = parts.join(held.body_parts.select("para_id"), "para_id", "left_anti")
    words = parts.select("para_id", tokens("part").alias("ts"))
    each = words.select("para_id", F.size("ts").alias("dl"), F.explode("ts").alias("token"))
    counted = each.groupBy("para_id", "token").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl"))
    return {
        "bodies": grouped.select("body_id", "heading", "text"),
        "body_parts": seq.select("body_id", "para_id"),
        "occurrences": rows.select("chunk_id", "spec_id", "release", "version", "clause_path", "body_id"),
        "words": counted.select(bucket_of(F.col("token")).alias("bucket"), "token", "para_id", "tf", "dl"),
        "totals": words.agg(F.count(F.lit(1)).alias("paragraphs"), F.coalesce(F.sum(F.size("ts")), F.lit(0)).alias("words")),
        "sparse": terms.select(bucket_of(F.col("term_id")).alias("bucket"), "chunk_id", "term_id", "weight"),
        "vectors": vectors,
    }


def generations(spark: SparkSession, path: str) -> list[int]:
    """Marked generations of an index, none if there is no index."""
    return sorted(int(n.removeprefix("gen=")) for n in list_folders(spark, f"{path}/marks"))


def extend_index(clauses: DataFrame, postings: DataFrame, path: str, dim: int = 64) -> bool:
    """Bring an index up to date with clauses and postings; the first call builds it.

    Returns whether there was anything to add. One writer at a time.
    """
    spark = clauses.sparkSession
    gens = generations(spark, path)
    held = open_index(spark, path) if gens else None
    tables = index_tables(clauses, postings, dim, held)
    if held is not None and tables["occurrences"].isEmpty() and tables["sparse"].isEmpty():
        return False
    gen = (gens[-1] if gens else 0) + 1
    with shuffles_dropped(spark):  # a table's shuffle files go before the next is written
        for name in TABLES:
            df = tables[name]
            if "bucket" in df.columns:
                # a bucket is one sorted file a generation; AQE splits one that is very large
                df = df.repartition("bucket").sortWithinPartitions("bucket", "token" if name == "words" else "term_id")
                df.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/gen={gen}")
            else:
                df.write.mode("overwrite").parquet(f"{path}/{name}/gen={gen}")
    spark.range(1).write.mode("overwrite").parquet(f"{path}/marks/gen={gen}")
    return True


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    """A stored index, marked generations only."""
    gens = generations(spark, path)
    if not gens:
        raise FileNotFoundError(f"no index at {path}")

    def read(name: str) -> DataFrame:
        folders = [f"{path}/{name}/gen={g}" for g in gens]
        return spark.read.schema(TABLES[name]).option("basePath", f"{path}/{name}").parquet(*folders)

    return SearchIndex(*(read(n) for n in TABLES))


def wanted(values: DataFrame, column: str, most: int = BUCKETS) -> list[int]:
    """The buckets of a relation's values: at most as many as there are buckets."""
    return [r[0] for r in values.select(bucket_of(F.col(column))).distinct().limit(most).collect()]


def paragraph_scores(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """(query_id, para_id, score): BM25 over the stored postings of the queries' tokens."""
    q = queries.select("query_id", F.explode(F.array_distinct(tokens("query_text"))).alias("token"))
    distinct = q.select("token").distinct()
    rows = q.count()  # a row per query and token, which is what would be broadcast
    small = F.broadcast if rows <= MAX_QUERY_TOKENS else (lambda x: x)
    found = index.tokens.where(F.col("bucket").isin(wanted(distinct, "token"))).drop("bucket").join(small(distinct), "token", "left_semi")
    df = found.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    stats = index.totals.agg(F.sum("paragraphs").alias("n"), (F.sum("words") / F.sum("paragraphs")).alias("avgdl"))
    idf = df.join(F.broadcast(stats)).select("token", "avgdl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))  # stats is one row
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = found.join(small(idf), "token").select("para_id", "token", part.alias("s"))
    return weighed.join(small(q), "token").groupBy("query_id", "para_id").agg(F.round(F.sum("s"), 9).alias("score"))


def newest_occurrences(index: SearchIndex) -> DataFrame:
    """Of a body's occurrences in one clause the newest: body_id, spec_id, clause_path, x, o (its order)."""
    newest = F.struct(V.version_key("version").alias("v"), (-F.col("chunk_id")).alias("c"))
    return index.occurrences.groupBy("body_id", "spec_id", "clause_path").agg(F.max_by(F.struct("chunk_id", "release", "version"), newest).alias("x"), F.max(newest).alias("o"))

