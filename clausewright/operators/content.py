"""Content addressing: distinct paragraphs and bodies, and texts rebuilt from them.

Ids are derived from content (two 64-bit hashes of the text), so tables built
apart can be united without renumbering.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\n\n"


@dataclass(frozen=True)
class Content:
    paragraphs: DataFrame  # para_id, part
    bodies: DataFrame  # body_id, heading, n_parts, embedding
    body_seq: DataFrame  # body_id, ord, para_id
    occurrences: DataFrame  # chunk_id, spec_id, release, version, clause_path, is_normative, body_id


def content_id(*parts: Column) -> Column:
    """Id of content: 32 hex digits of its SHA-256. Each part goes in after its length
    (-1 for null), so neither nulls and empty texts nor neighbouring parts mix."""
    tagged = [x for p in parts for x in (F.coalesce(F.length(p), F.lit(-1)).cast("string"), F.coalesce(p, F.lit("")))]
    return F.substring(F.sha2(F.concat_ws("|", *tagged), 256), 1, 32)


def content_tables(clauses: DataFrame, separator: str = SEPARATOR) -> Content:
    """Split clauses into paragraphs, bodies, their sequence and occurrences.

    Equal (heading, text) is one body, heading null-safe; null texts have no
    body. Empty parts are kept, so texts rebuild byte for byte. Of the vectors
    of a body's rows one that is there is kept (the one of the least chunk_id).
    """
    rows = clauses.where("text is not null").withColumn("body_id", content_id(F.col("heading"), F.col("text")))
    own = F.when(F.col("embedding").isNotNull(), F.struct("chunk_id", "embedding"))
    grouped = rows.groupBy("body_id").agg(F.first("heading").alias("heading"), F.first("text").alias("text"), F.min(own)["embedding"].alias("embedding"))
    parts = grouped.select("body_id", F.posexplode(F.split("text", f"\\Q{separator}\\E", -1)).alias("ord", "part")).withColumn("para_id", content_id(F.col("part")))
    return Content(
        paragraphs=parts.select("para_id", "part").dropDuplicates(["para_id"]),
        bodies=grouped.select("body_id", "heading", F.size(F.split("text", f"\\Q{separator}\\E", -1)).alias("n_parts"), "embedding"),
        body_seq=parts.select("body_id", "ord", "para_id"),
        occurrences=rows.select("chunk_id", "spec_id", "release", "version", "clause_path", "is_normative", "body_id"),
    )


def body_texts(content: Content, wanted: DataFrame | None = None, separator: str = SEPARATOR) -> DataFrame:
    """(body_id, text) rebuilt; ``wanted`` (body_id) narrows the sequence before the
    aggregation, so that few texts cost few rows."""
    seq = content.body_seq if wanted is None else content.body_seq.join(wanted.select("body_id").distinct(), "body_id", "left_semi")
    joined = seq.join(content.paragraphs, "para_id")
    return joined.groupBy("body_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]), separator).alias("text"))


def rebuilt_clauses(content: Content, separator: str = SEPARATOR) -> DataFrame:
    """The inverse: clauses with heading and text again."""
    bodies = content.bodies.select("body_id", "heading").join(body_texts(content, separator=separator), "body_id")
    return content.occurrences.join(bodies, "body_id").drop("body_id")


def verify_content(clauses: DataFrame, content: Content, separator: str = SEPARATOR) -> DataFrame:
    """One row: rows held, rows rebuilt, and those equal to the byte, null-safe."""
    held = clauses.where("text is not null").select("chunk_id", F.col("heading").alias("h0"), F.col("text").alias("t0"))
    both = held.join(rebuilt_clauses(content, separator).select("chunk_id", "heading", "text"), "chunk_id", "left")
    same = F.col("h0").eqNullSafe(F.col("heading")) & (F.col("t0") == F.col("text"))
    return both.agg(F.count(F.lit(1)).alias("held"), F.count("text").alias("rebuilt"), F.count_if(same).alias("exact"))


def refuse_to_shrink(source_rows: int, held_rows: int) -> None:
    """A rebuild from fewer rows than are held would lose some."""
    if source_rows < held_rows:
        raise ValueError(f"the source has {source_rows} rows, {held_rows} are held: not rebuilt")
