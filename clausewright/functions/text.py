"""Scalar functions over texts, ids and vectors (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .versioning import col, is_etsi, version_part


def tokens(text: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def like_tokens(query: Column | str) -> Column:
    """Tokens of a keyword query: two characters or more, distinct, the first twelve;
    the whole text where none is left."""
    few = F.slice(F.array_distinct(F.filter(tokens(query), lambda t: F.length(t) >= 2)), 1, 12)
    return F.when(F.size(few) > 0, few).otherwise(F.array(F.lower(col(query))))


def rerank_tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and decimal digits of any script."""
    parts = F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{Nd}]+")
    return F.filter(parts, lambda t: t != "")


def collapse(text: Column | str) -> Column:
    """NBSP and line ends as blanks, runs as one, none at the ends."""
    return F.trim(F.regexp_replace(col(text), "[ \\t\\r\\n\\u00A0]+", " "))


def has_text(text: Column | str) -> Column:
    return F.length(F.trim(col(text))) > 0


def content_hash(heading: Column | str, text: Column | str, model: str) -> Column:
    """Identity of an embedded body: 16 hex digits over heading, text and model."""
    return F.substring(F.sha2(F.concat(F.coalesce(col(heading), F.lit("")), F.lit("\n"), F.coalesce(col(text), F.lit("")), F.lit("|" + model)), 256), 1, 16)


def identity_digest(*parts: Column | str) -> Column:
    """12 hex digits over parts joined by '|'."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 12)


def hash_shard(hex_hash: Column | str, shards: int) -> Column:
    """Shard of a hex hash: its first 16 digits as an unsigned number, modulo ``shards``.

    The upper and lower half are reduced apart, as an unsigned 64-bit number
    doesn't fit a long.
    """
    high = F.conv(F.substring(col(hex_hash), 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(col(hex_hash), 9, 8), 16, 10).cast("long")
    return ((high % shards) * ((1 << 32) % shards) + low % shards) % shards


def windows(text: Column | str, size: int) -> Column:
    """A text in windows of at most ``size`` words; a text within it untouched."""
    t = F.coalesce(col(text), F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(size))
    return F.when(F.size(words) <= size, F.array(t)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " ")))


def snippet(text: Column | str, size: int = 400) -> Column:
    """The trimmed text, cut after ``size`` characters with an ellipsis."""
    t = F.trim(F.coalesce(col(text), F.lit("")))
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("…"))).otherwise(t)


def series_of(spec_id: Column | str) -> Column:
    return F.when(is_etsi(spec_id), F.lit("ETSI")).otherwise(F.split_part(col(spec_id), F.lit("."), F.lit(1)))


def version_code(version: Column | str) -> Column:
    """Three base-36 digits of a version, or six decimal ones where a part exceeds 35."""
    parts = [version_part(version, n) for n in (1, 2, 3)]
    small = F.concat(*[F.lower(F.conv(p.cast("string"), 10, 36)) for p in parts])
    large = F.concat(*[F.lpad(p.cast("string"), 2, "0") for p in parts])
    return F.when(F.greatest(*parts) <= 35, small).otherwise(large)


def version_of_code(code: Column | str) -> Column:
    """The version of a three-digit base-36 or six-digit decimal code, else null."""
    c = F.lower(col(code))
    three = F.concat_ws(".", *[F.conv(F.substring(c, i, 1), 36, 10) for i in (1, 2, 3)])
    six = F.concat_ws(".", *[F.substring(c, i, 2).try_cast("int").cast("string") for i in (1, 3, 5)])
    return F.when(c.rlike("^[0-9a-z]{3}$"), three).when(c.rlike("^[0-9]{6}$"), six)


def archive_url(spec_id: Column | str, version: Column | str) -> Column:
    """Where the archive keeps a version of a spec: series folder, spec folder, coded file."""
    plain = F.replace(col(spec_id), F.lit("."), F.lit(""))
    return F.concat(F.lit("https://www.3gpp.org/ftp/Specs/archive/"), series_of(spec_id), F.lit("_series/"), col(spec_id), F.lit("/"), plain, F.lit("-"), version_code(version), F.lit(".zip"))


def resource_uri(spec_id: Column | str, release: Column | str, clause: Column | str, version: Column | str) -> Column:
    """3gpp://spec/release[/clause][@version] with blanks and percent signs escaped."""
    esc = lambda c: F.replace(F.replace(F.coalesce(col(c), F.lit("")), F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    tail = F.when(F.coalesce(col(clause), F.lit("")) != "", F.concat(F.lit("/"), esc(clause))).otherwise("")
    return F.concat(F.lit("3gpp://"), esc(spec_id), F.lit("/"), esc(release), tail, F.when(F.coalesce(col(version), F.lit("")) != "", F.concat(F.lit("@"), esc(version))).otherwise(""))


def token_fraction(needles: Column, text: Column | str) -> Column:
    """Share of tokens that the lower-case text contains."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    return F.when(F.size(needles) > 0, F.size(F.filter(needles, lambda n: t.contains(n))) / F.size(needles)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def clean_vector(v: Column, dim: int) -> Column:
    """Vectors of ``dim`` finite numbers, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)


def deliverable_of_token(token: Column | str) -> Column:
    """103 221-1 for the number token 10322101: six digits, then two for each part; else null."""
    t = col(token)
    parts = F.transform(F.sequence(F.lit(0), F.greatest((F.length(t) - 6) / 2, F.lit(0)).cast("int")), lambda i: F.when(i > 0, F.concat(F.lit("-"), t.substr(i * 2 + 5, F.lit(2)).cast("int").cast("string"))).otherwise(""))
    return F.when(t.rlike(r"^[0-9]{6}([0-9]{2})*$"), F.concat(F.substring(t, 1, 3), F.lit(" "), F.substring(t, 4, 3), F.array_join(parts, "")))


def republished(deliverable: Column | str) -> Column:
    """Whether a deliverable (1nn nnn[-p]) republishes a spec: those of series 21-38 and 41-55
    stand under 100 more."""
    series = F.regexp_extract(F.regexp_replace(col(deliverable), " ", ""), "^([0-9]{3})[0-9]{3}", 1).try_cast("int") - 100
    return F.coalesce(series.between(21, 38) | series.between(41, 55), F.lit(False))
