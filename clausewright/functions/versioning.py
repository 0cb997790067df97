"""Release and version order as columns (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def version_part(version: Column | str, n: int) -> Column:
    """Part ``n`` (from 1) of a dotted version as a number; 0 where it isn't one."""
    return F.coalesce(F.split_part(col(version), F.lit("."), F.lit(n)).try_cast("int"), F.lit(0))


def version_key(version: Column | str) -> Column:
    """Struct of the first three numbers; compares and sorts as versions do."""
    return F.struct(*[version_part(version, n).alias(f"v{n}") for n in (1, 2, 3)])


def release_ordinal(release: Column | str) -> Column:
    """Recency of a release label: Rel-99 is 3, Rel-4 and later their number, else -1."""
    r = col(release)
    number = F.regexp_extract(r, r"^Rel-([0-9]+)$", 1).try_cast("int")
    return F.when(r == "Rel-99", 3).when(number >= 4, number).otherwise(-1)


def release_major(release: Column | str) -> Column:
    """Version major a release label stands for; bare numbers and any case pass, else null."""
    number = F.regexp_extract(F.lower(F.trim(col(release))), r"^(?:rel-)?([0-9]+)$", 1).try_cast("int")
    return F.when(number == 99, 3).otherwise(number)


def release_of_major(major: Column | str) -> Column:
    """The release label of a version major: 3 is Rel-99, 4 and later Rel-n, else null."""
    m = col(major)
    return F.when(m == 3, "Rel-99").when(m >= 4, F.concat(F.lit("Rel-"), m.cast("string")))


def is_stable(spec_id: Column | str, version: Column | str) -> Column:
    """Stable: major 3 or more; of ETSI deliverables any x.y.z version."""
    return F.when(is_etsi(spec_id), col(version).rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$")).otherwise(version_part(version, 1) >= 3)


def is_etsi(spec_id: Column | str) -> Column:
    return F.upper(F.trim(col(spec_id))).startswith("ETSI")
