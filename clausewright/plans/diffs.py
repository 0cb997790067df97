"""Problem 4: what changed between consecutive versions of a spec."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.versioning import version_part
from ..operators.snapshots import snapshot_changes
from ..sources.tables import table
from .registry import Registry

registry = Registry()

#: Runs of these characters count as one blank when texts are compared.
_BLANKS = "[ \\t\\r\\n\\u00A0]+"


def clean_path(c):
    """A clause path without surrounding blanks and one trailing full stop."""
    return F.regexp_replace(F.trim(c), r"\.$", "")


def same_text(c):
    """A text as compared: blanks folded and dropped at both ends, null as ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _BLANKS, " "))


_P4 = """
with r as (
  select spec_id, version, chunk_id,
         regexp_replace(trim(clause_path), '\\.$', '') as p,
         trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n\\x{00A0}]+', ' ', 'g')) as t
  from clauses where spec_id is not null and version is not null),
v as (
  select spec_id, version,
         row_number() over w as n, count(*) over (partition by spec_id) as last,
         lag(version) over w as previous, lead(version) over w as next
  from (select distinct spec_id, version from r)
  window w as (partition by spec_id order by
    coalesce(try_cast(split_part(version, '.', 1) as int), 0),
    coalesce(try_cast(split_part(version, '.', 2) as int), 0),
    coalesce(try_cast(split_part(version, '.', 3) as int), 0), version)),
h as (
  select r.spec_id, r.version, r.p, r.t, v.n, v.last, v.previous, v.next
  from r join v using (spec_id, version) where p is not null and p <> ''
  qualify row_number() over (partition by r.spec_id, r.version, r.p order by chunk_id desc) = 1)
select a.spec_id, a.p as clause_path, a.previous as from_version, a.version as to_version,
       case when b.p is null then 'added' else 'changed' end as change_kind
from h a left join h b on b.spec_id = a.spec_id and b.p = a.p and b.n = a.n - 1
where a.n > 1 and (b.p is null or b.t <> a.t)
union all
select a.spec_id, a.p, a.version, a.next, 'removed'
from h a left join h b on b.spec_id = a.spec_id and b.p = a.p and b.n = a.n + 1
where a.n < a.last and b.p is null
"""


@registry.add("p4_found", _P4)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each clause_path that differs between consecutive versions of a spec."""
    clauses = table(spark, d, "clauses", "chunk_id", "spec_id", "version", "clause_path", "text")
    changes = snapshot_changes(
        clauses, "spec_id", "version", clean_path(F.col("clause_path")), {"text": same_text(F.col("text"))},
        [version_part("v", n) for n in (1, 2, 3)], "chunk_id",
    )
    return changes.select("spec_id", F.col("key").alias("clause_path"), "from_version", "to_version", "change_kind")
