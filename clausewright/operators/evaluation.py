"""Graded retrieval evaluation and its regression gate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED = ("ndcg", "recall", "mrr", "success1")


def related(a: str, b: str) -> bool:
    """Whether one dotted path is above the other."""
    return a.startswith(b + ".") or b.startswith(a + ".")


def query_metrics(ranking: list[tuple[str, str]], judged: list[tuple[str, str, int]], k: int) -> tuple[float, float, float, float]:
    """nDCG@k, recall@k, MRR@k and success@1 of one query.

    A hit takes the best judgment not yet credited: its own clause's grade, or
    1 at most for a clause above or below it. Each judgment counts once, so no
    metric exceeds 1.
    """
    left = {i: j for i, j in enumerate(judged) if j[2] > 0}
    gains: list[int] = []
    for spec, clause in ranking[:k]:
        best, which = 0, None
        for i, (s, c, grade) in left.items():
            g = grade if (s, c) == (spec, clause) else min(grade, 1) if s == spec and related(c or "", clause or "") else 0
            if g > best:
                best, which = g, i
        if which is not None:
            left.pop(which)
        gains.append(best)
    ideal = sorted((g for _, _, g in judged if g > 0), reverse=True)[:k]
    dcg = lambda gs: sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(gs))
    total = sum(g > 0 for _, _, g in judged)
    first = next((i for i, g in enumerate(gains) if g > 0), None)
    return (
        dcg(gains) / dcg(ideal) if ideal else 0.0,
        sum(g > 0 for g in gains) / total if total else 0.0,
        1.0 / (first + 1) if first is not None else 0.0,
        1.0 if gains and gains[0] >= 2 else 0.0,
    )


def metrics(hits: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, recall, mrr, success1) of every judged query; one without hits has zeros.

    hits: query_id, spec_id, clause, rank; judgments: query_id, spec_id, clause,
    grade. Credit is given greedily in rank order, so each query is one small
    group: at most k hits and its judgments.
    """
    h = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "spec_id", "clause"))).alias("hits"))
    j = judgments.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("spec_id", "clause", "grade"))).alias("judged"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, hs, js in zip(b["query_id"], b["hits"], b["judged"]):
                ranking = [(x["spec_id"], x["clause"]) for x in (hs if hs is not None else [])]
                rows.append((q, *query_metrics(ranking, [(x["spec_id"], x["clause"], x["grade"]) for x in js], k)))
            yield pd.DataFrame(rows, columns=["query_id", *TRACKED])

    from ..session import ship_code

    ship_code(hits.sparkSession)
    kind = judgments.schema["query_id"].dataType.simpleString()
    return j.join(h, "query_id", "left").mapInPandas(run, f"query_id {kind}, ndcg double, recall double, mrr double, success1 double")


def macro_mean(per_query: DataFrame) -> DataFrame:
    """One row of means; no queries give zeros."""
    return per_query.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in TRACKED])


def gate(current: DataFrame, baseline: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(system, metric, current, baseline, passed): a metric below its baseline by more
    than the tolerance fails, and so does one that is missing on the current side."""
    c = current.select("system", "metric", F.col("value").alias("current"))
    b = baseline.select("system", "metric", F.col("value").alias("baseline"))
    j = c.join(b, ["system", "metric"], "full_outer").where("baseline is not null")
    return j.withColumn("passed", F.coalesce(F.col("current") >= F.col("baseline") - tolerance, F.lit(False)))
