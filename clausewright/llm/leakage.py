"""Evaluation texts leaking into training text (problem 8).

Method: the test items' normalised word n-grams form a hash table that goes to
every executor (its size is checked; see ``MAX_BROADCAST_GRAMS``); one pass over the corpus
hashes each document's word windows, looks them up, verifies each hit word by
word and reports the spans, which ``remove_leaks`` cuts out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_code, spread

#: Words in a row that count as a leak.
WINDOW = 12
#: Most n-grams of test items in one broadcast (about 24 bytes each); a larger
#: test set is worked off in several passes, each with its own table.
MAX_BROADCAST_GRAMS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
#: Characters without width that may stand inside a word.
_INVISIBLE = {0x200B: None, 0x00AD: None}
_INVISIBLE_RE = re.compile("[​­]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; U+200B and U+00AD don't count."""
    return _WORD.findall(text.translate(_INVISIBLE).lower()) if text else []


@lru_cache(maxsize=200_000)
def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def gram_hashes(words: list[str], n: int) -> np.ndarray:
    """One 64-bit hash for each window of ``n`` words (fewer words: none)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash, words), np.uint64, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _BASE + h[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return out


class GramTable:
    """Sorted hashes of all n-grams of some items, with the places they stand."""

    def __init__(self, items: list[tuple[object, str | None]], n: int) -> None:
        self.n = n
        self.items = [(i, w) for i, t in items if len(w := words_of(t)) >= n]
        hashes = [gram_hashes(w, n) for _, w in self.items]
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.item = np.concatenate([np.full(len(h), k, np.int32) for k, h in enumerate(hashes)]) if hashes else np.empty(0, np.int32)
        self.pos = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes]) if hashes else np.empty(0, np.int32)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.pos = self.hash[order], self.item[order], self.pos[order]

    def hits(self, words: list[str]) -> list[tuple[int, int]]:
        """(window, item index) of each verified hit in a document's words."""
        g = gram_hashes(words, self.n)
        if not len(g) or not len(self.hash):
            return []
        lo = np.searchsorted(self.hash, g, "left")
        found = np.flatnonzero(self.hash[np.minimum(lo, len(self.hash) - 1)] == g)
        out: list[tuple[int, int]] = []
        for at in found.tolist():
            k = int(lo[at])
            while k < len(self.hash) and self.hash[k] == g[at]:
                item, pos = int(self.item[k]), int(self.pos[k])
                if words[at : at + self.n] == self.items[item][1][pos : pos + self.n]:
                    out.append((at, item))
                k += 1
        return out


def _spans(hits: list[tuple[int, int]], n: int) -> dict[int, list[tuple[int, int]]]:
    """For each item its runs of words [first, last], overlapping windows joined."""
    by: dict[int, list[tuple[int, int]]] = {}
    for at, item in sorted(set(hits), key=lambda x: (x[1], x[0])):
        runs = by.setdefault(item, [])
        if runs and at <= runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], max(runs[-1][1], at + n - 1))
        else:
            runs.append((at, at + n - 1))
    return by


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of word runs in the text itself, invisible characters included."""
    shown = [i for i, c in enumerate(text) if ord(c) not in _INVISIBLE] if _INVISIBLE_RE.search(text) else None
    lowered = (text.translate(_INVISIBLE) if shown is not None else text).lower()
    if len(lowered) != (len(text) if shown is None else len(shown)):
        # lower() grew (such as U+0130): map each lowered character back to its source
        back = [i for i, c in enumerate(text) if ord(c) not in _INVISIBLE for _ in c.lower()]
    else:
        back = shown
    places = [m.span() for m in _WORD.finditer(lowered)]
    where = (lambda i: i) if back is None else back.__getitem__
    return [(where(places[a][0]), where(places[b][1] - 1) + 1) for a, b in runs]


def _tables(items: DataFrame, item_id: str, item_text: str, n: int) -> Iterator[GramTable]:
    """Tables of at most ``MAX_BROADCAST_GRAMS`` n-grams, items streamed once."""
    part: list[tuple[object, str | None]] = []
    size = 0
    for row in items.select(items[item_id], items[item_text]).where(items[item_text].isNotNull()).dropDuplicates().toLocalIterator():
        part.append((row[0], row[1]))
        size += len(row[1]) // 2 + 1
        if size > MAX_BROADCAST_GRAMS:
            yield GramTable(part, n)
            part, size = [], 0
    yield GramTable(part, n)


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """One row per document and leaked item: ids, longest run, spans in characters.

    Columns: ``doc_id, item_id, n_words`` (the longest run of shared words),
    ``spans`` (array of [start, end) in the document's text). Null, empty and
    shorter texts give no rows, on either side. Items that repeat under one id
    count once, the same text under two ids gives two rows; documents given
    twice give their rows twice. No shuffle: the corpus is read once per table
    of n-grams, and there is one table unless the test set is very large.
    """
    spark = docs.sparkSession
    ship_code(spark)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("item_id", items.schema[item_id].dataType),
            T.StructField("n_words", T.IntegerType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        ]
    )
    corpus = spread(docs.select(docs[doc_id].alias("doc_id"), docs[doc_text].alias("text")).where(F.col("text").isNotNull()), "doc_id")
    parts = []
    for t in _tables(items, item_id, item_text, n):
        sent = spark.sparkContext.broadcast(t)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            table, out_schema = sent.value, to_arrow_schema(schema)
            for batch in batches:
                rows = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    hits = table.hits(words_of(text))
                    if hits:
                        for item, runs in _spans(hits, n).items():
                            rows.append({"doc_id": key, "item_id": table.items[item][0], "n_words": max(b - a + 1 for a, b in runs), "spans": [{"start": a, "end": b} for a, b in char_spans(text, runs)]})
                yield pa.RecordBatch.from_pylist(rows, out_schema)

        parts.append(corpus.mapInArrow(run, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) > 1:  # an id may stand in two tables when its texts differ
        out = out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"))
    return out


def remove_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", drop_documents: bool = False) -> DataFrame:
    """The corpus without its leaks: documents dropped, or only the spans cut out.

    Documents without leaks pass unchanged, null texts stay null. Documents with
    a null id can't be told apart: they stay, whatever was found in them. Only
    leaking documents' spans are shuffled, to meet their documents.
    """
    own = leaks.select(F.col("doc_id").alias("__doc"), F.col("spans").alias("__spans"))
    if drop_documents:
        return docs.join(own.select("__doc"), docs[doc_id] == F.col("__doc"), "left_anti")
    # per document at most one span list per test item
    one = own.select("__doc", F.explode("__spans").alias("__s")).groupBy("__doc").agg(F.array_sort(F.collect_set("__s")).alias("__spans"))
    joined = docs.join(one, docs[doc_id] == F.col("__doc"), "left")
    state = F.aggregate(
        "__spans",
        F.struct(F.lit("").alias("t"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] > acc["at"], F.concat(acc["t"], F.substring(F.col(doc_text), acc["at"] + 1, s["start"] - acc["at"]))).otherwise(acc["t"]).alias("t"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["t"], F.substring(F.col(doc_text), acc["at"] + 1, F.length(F.col(doc_text)))),
    )
    return joined.select(*[F.when(F.col("__doc").isNull(), docs[c]).otherwise(state).alias(c) if c == doc_text else docs[c] for c in docs.columns])
