"""Splitting oversized items at natural boundaries (problem 1).

Method: content-defined chunking. A rolling hash over the last ``HASH_WINDOW``
characters marks landmarks; each cut snaps from the first landmark between the
minimum and the maximum size to the nearest natural boundary there. Landmarks
depend on nearby characters only, so after an edit the cuts fall back into
step and only neighbouring pieces change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_code, spread

#: Levels of natural boundaries, strongest first.
LEVELS = ("paragraph", "line", "sentence", "word", "none")
#: What separates units, each level with those before it.
_SEPARATORS = (
    re.compile(r"\r?\n(?:[ \t]*\r?\n)+"),
    re.compile(r"\r?\n"),
    re.compile(r"(?<=[.!?])\s+"),
    re.compile(r"\s+"),
)
#: White space lies at or below U+3000.
_LAST_SPACE = 0x3000
_IS_SPACE = np.array([chr(i).isspace() for i in range(_LAST_SPACE + 1)] + [False])

#: Ends of sentences that no blank follows (ideographic full stop, full-width marks).
_FULL_STOPS = np.array([0x3002, 0xFF01, 0xFF1F], np.uint32)

HASH_WINDOW = 32
_MIX = np.uint32(2654435761)


@dataclass(frozen=True)
class ChunkRule:
    """Sizes in characters. ``landmark_bits``: one landmark every 2**bits characters."""

    max_chars: int = 2000
    min_chars: int = 1000
    overlap: int = 200
    landmark_bits: int = 9
    #: A stronger boundary wins over a nearer one within this distance of the landmark.
    reach: int = 300

    def __post_init__(self) -> None:
        if not 0 <= 2 * self.overlap <= self.min_chars <= self.max_chars or self.max_chars < 2:
            raise ValueError("sizes must satisfy 2 * overlap <= min_chars <= max_chars")


def first_level(text: str, max_chars: int) -> str:
    """The first level at which every unit of the text has at most ``max_chars``."""
    parts = [text]
    for level, separator in zip(LEVELS, _SEPARATORS):
        # units that fit stay whole: finer cuts can't make them too long
        parts = [u for p in parts for u in separator.split(p) if len(u) > max_chars]
        if not parts:
            return level
    return "none"


def landmarks(codes: np.ndarray, bits: int) -> np.ndarray:
    """Positions whose rolling hash over the characters before them has low bits 0.

    The hash of a window is built by doubling: of w characters from two of w/2.
    """
    h = codes.astype(np.uint32) * _MIX
    h ^= h >> np.uint32(15)
    w = 1
    with np.errstate(over="ignore"):
        while w < HASH_WINDOW:
            joined = h.copy()
            joined[w:] += h[:-w] * np.uint32(pow(31, w, 1 << 32))
            h, w = joined, 2 * w
        h ^= h >> np.uint32(16)
        h *= _MIX
    return np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1


def boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """White-space runs inside a text, and the ends of sentences in scripts without
    blanks: where units end, where the next begin, and the level (0 paragraph ... 3 word)."""
    space = _IS_SPACE[np.minimum(codes, _LAST_SPACE + 1)]
    flips = np.flatnonzero(space[1:] != space[:-1]) + 1
    if space[0]:
        flips = flips[1:]
    if len(flips) % 2:
        flips = flips[:-1]
    ends, begins = flips[::2], flips[1::2]
    lines = np.concatenate(([0], np.cumsum(codes == 10)))
    n = lines[begins] - lines[ends]
    before = codes[ends - 1]
    sentence = (before == 46) | (before == 33) | (before == 63) | np.isin(before, _FULL_STOPS)
    levels = np.where(n > 1, 0, np.where(n == 1, 1, np.where(sentence, 2, 3))).astype(np.int8)
    close = np.flatnonzero(np.isin(codes[:-1], _FULL_STOPS) & ~space[1:] & ~np.isin(codes[1:], _FULL_STOPS)) + 1
    if len(close):
        ends, begins, levels = np.concatenate((ends, close)), np.concatenate((begins, close)), np.concatenate((levels, np.full(len(close), 2, np.int8)))
        order = np.argsort(ends, kind="stable")
        ends, begins, levels = ends[order], begins[order], levels[order]
    return ends, begins, levels


def cut(text: str, rule: ChunkRule = ChunkRule()) -> list[tuple[int, int, int, str]]:
    """Pieces as (start, fresh, end, boundary level at the end).

    ``text[start:end]`` is the piece, ``text[start:fresh]`` what it repeats of
    the one before; the fresh parts in a row are the text itself. The last piece
    ends with the text (level ``end``).
    """
    n = len(text)
    if n <= rule.max_chars:
        return [(0, 0, n, "end")]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = landmarks(codes, rule.landmark_bits)
    ends, begins, levels = boundaries(codes)
    out, start, fresh = [], 0, 0
    while n - start > rule.max_chars:
        low, high = start + rule.min_chars, start + rule.max_chars
        i, j = np.searchsorted(ends, low, "left"), np.searchsorted(ends, high, "right")
        if i < j:
            m = np.searchsorted(marks, low, "left")
            target = int(marks[m]) if m < len(marks) and marks[m] <= high else high
            at = ends[i:j]
            far = np.abs(at - target)
            near = np.flatnonzero(far <= rule.reach)
            if len(near):
                k = near[np.lexsort((far[near], levels[i:j][near]))[0]]
            else:
                k = int(np.argmin(far))
            end, level = int(at[k]), LEVELS[levels[i + k]]
        else:
            # no boundary beyond the minimum: the last one that still adds text, else a hard cut
            i = np.searchsorted(ends, fresh, "right")
            if i < j:
                end, level = int(ends[j - 1]), LEVELS[levels[j - 1]]
            else:
                end, level = high, "none"
        out.append((start, fresh, end, level))
        # repeat from the first word that begins within the overlap, else from within a long word
        b = np.searchsorted(begins, end - rule.overlap, "left")
        repeat = int(begins[b]) if b < len(begins) and begins[b] < end else end - rule.overlap
        start, fresh = max(repeat, fresh), end
    out.append((start, fresh, n, "end"))
    return out


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", rule: ChunkRule = ChunkRule(), only_oversized: bool = False) -> DataFrame:
    """Pieces of every text, in one pass without a shuffle.

    Columns: the id, ``piece`` (from 0), ``start``, ``fresh``, ``end``
    (characters; ``text[start:fresh]`` repeats the piece before), ``ends_at``
    (boundary level of the cut), ``boundary`` (first level at which all units of
    the whole text fit) and ``piece_text``.

    A text within the limit is one piece; an empty text is one empty piece, a
    null text gives no row. With ``only_oversized`` texts within the limit give
    no rows either; that filter runs at the scan. Repeated rows give their
    pieces again, other columns are not read.
    """
    ship_code(df.sparkSession)
    kind = df.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, kind),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("fresh", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("ends_at", T.StringType()),
            T.StructField("boundary", T.StringType()),
            T.StructField("piece_text", T.StringType()),
        ]
    )
    rows = df.select(df[id_col].alias("__id"), df[text_col].alias("__text")).where(F.col("__text").isNotNull())
    if only_oversized:
        rows = rows.where(F.length("__text") > rule.max_chars)
    rows = spread(rows, "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        for batch in batches:
            take, cols, size = [], [[] for _ in range(7)], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                level = first_level(text, rule.max_chars)
                for k, (start, fresh, end, ends_at) in enumerate(cut(text, rule)):
                    take.append(i)
                    for c, v in zip(cols, (k, start, fresh, end, ends_at, level, text[start:end])):
                        c.append(v)
                    size += end - start
                if size > 16_000_000:  # long texts: don't hold a whole batch twice
                    yield _batch(batch, take, cols, out_schema)
                    take, cols, size = [], [[] for _ in range(7)], 0
            yield _batch(batch, take, cols, out_schema)

    return rows.mapInArrow(run, schema)


def _batch(batch: pa.RecordBatch, take: list[int], cols: list[list], schema: pa.Schema) -> pa.RecordBatch:
    ids = batch.column(0).take(pa.array(take, pa.int32()))
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema)
