"""Encoding of a corpus with a public tokenizer (problem 7).

Method: the tiktoken library over a local rank file; long texts are first cut
at boundaries where the pre-splitting pattern can never match across; decoding
joins raw bytes, so any run of ids can be decoded.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship_code, spread

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this many characters are encoded in parts of about this size.
PART_CHARS = 65_536

#: No alternative of the pattern goes on from a character that isn't white space
#: to one that is, so before such white space a text can be cut anywhere.
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The encoder of one rank file; built once per Python worker."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=_ranks(os.path.join(folder, f"{name}.tiktoken")), special_tokens={})


def safe_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Parts of a text, cut only where tokens can't cross; they join to the text.

    A part grows beyond ``size`` when no safe boundary comes.
    """
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str | None, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> list[int]:
    """Ids of one text without special tokens; [] for an empty or null text."""
    if not text:
        return []
    e = encoding(name, folder)
    if len(text) <= PART_CHARS:
        return e.encode_ordinary(text)
    return [i for part in safe_parts(text) for i in e.encode_ordinary(part)]


def decode(ids: list[int] | None, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    """Text of ids by joining their bytes; a broken sequence at a cut becomes U+FFFD."""
    if not ids:
        return ""
    return encoding(name, folder).decode_bytes(ids).decode("utf-8", errors="replace")


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids) of every row, one pass without a shuffle.

    Null and empty texts give the empty list, a null id stays null, repeated
    rows stay repeated, an empty table gives an empty one. Only the two columns
    named are read, so other columns can't clash.
    """
    ship_code(df.sparkSession)
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode(t, name, folder) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, ids_col])

    return spread(df.select(df[id_col], df[text_col]), id_col).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, text) of rows of ids, the inverse of ``encode_corpus``; null ids give ''."""
    ship_code(df.sparkSession)
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(i, name, folder) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, text_col])

    return df.select(df[id_col], df[ids_col]).mapInArrow(run, schema)
