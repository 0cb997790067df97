"""The parsers over DataFrames: one pass, Arrow batches in and out, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship_code, spread
from . import html as H
from . import parsers as P


def parse_rows(df: DataFrame, key: str, text: str, schema: str, parser: Callable[[str | None], list[dict[str, Any]]]) -> DataFrame:
    """One row per record that ``parser`` finds in each text, after the text's key.

    Null texts go to the parser as None. Texts are handled whole, a batch at a
    time.
    """
    ship_code(df.sparkSession)
    out = T.StructType([df.schema[key], *T._parse_datatype_string(schema).fields])
    rows = spread(df.select(key, text), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(out)
        for batch in batches:
            found = [{key: k, **r} for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in parser(t)]
            yield pa.RecordBatch.from_pylist(found, kind)

    return rows.mapInArrow(run, out)


def html_clauses(df: DataFrame, key: str, html: str) -> DataFrame:
    """Clauses of HTML documents: clause_path, heading, text, is_normative, salvaged."""

    def one(t: str | None) -> list[dict[str, Any]]:
        clauses, _, salvaged = H.parse_clauses(t)
        return [{"clause_path": c.clause_path, "heading": c.heading, "text": "\n".join(c.lines), "is_normative": c.is_normative, "salvaged": salvaged} for c in clauses]

    return parse_rows(df, key, html, "clause_path string, heading string, text string, is_normative boolean, salvaged boolean", one)


def html_tables(df: DataFrame, key: str, html: str) -> DataFrame:
    """Rows of HTML tables: table number, row number, cells joined by tabs."""

    def one(t: str | None) -> list[dict[str, Any]]:
        return [{"table_no": n, "row_no": i, "line": "\t".join(cells)} for i, (n, cells) in enumerate(H.table_rows(t))]

    return parse_rows(df, key, html, "table_no int, row_no int, line string", one)


def abbreviations(df: DataFrame, key: str, text: str) -> DataFrame:
    def one(t: str | None) -> list[dict[str, Any]]:
        return [{"term": a, "expansion": e, "initials": P.initials_match(a, e)} for a, e in P.parse_abbreviations(t)]

    return parse_rows(df, key, text, "term string, expansion string, initials boolean", one)


def asn1_types(df: DataFrame, key: str, text: str) -> DataFrame:
    schema = "name string, kind string, members array<struct<name:string,type:string,tag:int,optional:boolean,clause:string>>"
    return parse_rows(df, key, text, schema, P.parse_asn1)


def asn1_events(df: DataFrame, key: str, text: str) -> DataFrame:
    def one(t: str | None) -> list[dict[str, Any]]:
        return P.asn1_events(P.parse_asn1(t))

    return parse_rows(df, key, text, "interface string, nf string, domain string, event string, type string, tag int, clause string, fields int", one)


def openapi_operations(df: DataFrame, key: str, text: str) -> DataFrame:
    def one(t: str | None) -> list[dict[str, Any]]:
        return P.parse_openapi(t)[0] if t else []

    return parse_rows(df, key, text, "path string, method string, operation_id string, summary string, tags array<string>, request_schema string, response_codes array<string>, api_version string", one)


def openapi_schemas(df: DataFrame, key: str, text: str) -> DataFrame:
    def one(t: str | None) -> list[dict[str, Any]]:
        return P.parse_openapi(t)[1] if t else []

    return parse_rows(df, key, text, "schema_name string, kind string, description string, properties array<string>, enum_values array<string>, refs_out array<string>", one)


def change_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    def one(t: str | None) -> list[dict[str, Any]]:
        found = map(P.parse_change_line, (t or "").splitlines())
        return [dict(zip(("number", "revision", "category", "title"), f)) for f in found if f]

    return parse_rows(df, key, text, "number string, revision int, category string, title string", one)
