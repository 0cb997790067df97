"""File formats: HTML bytes, ledgers, catalogues, workbooks, file names."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def decode(data: bytes) -> str:
    """UTF-8, else Windows-1252 with its unused bytes as they are in Latin-1."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in data)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of a folder of HTML files, each decoded whole."""
    from ..session import ship_code

    ship_code(spark)

    @F.pandas_udf(T.StringType())
    def text(data: pd.Series) -> pd.Series:
        return data.map(lambda b: decode(bytes(b)))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", text("content").alias("html"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A four-column TSV catalogue; a line of another width fails the read."""
    schema = "spec_id string, title string, doc_type string, working_group string"
    return spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST").option("header", "false").csv(path)


def read_ledger(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """A newline-delimited ledger of vectors; malformed lines and vectors of another
    length are left out."""
    schema = "id long, hash string, vec array<float>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("id is not null").where(F.size("vec") == dim)


def write_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def split_by(df: DataFrame, path: str, column: str) -> None:
    """One folder per value of ``column``, e.g. a release."""
    df.repartition(column).write.mode("overwrite").partitionBy(column).parquet(path)


# Fixed value: file names of archived versions, such as 23501-i40.zip.
_FILE = r"(?i)([0-9]{2})([0-9]{3}(?:-[0-9]+)?)-([0-9a-z]{3}|[0-9]{6})\.[a-z]+$"


def file_metadata(path: Column) -> Column:
    """struct(spec_id, version) of an archived file's name; null parts where it isn't one."""
    series, number, code = (F.regexp_extract(path, _FILE, i) for i in (1, 2, 3))
    ok = series != ""
    return F.struct(F.when(ok, F.concat(series, F.lit("."), number)).alias("spec_id"), F.when(ok, X.version_of_code(code)).alias("version"))


def etsi_header(html: Column) -> Column:
    """struct(spec_id, version) of an ETSI document's title, such as ETSI TS 103 221-1 V1.8.1."""
    form = r"ETSI\s+(TS|TR|EN)\s+(1[0-9]{2})\s*([0-9]{3}(?:-[0-9]+)?)\s+V([0-9]+\.[0-9]+\.[0-9]+)"
    part = [F.regexp_extract(html, form, i) for i in range(1, 5)]
    ok = part[0] != ""
    return F.struct(F.when(ok, F.concat(F.lit("ETSI "), part[0], F.lit(" "), part[1], F.lit(" "), part[2])).alias("spec_id"), F.when(ok, part[3]).alias("version"))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_rows(data: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet of a workbook, streamed; a workbook within a zip is opened too.

    A sheet that breaks off raises.
    """
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    inner = next((n for n in names if n.lower().endswith(".xlsx")), None)
    if inner and "xl/workbook.xml" not in names:
        yield from workbook_rows(z.read(inner))
        return
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        for _, e in iterparse(z.open("xl/sharedStrings.xml")):
            if e.tag == _NS + "si":
                shared.append("".join(t.text or "" for t in e.iter(_NS + "t")))
                e.clear()
    sheet = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
    for _, e in iterparse(z.open(sheet)):
        if e.tag != _NS + "row":
            continue
        cells: list[str] = []
        for c in e.iter(_NS + "c"):
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [""] * (at + 1 - len(cells))
            v = c.find(_NS + "v")
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(_NS + "t"))
            elif v is not None and v.text is not None:
                cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
        e.clear()
        yield cells


def read_workbooks(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of all workbooks of a folder, bound to ``columns`` by their header's names;
    a workbook without all of them fails. One task per workbook."""
    from ..session import ship_code

    ship_code(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                rows = workbook_rows(bytes(data))
                head = [h.strip().lower() for h in next(rows, [])]
                missing = [c for c in columns if c.lower() not in head]
                if missing:
                    raise ValueError(f"{name} has no column {', '.join(missing)}")
                at = [head.index(c.lower()) for c in columns]
                part: list[list[str]] = []
                for r in rows:
                    part.append([r[i] if i < len(r) else "" for i in at])
                    if len(part) == 10_000:
                        yield pd.DataFrame(part, columns=columns)
                        part = []
                yield pd.DataFrame(part, columns=columns)

    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,zip}").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, schema)


# --- folders --------------------------------------------------------------------------------


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path of any scheme."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; what can't be asked (permission, network) raises."""
    fs, target = file_system(spark, path)
    return fs.exists(target)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder that were written to the end; none if it isn't there."""
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        return []
    return [n for n in folder_names(spark, path) if exists(spark, f"{path}/{n}/_SUCCESS")]


def folder_names(spark: SparkSession, path: str) -> list[str]:
    fs, target = file_system(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(target) if x.isDirectory()]


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; a file system that only says no is made to raise."""
    fs, a = file_system(spark, source)
    if not fs.rename(a, file_system(spark, target)[1]):
        raise OSError(f"could not rename {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)
