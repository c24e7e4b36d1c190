"""Readers and writers of files: JSON lines, CSV, dictionaries, spreadsheets, folders of documents, manifests and sinks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import normalize_date
from tessera.operators.documents import filename_metadata


# --- scans --------------------------------------------------------------------------------------------------------

def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of a fixed schema; a bad line stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines with their reason): blank lines are skipped, bad ones are set aside and the scan goes on."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    # a corrupt record column tells bad JSON from a row of nulls
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    is_object = F.trim("value").startswith("{")
    reason = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.when(is_object, "bad_json").otherwise("not_an_object"))
    marked = parsed.withColumn("reason", reason)
    return marked.where("reason IS NULL").select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]), marked.where("reason IS NOT NULL").select("reason", "value")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header row (with or without a byte order mark); all text without a schema."""
    r = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def read_code_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) from lines of ten digits, blanks and a name; other lines are left out."""
    m = lambda i: F.regexp_extract("value", r"^(\d{10})\s+(.+?)\s*$", i)
    return spark.read.text(path).select(m(1).alias("code"), m(2).alias("name")).where("code <> ''")


def lookup_codes(rows: DataFrame, codes: Column, dictionary: DataFrame, key: str, out: str = "names") -> DataFrame:
    """Names of a row's ``|``-separated codes in order; unknown codes are dropped. An equi-join on exploded codes, so the
    dictionary may be of any size."""
    items = rows.select(key, F.posexplode(F.filter(F.split(codes, r"\|"), lambda c: F.trim(c) != "")).alias("n", "code")).withColumn("code", F.trim("code"))
    named = items.join(dictionary, "code").groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias(out))
    return rows.join(named, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


# Names of the parts of an Office Open XML file.
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_TARGETS = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def _elements(z: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag in a part, each given up once it is used; none if there is no such part."""
    if part in z.NameToInfo:
        with z.open(part) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == tag:
                    yield e
                    e.clear()


def _plain(e: ElementTree.Element, run: str = _SHEET + "t") -> str:
    return "".join(t.text or "" for t in e.iter(run))


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The part of the sheet that the workbook lists first."""
    wanted = next((e.get(_RELATION) for e in _elements(z, "xl/workbook.xml", _SHEET + "sheet")), None)
    for e in _elements(z, "xl/_rels/workbook.xml.rels", _TARGETS):
        if e.get("Id") == wanted:
            target = e.get("Target").lstrip("/")
            return target if target.startswith("xl/") else "xl/" + target
    return min((n for n in z.namelist() if n.startswith("xl/worksheets/")), key=lambda n: (len(n), n))


def sheet_rows(data: bytes) -> Iterator[list]:
    """Rows of the first sheet of a workbook: shared and inline strings, numbers as text, booleans; absent cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = [_plain(e) for e in _elements(z, "xl/sharedStrings.xml", _SHEET + "si")]
        # how a cell's type says its value is to be read
        readers = {"s": lambda v: strings[int(v)], "b": {"1": "true", "0": "false"}.get}
        for row in _elements(z, _first_sheet(z), _SHEET + "row"):
            out: list = []
            for cell in row.iter(_SHEET + "c"):
                letters = (cell.get("r") or "").rstrip("0123456789")
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(out)
                value, kind = cell.findtext(_SHEET + "v"), cell.get("t", "n")
                if kind == "inlineStr":
                    value = _plain(cell)
                elif value is not None:
                    value = readers.get(kind, str)(value)
                out += [None] * (at + 1 - len(out))
                out[at] = value
            while out and out[-1] is None:
                out.pop()
            yield out


def document_text(data: bytes) -> str:
    """The paragraphs of a Word document (docx), one a line; tabs and breaks within them are kept as blanks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = []
        for p in _elements(z, "word/document.xml", _WORD + "p"):
            out.append("".join((e.text or "") if e.tag == _WORD + "t" else " " if e.tag in (_WORD + "tab", _WORD + "br") else "" for e in p.iter()))
        return "\n".join(x.strip() for x in out if x.strip())


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every Word document under a path; a file that is none has null text."""

    def text(data: bytes) -> str | None:
        try:
            return document_text(data)
        except (zipfile.BadZipFile, ElementTree.ParseError):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": b["content"].map(text)}, dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, text string")


def read_xlsx(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of the first sheet of every workbook under a path as text columns, by the names in its header row.

    A workbook can't be split: one task reads one file, and files are read in parallel.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = sheet_rows(data)
                header = [str(h).strip() if h is not None else "" for h in next(rows, [])]
                at = [header.index(c) if c in header else None for c in columns]
                part = [[None if i is None or i >= len(r) or r[i] is None else str(r[i]) for i in at] for r in rows if any(x is not None for x in r)]
                yield pd.DataFrame(part, columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


# What a column's name says about its values.
TEXT_COLUMNS = re.compile(r"(?:code|_id|^id|name|title|memo|category|type|currency|crncy)", re.I)
DATE_COLUMNS = re.compile(r"(?:date|_dt$|^ann_dt|period|enddate)", re.I)


def typed(raw: DataFrame) -> DataFrame:
    """Columns of text typed by their names: dates as ISO text, codes and names as text (leading zeros stay), all else as
    numbers where every character fits one; blank is null and numbers that aren't finite are null."""
    out = []
    for c in raw.columns:
        v = F.nullif(F.trim(F.col(c)), F.lit(""))
        if DATE_COLUMNS.search(c):
            out.append(normalize_date(v).alias(c))
        elif TEXT_COLUMNS.search(c):
            out.append(v.alias(c))
        else:
            n = v.try_cast("double")
            out.append(F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n).alias(c))
    return raw.select(*out)


# Signatures of file formats.
MAGIC = [(b"%PDF", "pdf"), (b"PK\x03\x04", "zip"), (b"\xd0\xcf\x11\xe0", "ole"), (b"<!DOC", "html"), (b"<html", "html"), (b"<HTML", "html")]


def detect_format(content: Column, content_type: Column, url: Column) -> Column:
    """pdf, zip (docx), ole (doc), html, txt or unknown: bytes count before the stated type, the type before the suffix."""
    out = None
    for magic, label in MAGIC:
        hit = F.substring(content, 1, len(magic)) == F.lit(magic)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    for part, label in (("pdf", "pdf"), ("html", "html"), ("word", "zip"), ("text/plain", "txt")):
        out = out.when(F.lower(content_type).contains(part), label)
    return out.otherwise(F.coalesce(F.nullif(F.regexp_extract(F.lower(url), r"\.(pdf|html?|docx?|txt)(?:[?#]|$)", 1), F.lit("")), F.lit("unknown")))


def scan_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified, sha256, company_id, published_date, document_type) of every file below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    meta = filename_metadata(F.col("path"))
    return f.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), meta.alias("m")).select("path", "length", "modified", "sha256", "m.*")


def unseen_files(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """Files whose (path, sha256) isn't loaded yet: an incremental scan."""
    return files.join(loaded.select("path", "sha256"), ["path", "sha256"], "left_anti")


# --- sinks --------------------------------------------------------------------------------------------------------

def write_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, all or nothing: the job commit makes it visible at once."""
    w = rows.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines without NaN: such numbers are written as null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    rows.select(*clean).write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# --- manifests ----------------------------------------------------------------------------------------------------

def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, modified) of a stored table's files, without reading their contents."""
    f = spark.read.format("parquet").load(path)
    m = f.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
    return m.distinct()


def is_stale(spark: SparkSession, recorded: DataFrame, path: str) -> bool:
    """Whether a table's files differ from its recorded manifest; a query over it is then to be refused."""
    now = manifest(spark, path)
    key = ["file", "size", "modified"]
    return now.select(key).exceptAll(recorded.select(key)).limit(1).count() + recorded.select(key).exceptAll(now.select(key)).limit(1).count() > 0


def require_all(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """Rows unchanged; the job fails with the message where a row breaks the condition (null breaks it)."""
    return rows.where(F.coalesce(condition, F.lit(False)) | F.raise_error(F.lit(message)).isNotNull())
