"""Readers and sinks beyond Spark's own formats: office files, fixtures, append-only logs, mirrors."""

from __future__ import annotations

import io
import logging
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import is_caps_heading

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
BLOCK_SCHEMA = "path string, position long, text string, heading_level int, page int"
ROW_SCHEMA = "path string, sheet string, position long, columns array<string>, cells array<string>"


def docx_blocks(content: bytes) -> Iterator[tuple[str, int | None]]:
    """(text, heading level) of each paragraph that has text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for p in root.iter(f"{WORD}p"):
        text = "".join(t.text or "" for t in p.iter(f"{WORD}t")).strip()
        if not text:
            continue
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        name = style.get(f"{WORD}val", "") if style is not None else ""
        level = None
        if name.startswith("Heading"):
            digits = re.search(r"(\d+)$", name)
            level = int(digits[1]) if digits else 1
        yield text, level


def xlsx_rows(content: bytes) -> Iterator[tuple[str, int, list[str], list[str | None]]]:
    """(sheet, position, columns, cells): the first row with a value names the columns; empty rows are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        names = [s.get("name") for s in book.iter(f"{SHEET}sheet")]
        for i, name in enumerate(names, 1):
            columns: list[str] | None = None
            n = 0
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{SHEET}row"):
                cells: dict[int, str] = {}
                for c in row.iter(f"{SHEET}c"):
                    letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    value = c.find(f"{SHEET}v")
                    text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                    if c.get("t") == "s" and text:
                        text = shared[int(text)]
                    if text:
                        cells[at - 1] = text
                if not cells:
                    continue
                line = [cells.get(k) for k in range(max(cells) + 1)]
                if columns is None:
                    columns = [x or "" for x in line]
                    continue
                n += 1
                yield name, n, columns, line


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all documents under a folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(p, i, t, level, None) for p, c in zip(part["path"], part["content"], strict=True) for i, (t, level) in enumerate(docx_blocks(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "position", "text", "heading_level", "page"]).astype({"heading_level": "Int32", "page": "Int32"})

    return _files(spark, path, "*.docx").mapInPandas(run, BLOCK_SCHEMA)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all sheets of all workbooks under a folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(p, *r) for p, c in zip(part["path"], part["content"], strict=True) for r in xlsx_rows(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "sheet", "position", "columns", "cells"])

    return _files(spark, path, "*.xlsx").mapInPandas(run, ROW_SCHEMA)


#: Fixed value: lines that start like a chapter, section or article, or are numbered, are headings.
NUMBERED = r"^\s*(Chương|Mục|Điều)\b|^\s*\d+\.\d{1,2}(\.\d{1,2})*(?!\d)[.\)]?\s+\S"


def mark_headings(lines: DataFrame, column: str = "text") -> DataFrame:
    """Level 2 for lines that look like headings: by their start, or short and in capitals."""
    text = F.trim(F.replace(F.col(column), F.lit("\x00"), F.lit("")))
    return lines.withColumn(column, text).where(F.col(column) != "").withColumn("heading_level", F.when(F.col(column).rlike(NUMBERED) | is_caps_heading(F.col(column)), 2))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all PDF files under a folder, with headings marked; needs the optional pypdf."""
    import pypdf  # noqa: F401  (fails here, on the driver, where it isn't installed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pypdf import PdfReader

        for part in batches:
            rows = []
            for p, c in zip(part["path"], part["content"], strict=True):
                for number, page in enumerate(PdfReader(io.BytesIO(bytes(c))).pages, 1):
                    rows += [(p, i, line, number) for i, line in enumerate((page.extract_text() or "").splitlines())]
            yield pd.DataFrame(rows, columns=["path", "position", "text", "page"])

    return mark_headings(_files(spark, path, "*.pdf").mapInPandas(run, "path string, position long, text string, page int"))


def read_fixture(spark: SparkSession, path: str, schema: str, *, lines: bool = False) -> DataFrame:
    """A JSON array of records (or a record per line) with the fields that are named; others are left out."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def append_log(events: DataFrame, path: str, *, fail_open: bool = False) -> bool:
    """Append events as JSON lines. Failing open, a log that can't be written only leaves a warning: what is logged must not fail by it."""
    try:
        events.write.mode("append").json(path)
    except Exception:
        if not fail_open:
            raise
        logging.getLogger(__name__).warning("nothing was logged to %s", path, exc_info=True)
        return False
    return True


def upsert(spark: SparkSession, path: str, fresh: DataFrame, key: str, *, delete_missing: bool = False) -> str:
    """Write the next version of a keyed table beside the present one and return its folder.

    Rows of fresh replace those with their key. With delete_missing, rows that fresh lacks go, unless
    fresh is empty: an empty fetch must not wipe the mirror.
    """
    if delete_missing and not fresh.isEmpty():
        merged = fresh
    else:
        merged = spark.read.parquet(path).join(fresh.select(key), key, "left_anti").unionByName(fresh)
    version = re.search(r"-v(\d+)$", path)
    target = f"{path[: version.start()] if version else path}-v{int(version[1]) + 1 if version else 1}"
    merged.write.parquet(target)
    return target


def write_job_result(result: DataFrame, path: str) -> None:
    """One small JSON file per run."""
    result.coalesce(1).write.mode("errorifexists").json(path)
