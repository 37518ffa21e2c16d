"""Office files as a Spark data source: spark.read.format("office").load(folder).

The folder is walked once on the driver; a partition is a run of whole files, and each file goes to the reader of its extension: documents
give a row per paragraph, workbooks a row per line of a sheet. Files of other kinds are passed over. Conditions on kind are pushed
down, so files of other kinds aren't opened. Paths go through pyarrow's file systems (file, hdfs, s3, gs).

Options: partitionBytes.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ledgerloom.sources.files import docx_blocks, xlsx_rows

SCHEMA = "path string, kind string, position long, text string, heading_level int, page int, sheet string, columns array<string>, cells array<string>"
_ARROW = {
    "path": pa.string(), "kind": pa.string(), "position": pa.int64(), "text": pa.string(), "heading_level": pa.int32(), "page": pa.int32(),
    "sheet": pa.string(), "columns": pa.list_(pa.string()), "cells": pa.list_(pa.string()),
}
BATCH_ROWS = 4096


def docx(content: bytes) -> Iterator[dict]:
    for i, (text, level) in enumerate(docx_blocks(content)):
        yield {"position": i, "text": text, "heading_level": level}


def xlsx(content: bytes) -> Iterator[dict]:
    for sheet, i, columns, cells in xlsx_rows(content):
        yield {"position": i, "sheet": sheet, "columns": columns, "cells": cells}


def pdf(content: bytes) -> Iterator[dict]:
    """Lines by page; needs pypdf. Headings are marked from the text, by sources.files.mark_headings."""
    from pypdf import PdfReader

    for number, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
        for i, line in enumerate((page.extract_text() or "").splitlines()):
            yield {"position": i, "text": line, "page": number}


READERS: dict[str, Callable[[bytes], Iterator[dict]]] = {"docx": docx, "xlsx": xlsx, "pdf": pdf}


def store_at(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path in it, and what to put before a path in it to get a URI again."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, path[: len(path) - len(inner)] if path.endswith(inner) else f"{path.split('://')[0]}://"


def kind_of(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name else ""


@dataclass
class Files(InputPartition):
    paths: list[str]


class OfficeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", 64 << 20))
        self.arrow = pa.schema([(f.name, _ARROW[f.name]) for f in schema])
        self.kinds = set(READERS)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("kind",):
                self.kinds &= {f.value} if isinstance(f, EqualTo) else set(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, inner, prefix = store_at(self.path)
        found = store.get_file_info(inner)
        there = [found] if found.is_file else store.get_file_info(fs.FileSelector(inner, recursive=True))
        wanted = [(x.size, prefix + x.path) for x in there if x.is_file and kind_of(x.base_name) in self.kinds and not x.base_name.startswith("~$")]
        out: list[Files] = []
        room = 0
        for size, path in sorted(wanted, key=lambda x: (-x[0], x[1])):
            if room < size or not out:
                out.append(Files([]))
                room = self.partition_bytes
            out[-1].paths.append(path)
            room -= size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for path in partition.paths:
            store, inner, _ = store_at(path)
            with store.open_input_file(inner) as f:
                content = f.read()
            kind = kind_of(path)
            for row in READERS[kind](content):
                rows.append({"path": path, "kind": kind} | row)
                if len(rows) >= BATCH_ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{c: r.get(c) for c in self.arrow.names} for r in rows], self.arrow)


class OfficeDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> OfficeReader:
        return OfficeReader(dict(self.options), schema)


def use_office(spark: SparkSession) -> None:
    """Make format("office") known to the session, with its conditions pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OfficeDataSource)


# --- small files of both kinds --------------------------------------------------------------

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def docx_file(blocks: list[tuple[str, int | None]]) -> bytes:
    """A document of (text, heading level) paragraphs, enough for its readers."""
    style = lambda level: f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if level else ""
    body = "".join(f'<w:p>{style(level)}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>' for text, level in blocks)
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>'})


def xlsx_file(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A workbook of sheets of lines; missing cells are left out."""
    parts = {"xl/workbook.xml": f'<workbook xmlns="{_S}"><sheets>{"".join(f"<sheet name={quoteattr(n)}/>" for n in sheets)}</sheets></workbook>'}
    for i, lines in enumerate(sheets.values(), 1):
        cell = lambda r, c, v: "" if v is None else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        rows = "".join(f"<row>{''.join(cell(r, c, v) for c, v in enumerate(line))}</row>" for r, line in enumerate(lines, 1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{_S}"><sheetData>{rows}</sheetData></worksheet>'
    return _zipped(parts)


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()
