"""Spreadsheets as a Spark data source: a partition for each sheet, whose rows stream from the archive.

``spark.dataSource.register(XlsxDataSource)``, then ``spark.read.format("xlsx").option("sheets", "[A-Z]{3}-2026").load(folder_or_file)``.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "file string, sheet string, row_num long, cells map<string,string>"
ROWS_PER_BATCH = 5_000


def local_name(tag: str) -> str:
    return tag.rpartition("}")[2]


def elements(stream, name: str) -> Iterator[ElementTree.Element]:
    """Elements of a name as they end; what was read before is let go, so that a document of any length takes the memory of one."""
    parents: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            parents.append(element)
            continue
        parents.pop()
        if local_name(element.tag) == name:
            yield element
            if parents:
                parents[-1].clear()


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    """The texts that cells refer to by number: what a sheet's task has to hold."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as stream:
        return ["".join(t.text or "" for t in item.iter() if local_name(t.tag) == "t") for item in elements(stream, "si")]


def sheets_of(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of the sheets and where they lie, in the workbook's order."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if local_name(sheet.tag) == "sheet":
            target = next(links[v] for k, v in sheet.attrib.items() if local_name(k) == "id").lstrip("/")
            found.append((sheet.get("name", ""), target if target.startswith("xl/") else f"xl/{target}"))
    return found


def sheet_rows(book: zipfile.ZipFile, path: str, shared: list[str]) -> Iterator[tuple[int, dict[str, str]]]:
    """Number and cells (column letter -> text) of each row; absent cells are absent, not empty."""
    with book.open(path) as stream:
        for row in elements(stream, "row"):
            cells = {}
            for cell in row:
                texts = [t.text or "" for t in cell.iter() if local_name(t.tag) in ("v", "t")]
                if texts:
                    text = "".join(texts)
                    cells[re.sub(r"\d", "", cell.get("r", ""))] = shared[int(text)] if cell.get("t") == "s" else text
            yield int(row.get("r", "0")), cells


class Sheet(InputPartition):
    def __init__(self, file: str, sheet: str, path: str) -> None:
        self.file, self.sheet, self.path = file, sheet, path


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.sheets = options["path"], options.get("sheets", ".*")
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality of ``sheet`` picks partitions; all else is left to Spark."""
        for wanted in filters:
            if isinstance(wanted, (EqualTo, In)) and wanted.attribute == ("sheet",):
                names = {wanted.value} if isinstance(wanted, EqualTo) else set(wanted.value)
                self.names = names if self.names is None else self.names & names
            else:
                yield wanted

    def _store(self) -> tuple[arrow_fs.FileSystem, str]:
        if self.path.startswith("file:") or "://" not in self.path:
            return arrow_fs.LocalFileSystem(), "/" + self.path.removeprefix("file:").lstrip("/") if self.path.startswith("file:") else self.path
        return arrow_fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[Sheet]:
        """The sheets of all .xlsx files at the path whose names match; of each archive only its directory and workbook are read."""
        store, path = self._store()
        info = store.get_file_info(path)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [path] if info.type == arrow_fs.FileType.File else sorted(f.path for f in store.get_file_info(arrow_fs.FileSelector(path)) if f.path.endswith(".xlsx") and not f.base_name.startswith(("~", "_", ".")))
        found = []
        for file in files:
            with store.open_input_file(file) as stream, zipfile.ZipFile(stream) as book:
                found += [Sheet(file, name, where) for name, where in sheets_of(book) if re.fullmatch(self.sheets, name) and (self.names is None or name in self.names)]
        return found or [Sheet("", "", "")]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = self._store()
        with store.open_input_file(partition.file) as stream, zipfile.ZipFile(stream) as book:
            rows: list[tuple[int, dict[str, str]]] = []
            for row in sheet_rows(book, partition.path, shared_strings(book)):
                rows.append(row)
                if len(rows) == ROWS_PER_BATCH:
                    yield self._batch(partition, rows)
                    rows = []
            if rows:
                yield self._batch(partition, rows)

    def _batch(self, partition: Sheet, rows: list[tuple[int, dict[str, str]]]) -> pa.RecordBatch:
        n = len(rows)
        columns = [pa.array([partition.file] * n), pa.array([partition.sheet] * n), pa.array([r for r, _ in rows], pa.int64()), pa.array([list(c.items()) for _, c in rows], pa.map_(pa.string(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["file", "sheet", "row_num", "cells"])


class XlsxDataSource(DataSource):
    """Options: path, sheets (a pattern of whole names)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> XlsxReader:
        return XlsxReader({k.lower(): v for k, v in self.options.items()})


def sheets(spark: SparkSession, path: str, names: str = ".*") -> DataFrame:
    """file, sheet, row_num, cells of the .xlsx file or files at ``path``, a task for each sheet; an equality of ``sheet`` skips the others."""
    spark.dataSource.register(XlsxDataSource)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("xlsx").option("sheets", names).load(path)
