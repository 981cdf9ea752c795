"""Archives of any size as Spark sources: one partition for each member, planned from the archive's directory and read as a stream.

Only the directory at an archive's end is read to plan; a task opens the archive, seeks its member and
unpacks it piece by piece, so neither an archive nor a member is ever held whole, and many members are many tasks'
work. Paths are opened by Arrow's file systems (local or mounted, HDFS, S3, GCS). What ``binaryFile`` reads
(``readers.zipped_csv``, ``workbooks.workbook_cells``) needs no such path but is bound to 2 GB a file.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from fnmatch import fnmatch
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ROWS = 5_000
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "file string, sheet string, hidden boolean, cell string, value string"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else path.replace("file:", "file://", 1))


def matching(path: str) -> list[str]:
    """The files of a path whose last part may be a pattern, in order of name."""
    top, _, last = path.rpartition("/")
    system, folder = _system(top)
    if not re.search(r"[*?\[]", last):
        return [path]
    found = system.get_file_info(fs.FileSelector(folder))
    return [f"{top}/{x.base_name}" for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and fnmatch(x.base_name, last)]


@contextmanager
def opened(path: str) -> Iterator[zipfile.ZipFile]:
    """An archive that is read by seeking."""
    system, own = _system(path)
    with system.open_input_file(own) as raw, zipfile.ZipFile(raw) as archive:
        yield archive


@dataclass
class Member(InputPartition):
    """One member of one archive; ``sheet`` and ``hidden`` for a worksheet."""

    file: str
    name: str
    sheet: str = ""
    hidden: bool = False


class _Members(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.files, self.schema = matching(options["path"]), schema

    def wanted(self, file: str, archive: zipfile.ZipFile) -> Iterator[Member]:
        raise NotImplementedError

    def partitions(self) -> list[Member]:
        out = []
        for file in self.files:
            with opened(file) as archive:
                out += self.wanted(file, archive)
        return out or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        part: list[tuple] = []
        for row in self.rows(partition):
            part.append(row)
            if len(part) == ROWS:
                yield self.batch(part)
                part = []
        if part:
            yield self.batch(part)

    def rows(self, member: Member) -> Iterator[tuple]:
        raise NotImplementedError

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.bool_() if f.dataType.simpleString() == "boolean" else pa.string() for f in self.schema]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=self.schema.names)


class _CsvMembers(_Members):
    def __init__(self, options: dict[str, str], schema: StructType):
        super().__init__(options, schema)
        self.pattern, self.columns = re.compile(options["member"], re.IGNORECASE), schema.names[2:]

    def wanted(self, file: str, archive: zipfile.ZipFile) -> Iterator[Member]:
        return (Member(file, x.filename) for x in archive.infolist() if not x.is_dir() and self.pattern.search(x.filename))

    def rows(self, member: Member) -> Iterator[tuple]:
        with opened(member.file) as archive, archive.open(member.name) as raw:
            lines = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline=""))
            at = {h.strip().upper(): i for i, h in enumerate(next(lines, []))}
            places = [at.get(c, -1) for c in self.columns]
            for line in lines:
                yield (member.file, member.name, *[line[p] if 0 <= p < len(line) else None for p in places])


def _elements(raw: io.BufferedIOBase, name: str) -> Iterator[ElementTree.Element]:
    """Elements of a local name as they end; what has been passed is let go."""
    events = ElementTree.iterparse(raw, events=("start", "end"))
    _, root = next(events)
    for event, x in events:
        if event == "end" and x.tag.rpartition("}")[2] == name:
            yield x
            x.clear()
            root.clear()


def _texts(element: ElementTree.Element, name: str) -> str:
    return "".join(t.text or "" for t in element.iter() if t.tag.rpartition("}")[2] == name)


class _Sheets(_Members):
    def wanted(self, file: str, archive: zipfile.ZipFile) -> Iterator[Member]:
        names = set(archive.namelist())
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")).iter() if r.get("Id")}
        for x in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter():
            if x.tag.rpartition("}")[2] == "sheet":
                target = links.get(x.get(RELATION), "").lstrip("/")
                path = target if target.startswith("xl/") else f"xl/{target}"
                if path in names:
                    yield Member(file, path, x.get("name"), x.get("state", "visible") != "visible")

    def rows(self, member: Member) -> Iterator[tuple]:
        with opened(member.file) as archive:
            shared: list[str] = []
            if "xl/sharedStrings.xml" in archive.namelist():
                with archive.open("xl/sharedStrings.xml") as raw:
                    shared = [_texts(x, "t") for x in _elements(raw, "si")]
            with archive.open(member.name) as raw:
                for row in _elements(raw, "row"):
                    for cell in row:
                        kind = cell.get("t")
                        value = next((v.text for v in cell.iter() if v.tag.rpartition("}")[2] == "v"), None)
                        text = value if value is not None else _texts(cell, "t")
                        if text and kind == "s":
                            text = shared[int(text)]
                        elif text and kind == "b":
                            text = "TRUE" if text == "1" else "FALSE"
                        elif text and kind in (None, "n"):
                            text = re.sub(r"\.0$", "", text)
                        if text:
                            yield member.file, member.sheet, member.hidden, cell.get("r"), text


class ZippedCsv(DataSource):
    """``zipped_csv``: options ``path`` and ``member`` (a pattern of names, ignoring case); the schema has file, member and upper-case columns."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CsvMembers(self.options, schema)


class WorkbookSheets(DataSource):
    """``workbook_sheets``: option ``path``; the cells of each sheet, as ``workbooks.workbook_cells`` has them."""

    @classmethod
    def name(cls) -> str:
        return "workbook_sheets"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Sheets(self.options, schema)


def csv_members(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """``(file, member, columns...)``, all text, of the CSV members that match, one partition each.

    Headers count in upper case, without a byte order mark; a missing column or cell is null. An archive without such members gives no rows.
    """
    spark.dataSource.register(ZippedCsv)
    schema = ", ".join(["file string", "member string", *[f"`{c.upper()}` string" for c in columns]])
    return spark.read.format("zipped_csv").schema(schema).option("member", member).load(path)


def sheet_cells(spark: SparkSession, path: str) -> DataFrame:
    """``(file, sheet, hidden, cell, value)`` of all workbooks at ``path``, one partition for each sheet; cells that hold nothing are left out."""
    spark.dataSource.register(WorkbookSheets)
    return spark.read.format("workbook_sheets").load(path)
