"""Workbooks (XLSX): each sheet is made by a task of its own as a compressed part, and a book is put together from its parts.

A sheet has at most MOST_ROWS rows, the format's limit, so a group is bounded; parts carry their size and checksum, from
which the archive's directory follows without unpacking them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS, MOST_NAME = 1 << 20, 31
NS = "http://schemas.openxmlformats.org/"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
STYLES = (
    f'{HEAD}<styleSheet xmlns="{NS}spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'
)


def sheet_name(text: Column) -> Column:
    """A name that spreadsheet programs take: none of ``\\ / ? * [ ] :``, blanks as one, at most 31 characters, no quote at either end, and neither empty nor ``History``."""
    clean = F.left(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\\\/?*\\[\\]:]", " "), "\\s+", " ")), F.lit(MOST_NAME))
    clean = F.trim(F.regexp_replace(clean, "^'+|'+$", ""))
    return F.when((clean == "") | (F.lower(clean) == "history"), "Sheet").otherwise(clean)


def unique_names(names: Sequence[str]) -> list[str]:
    """The names, with `` (2)``, `` (3)`` and so on where one is there already, whatever its case."""
    seen, out = set(), []
    for name in names:
        own, n = name, 1
        while own.lower() in seen:
            n += 1
            end = f" ({n})"
            own = name[: MOST_NAME - len(end)] + end
        seen.add(own.lower())
        out.append(own)
    return out


def _letters(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _plain(text: str) -> str:
    """Text without the control characters that XML can't hold."""
    return "".join(c for c in text if c >= " " or c in "\t\n\r")


def _cell(value: object, ref: str, style: str) -> str:
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}"{style} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and abs(value) != float("inf"):
        return f'<c r="{ref}"{style}><v>{value!r}</v></c>'
    return f'<c r="{ref}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(_plain(str(value)))}</t></is></c>'


def sheet_xml(header: Sequence[str], rows: Iterable[Sequence], widths: Sequence[int] = ()) -> Iterator[bytes]:
    """The parts of a worksheet: a bold header row and the rows; numbers and truth values as such, all else as text in place."""
    columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    yield f'{HEAD}<worksheet xmlns="{NS}spreadsheetml/2006/main">{f"<cols>{columns}</cols>" if columns else ""}<sheetData>'.encode()
    letters = [_letters(i) for i in range(1, len(header) + 1)]
    for r, row in enumerate(chain([header], rows), 1):
        style = ' s="1"' if r == 1 else ""
        yield f'<row r="{r}">{"".join(_cell(v, f"{c}{r}", style) for c, v in zip(letters, row, strict=True))}</row>'.encode()
    yield b"</sheetData></worksheet>"


def packed(parts: Iterator[bytes]) -> tuple[bytes, int, int]:
    """(deflated data, checksum, size) of a stream."""
    deflate, out, crc, size = zlib.compressobj(6, zlib.DEFLATED, -15), [], 0, 0
    for part in parts:
        crc, size = zlib.crc32(part, crc), size + len(part)
        out.append(deflate.compress(part))
    out.append(deflate.flush())
    return b"".join(out), crc, size


def archive(entries: Sequence[tuple[str, bytes, int, int]]) -> bytes:
    """A ZIP archive of (name, deflated data, checksum, size), with one time for all files."""
    local, central, at = [], [], 0
    for name, data, crc, size in entries:
        common = struct.pack("<HHHHHIIIHH", 20, 0x800, 8, 0, 33, crc, len(data), size, len(name.encode()), 0)
        central.append(b"PK\1\2" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, at) + name.encode())
        local += [b"PK\3\4" + common + name.encode(), data]
        at += 30 + len(name.encode()) + len(data)
    listed = b"".join(central)
    return b"".join([*local, listed, b"PK\5\6", struct.pack("<HHHHIIH", 0, 0, len(entries), len(entries), len(listed), at, 0)])


def book(names: Sequence[str], sheets: Sequence[tuple[bytes, int, int]]) -> bytes:
    """A workbook of packed sheets under their names."""
    office, package = f"{NS}officeDocument/2006/relationships", f"{NS}package/2006/relationships"
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    count = range(1, len(names) + 1)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{NS}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/>'
        f'<Override PartName="/xl/styles.xml" ContentType="{main}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{main}.worksheet+xml"/>' for i in count) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{NS}spreadsheetml/2006/main" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in count) + f'<Relationship Id="rId{len(names) + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": STYLES.removeprefix(HEAD),
    }
    fixed = [(name, *packed(iter([(HEAD + text).encode()]))) for name, text in parts.items()]
    return archive([*fixed, *((f"xl/worksheets/sheet{i}.xml", *sheet) for i, sheet in enumerate(sheets, 1))])


def workbooks(rows: DataFrame, book_col: str, sheet_col: str, columns: Sequence[str], order: Sequence[str], widths: Sequence[int] = ()) -> DataFrame:
    """``(book_col, content)``: one workbook for each value of ``book_col`` with one sheet for each of ``sheet_col``, in its order.

    A sheet has ``columns`` under a header of their names, its rows by ``order``, nulls first. Null books and sheets count as
    values; their sheets are named ``Sheet``. A sheet above MOST_ROWS rows is an error; an empty table gives no books.
    """
    kind = rows.schema[book_col].dataType.simpleString()

    def one_sheet(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) >= MOST_ROWS:
            raise ValueError(f"a sheet of {len(frame)} rows; at most {MOST_ROWS - 1} fit")
        frame = frame.sort_values([f"o{i}" for i in range(len(order))], kind="stable", na_position="first") if order else frame
        values = zip(*(frame[f"c{i}"].astype(object).where(frame[f"c{i}"].notna(), None).tolist() for i in range(len(columns))), strict=True)
        data, crc, size = packed(sheet_xml(columns, values, widths))
        first = frame.iloc[0]
        return pd.DataFrame({"book": [first["book"]], "sheet": [first["sheet"]], "name": [first["name"]], "data": [data], "crc": [crc], "size": [size]})

    def one_book(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sheet", na_position="last")
        sheets = list(zip(frame["data"], frame["crc"].astype(int), frame["size"].astype(int), strict=True))
        return pd.DataFrame({"book": [frame.iloc[0]["book"]], "content": [book(unique_names(frame["name"].tolist()), sheets)]})

    made = rows.select(F.col(book_col).alias("book"), F.col(sheet_col).cast("string").alias("sheet"), sheet_name(F.col(sheet_col).cast("string")).alias("name"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    parts = made.groupBy("book", "sheet").applyInPandas(one_sheet, f"book {kind}, sheet string, name string, data binary, crc bigint, size bigint")
    return parts.groupBy("book").applyInPandas(one_book, f"book {kind}, content binary").withColumnRenamed("book", book_col)


def section_rows(fields: DataFrame, doc_col: str) -> DataFrame:
    """``fields`` with ``sheet``, ``variant`` filled and ``variants``: the sheet is the section's letter and name, a document without a named variant is ``Main``.

    ``fields`` has (doc_col, section, section_name, variant). ``variants`` says how many variants the document has: where it
    is above 1 its sheets need the column ``variant``.
    """
    own = fields.groupBy(doc_col).agg(F.count_distinct(F.coalesce("variant", F.lit(""))).alias("variants"))
    return fields.join(own, doc_col).withColumns({"sheet": F.concat_ws(" ", "section", "section_name"), "variant": F.coalesce("variant", F.lit("Main"))})


def write_workbooks(books: DataFrame, book_col: str, folder: str) -> DataFrame:
    """Writes each workbook as a file of ``folder``, named by its book, and returns ``(file, bytes)`` of the files.

    Names keep letters, digits, points, dashes and low lines; all else is a dash. Tasks write by the scheme of ``folder`` (as Arrow
    knows it), each file under another name first, so that a task that runs twice leaves whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        where.create_dir(top, recursive=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1), strict=True):
                with where.open_output_stream(f"{top}/.{name}") as out:
                    out.write(content.as_buffer())
                where.move(f"{top}/.{name}", f"{top}/{name}")
                sizes.append(len(content.as_buffer()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    name = F.concat(F.regexp_replace(F.coalesce(F.col(book_col).cast("string"), F.lit("")), "[^A-Za-z0-9._-]", "-"), F.lit(".xlsx"))
    return books.select(name.alias("file"), "content").mapInArrow(run, "file string, bytes bigint")
