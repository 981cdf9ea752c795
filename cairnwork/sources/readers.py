"""Readers beyond plain tables: guarded scans, CSV members of ZIP files, schema files, link lists and format marks."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.functions.scalars import academic_year


def guarded(df: DataFrame, most: int) -> DataFrame:
    """``df``, or an error if it has more than ``most`` rows: it refuses where a cap would cut."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def zipped_csv(spark: SparkSession, path: str, member: str, columns: Sequence[str], rows: int = 10_000) -> DataFrame:
    """``(file, columns...)``, all text, of the CSV files in ZIP archives whose name matches ``member`` (a pattern, ignoring case).

    One archive is one task's work; its members are read as streams, ``rows`` rows at a time.
    Headers count in upper case, without a byte order mark; a missing column or cell is null.
    """
    import re

    names, wanted = [c.upper() for c in columns], re.compile(member, re.IGNORECASE)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in filter(wanted.search, archive.namelist()):
                        with archive.open(name) as raw:
                            reader = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline=""))
                            at = {h.strip().upper(): i for i, h in enumerate(next(reader, []))}
                            part = []
                            for line in reader:
                                part.append([source, *[line[at[c]] if c in at and at[c] < len(line) else None for c in names]])
                                if len(part) == rows:
                                    yield pd.DataFrame(part, columns=["file", *names], dtype=object)
                                    part = []
                            if part:
                                yield pd.DataFrame(part, columns=["file", *names], dtype=object)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, ", ".join(["file string", *[f"`{c}` string" for c in names]]))


def schema_fields(spark: SparkSession, path: str) -> DataFrame:
    """One row for each entry of ``fields`` in JSON schema files, with the file's version."""
    files = spark.read.option("multiLine", True).json(path)
    return files.select("schema_version", F.explode("fields").alias("f")).select("schema_version", "f.*")


def anchors(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id_col, position, href, label)``: the links of each page in order, quoted in any way; tags in a label are dropped."""
    pattern = F.lit("(?is)<a\\s[^>]*?href\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))[^>]*>(.*?)</a>")
    found = {n: F.regexp_extract_all(html_col, pattern, k).alias(n) for k, n in ((1, "a"), (2, "b"), (3, "c"), (4, "label"))}
    links = pages.select(id_col, F.posexplode(F.arrays_zip(*found.values())).alias("position", "x"))
    href = F.concat("x.a", "x.b", "x.c")  # two of the three are empty
    return links.select(id_col, "position", href.alias("href"), F.trim(F.regexp_replace("x.label", "<[^>]*>", "")).alias("label"))


class _Links(HTMLParser):
    """Collects (href, words) of links; comments, scripts and what quotes hold are no tags, and a link ends where the next begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[str, list[str]]] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            href = dict(attrs).get("href")
            self.open = href is not None
            if href is not None:
                self.links.append((href.strip(), []))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.open and self.cdata_elem is None:
            self.links[-1][1].append(data)


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id_col, position, href, label)``: the links of each page in order by its tags, from 0; white space in a label counts as one blank.

    Where ``anchors`` reads a page by one pattern inside the JVM, this follows its tags: a sign in a quoted attribute, a comment, a tag inside
    a label and a missing end tag change nothing. Null pages have no links.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, html in zip(frame["id"], frame["html"], strict=True):
                parser = _Links()
                parser.feed(html or "")
                parser.close()
                out += [(page, i, href, " ".join("".join(words).split())) for i, (href, words) in enumerate(parser.links)]
            yield pd.DataFrame(out, columns=["id", "position", "href", "label"])

    named = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return named.mapInPandas(run, f"id {kind}, position int, href string, label string").withColumnRenamed("id", id_col)


def described_anchors(links: DataFrame) -> DataFrame:
    """``links`` with kind (document or subpage), filename, year and year_source (filename, url_path, link_text or unknown), section letter, is_section, is_test and is_reference."""
    path = F.regexp_extract("href", "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    name = F.regexp_extract(path, "([^/]*)$", 1)
    low = F.lower(name)
    years = {"filename": academic_year(name), "url_path": academic_year(path), "link_text": academic_year(F.col("label"))}
    source = F.lit("unknown")
    for label, year in reversed(years.items()):
        source = F.when(year.isNotNull(), label).otherwise(source)
    section = F.nullif(F.upper(F.regexp_extract(name, "(?i)(?:^|[_\\- ])(?:section|sec|part)[_\\- ]*([A-J])(?:[_\\-. ]|$)", 1)), F.lit(""))
    return links.withColumns({
        "kind": F.when(low.rlike("\\.(pdf|xlsx?|docx?)$"), "document").otherwise("subpage"), "filename": name, "year": F.coalesce(*years.values()), "year_source": source, "section": section,
        "is_section": section.isNotNull(), "is_test": low.rlike("(^|[_\\- ])(test|draft|sample)([_\\-. ]|$)"), "is_reference": low.rlike("definition|instruction|appendix|template"),
    })


def format_of(content: Column) -> Column:
    """pdf, xlsx, docx, zip, html or other by a file's first bytes and, for archives, the names of their members."""
    head = F.substring(content, 1, 512).cast("string")
    text, packed = F.lower(F.ltrim(head)), F.substring(content, 1, 4) == F.lit(b"PK\x03\x04")
    return F.when(F.substring(content, 1, 5) == F.lit(b"%PDF-"), "pdf").when(packed & F.contains(content, F.lit(b"xl/workbook.xml")), "xlsx").when(packed & F.contains(content, F.lit(b"word/document.xml")), "docx").when(packed, "zip").when(text.startswith("<!doctype html") | text.startswith("<html"), "html").otherwise("other")


def mapped_columns(wide: DataFrame, ids: Sequence[str], columns: dict[str, tuple[Sequence[str], str]]) -> DataFrame:
    """``wide`` text columns under new names and types: for each, the first of the given columns that holds a value.

    Words for a missing value (NULL, PrivacySuppressed, PS, NA) and blanks count as none, as does text that isn't of the type.
    """

    def value(name: str, kind: str) -> Column:
        text = F.trim(F.col(name).cast("string"))
        return F.when(~text.isin("", "NULL", "PrivacySuppressed", "PS", "NA"), text).try_cast(kind)

    return wide.select(*ids, *[F.coalesce(*[value(c, kind) for c in names]).alias(out) for out, (names, kind) in columns.items()])


# Tags whose text isn't shown, and tags that begin a line.
HIDDEN_TAGS = ("script", "style", "head", "noscript", "svg")
LINE_TAGS = ("p", "div", "br", "li", "ul", "ol", "section", "article", "tr", "hr", "h1", "h2", "h3", "h4", "h5", "h6")


class _Markdown(HTMLParser):
    """Collects headings, text and tables of a page; tables in cells are read as text of the cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.words: list[str] = []
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.hidden = self.depth = 0
        self.span = 1

    def close_line(self, prefix: str = "") -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.lines.append(prefix + text)

    def close_cell(self) -> None:
        if self.cell is not None and self.rows:
            text = " ".join("".join(self.cell).split()).replace("|", "/")
            self.rows[-1] += [text] + [""] * (self.span - 1)
        self.cell, self.span = None, 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        elif tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.close_line()
                self.rows = []
        elif self.depth == 1 and tag == "tr":
            self.close_cell()
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self.close_cell()
            if not self.rows:
                self.rows.append([])
            wide = dict(attrs).get("colspan") or ""
            self.cell, self.span = [], min(50, int(wide)) if wide.isdigit() and int(wide) > 0 else 1
        elif not self.depth and tag in LINE_TAGS:
            self.close_line()
        elif self.depth and tag in ("br", "p", "li"):
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.depth:
            if self.depth == 1:
                self.close_cell()
                rows = [r for r in self.rows if any(r)]
                width = max((len(r) for r in rows), default=0)
                for k, row in enumerate(rows):
                    self.lines.append("| " + " | ".join(row + [""] * (width - len(row))) + " |")
                    if not k:
                        self.lines.append("|" + "---|" * width)
                self.rows = None
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self.close_cell()
        elif not self.depth and tag in LINE_TAGS:
            self.close_line("#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else "- " if tag == "li" else "")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            if not self.depth:
                self.words.append(data)
            elif self.cell is not None:
                self.cell.append(data)


def page_markdown(html: str | None) -> str:
    """(Cells that span over 50 columns count as 50.) Headings, lines of text and pipe tables of a page; empty for null. Cells over several columns leave empty ones after them."""
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    parser.close_line()
    return "\n".join(parser.lines)


def markdown_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id_col, markdown)`` of each page, a page at a time in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({id_col: frame[id_col], "markdown": [page_markdown(x) for x in frame[html_col]]})

    return pages.select(id_col, html_col).mapInPandas(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, markdown string")


def form_values(values: DataFrame, tags: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc, field, value), tags that are not known) of filled form fields.

    ``values`` has (doc, tag, raw), ``tags`` (tag, field) and ``options`` (tag, code, label): what the
    export code of a button stands for. Codes without a label are kept as they are; blank
    values and switched off buttons are left out.
    """
    given = values.withColumn("raw", F.trim("raw")).where(~F.col("raw").isin("", "/Off", "Off"))
    known = given.join(tags, "tag").join(options.withColumnRenamed("code", "raw"), ["tag", "raw"], "left")
    bare = F.regexp_replace("raw", "^/", "")
    return known.select("doc", "field", F.coalesce("label", bare).alias("value")), given.join(tags, "tag", "left_anti").select("tag").distinct()


def target_units(corpus: DataFrame) -> DataFrame:
    """(school, unit) of ``corpus (id, units array<string>)``: each unit of a school, and the school itself where it has none."""
    return corpus.select(F.col("id").alias("school"), F.explode_outer("units").alias("unit"))
