"""Excel workbooks (.xlsx) as a data source: rows of cells, by file, sheet and range of rows."""

from __future__ import annotations

import io
import json
import re
import zipfile
from functools import lru_cache
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestream.storage import cut, small

from .files import listed, opened

_SCHEMA = "file string, sheet string, row long, cells array<string>"
#: Rows of a sheet that one task reads.
ROWS_A_TASK = 100_000
#: Tasks beyond which a task reads several ranges.
TASKS = 256
#: Rows of a batch.
_BATCH = 2000
_ARROW = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))])
_STRINGS = "xl/sharedStrings.xml"
_REF = re.compile(r"([A-Z]+)(\d+)")


@lru_cache(maxsize=4096)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _name(element) -> str:
    """Name of an element without its namespace."""
    return _local(element.tag)


@lru_cache(maxsize=20_000)
def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(element) -> str:
    """Text of a string element: its runs in order, without phonetic hints."""
    parts = []
    for child in element:
        if _name(child) == "t":
            parts.append(child.text or "")
        elif _name(child) == "r":
            parts.extend(t.text or "" for t in child if _name(t) == "t")
    return "".join(parts)


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of the sheets, in the book's order, and the parts that hold them."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for element in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _name(element) == "sheet":
            key = next(v for k, v in element.attrib.items() if k.rpartition("}")[2] == "id" and k != "id")
            target = targets[key]
            out.append((element.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _last_row(book: zipfile.ZipFile, part: str) -> int | None:
    """The last row that the sheet says it has; the rows themselves aren't read."""
    parser = ElementTree.XMLPullParser(("start",))
    with book.open(part) as f:
        while piece := f.read(512):
            parser.feed(piece)
            for _, element in parser.read_events():
                if _name(element) == "dimension":
                    found = _REF.findall(element.get("ref", ""))
                    return int(found[-1][1]) if found else None
                if _name(element) == "sheetData":
                    return None
    return None


@lru_cache(maxsize=2)
def _strings_of(path: str, crc: int) -> list[str]:
    with opened(path) as f, zipfile.ZipFile(f) as book:
        out = []
        with book.open(_STRINGS) as part:
            for _, element in ElementTree.iterparse(part):
                if _name(element) == "si":
                    out.append(_text(element))
                    element.clear()
        return out


def _strings(path: str, book: zipfile.ZipFile) -> list[str]:
    """The shared strings of a book; a worker that reads ranges of one book keeps them."""
    return _strings_of(path, book.getinfo(_STRINGS).CRC) if _STRINGS in book.namelist() else []


def _value(cell, strings: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        for x in cell:
            if _local(x.tag) == "is":
                return _text(x)
        return None
    raw = None
    for x in cell:
        if _local(x.tag) == "v":
            raw = x.text
            break
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(raw)]
    return {"0": "FALSE", "1": "TRUE"}.get(raw, raw) if kind == "b" else raw


def _rows(book: zipfile.ZipFile, part: str, strings: list[str], first: int, last: int | None):
    """(number, cells) of the rows of a range; the part is read as a stream and left after the range."""
    number = 0
    with book.open(part) as f:
        parents = []
        for event, element in ElementTree.iterparse(f, ("start", "end")):
            tag = element.tag
            if event == "start":
                if tag.endswith("sheetData") and _local(tag) == "sheetData":
                    parents.append(element)
                continue
            if not tag.endswith("row") or _local(tag) != "row":
                continue
            number = int(element.get("r", number + 1))
            if last is not None and number > last:
                return
            if number >= first:
                cells: list[str | None] = []
                for cell in element:
                    found = _REF.match(cell.get("r", ""))
                    at = _column(found[1]) if found else len(cells)
                    if at == len(cells):
                        cells.append(_value(cell, strings))
                        continue
                    cells.extend([None] * (at + 1 - len(cells)))
                    cells[at] = _value(cell, strings)
                yield number, cells
            for parent in parents:  # rows that were read don't stay
                parent.clear()


class _Ranges(InputPartition):
    """Ranges of rows that a task reads: path, sheet, its part, first and last row."""

    def __init__(self, ranges: list[tuple[str, str, str, int, int | None]]):
        self.ranges = ranges


def _bundled(ranges: list[tuple], sizes: list[int], rows: int) -> list[list[tuple]]:
    """Neighbours of `rows` rows together as one list, in which ranges of a sheet that follow each other are one."""
    out: list[list[tuple]] = []
    total = 0
    for own, size in zip(ranges, sizes):
        if not out or total + size > rows:
            out.append([])
            total = 0
        total += size
        before = out[-1][-1] if out[-1] else None
        if before and before[:3] == own[:3] and before[4] is not None and before[4] + 1 == own[3]:
            out[-1][-1] = (*before[:4], own[4])
        else:
            out[-1].append(own)
    return out


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.rows_a_task = json.loads(options["paths"]), int(options.get("rows_a_task", ROWS_A_TASK))
        self.sheets = json.loads(options.get("sheets", "null"))
        self.first, self.last = int(options.get("first_row", 1)), int(options["last_row"]) if "last_row" in options else None

    def partitions(self):
        """A task a range of `rows_a_task` rows; of more than TASKS ranges, as of many small books, several are a task's."""
        out, sizes = [], []
        for path in self.paths:
            with opened(path) as f, zipfile.ZipFile(f) as book:
                for name, part in _sheets(book):
                    if self.sheets is not None and name not in self.sheets:
                        continue
                    end, start = _last_row(book, part), self.first
                    while (end or 0) - start >= self.rows_a_task and (self.last is None or start + self.rows_a_task <= self.last):
                        out.append((path, name, part, start, start + self.rows_a_task - 1))
                        sizes.append(self.rows_a_task)
                        start += self.rows_a_task
                    if self.last is None or start <= self.last:  # to the end, wherever the sheet says that it is
                        out.append((path, name, part, start, self.last))
                        sizes.append(self.rows_a_task if end is None else max(1, min(end, self.last or end) - start + 1))
        rows = min(max(self.rows_a_task, ROWS_A_TASK), max(self.rows_a_task, sum(sizes) // TASKS)) if len(out) > TASKS else 0
        return [_Ranges(ranges) for ranges in _bundled(out, sizes, rows)]

    def read(self, partition):
        if partition is None:  # nothing is left to read
            return
        for path, name, part, first, last in partition.ranges:
            with opened(path) as f, zipfile.ZipFile(f) as book:
                rows = _rows(book, part, _strings(path, book), first, last)
                while some := list(islice(rows, _BATCH)):
                    numbers, values = zip(*some)
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([name] * n), pa.array(numbers, pa.int64()), pa.array(values, _ARROW.field("cells").type)], schema=_ARROW)


class ExcelSource(DataSource):
    """Format `excel`: options paths and sheets (JSON lists), first_row, last_row and rows_a_task."""

    @classmethod
    def name(cls):
        return "excel"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def cells(spark: SparkSession, path: str, sheets: list[str] | None = None, first_row: int = 1, last_row: int | None = None, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Rows of the workbooks at `path` (a file, or a folder of them): file, sheet, row (from 1) and cells as
    text, null where a cell is empty or an error. Rows without cells may be missing, as in the file.

    Only the named sheets (all by default) and rows first_row to last_row are read. They are arguments and no pushed
    filters, since Spark 4.1 keeps these by table: a frame that is read twice, with two filters, would get one of them.
    """
    spark.dataSource.register(ExcelSource)
    options = {"paths": json.dumps(listed(spark, path, ".xlsx")), "rows_a_task": str(rows_a_task), "first_row": str(first_row)}
    if sheets is not None:
        options["sheets"] = json.dumps(sheets)
    if last_row is not None:
        options["last_row"] = str(last_row)
    return spark.read.format("excel").options(**options).load()


def number(text: Column) -> Column:
    """A cell as a number, null where it isn't one."""
    return F.trim(text).try_cast("double")


def below_header(rows: DataFrame, start: str, skip: int = 2) -> DataFrame:
    """Of every sheet the rows from `skip` rows below the first whose first cell begins with `start` (case and
    outer blanks don't matter), with its cells as `header`; sheets without such a row give none. Files are read once."""
    rows = cut(rows)
    first = F.lower(F.trim(F.get("cells", F.lit(0))))
    heads = rows.where(first.startswith(start.lower())).groupBy("file", "sheet").agg(F.min_by(F.struct("row", "cells"), "row").alias("head"))
    found = rows.join(small(cut(heads)), ["file", "sheet"]).where(F.col("row") >= F.col("head.row") + skip)
    return found.select("file", "sheet", "row", "cells", F.col("head.cells").alias("header"))


def blocks(rows: DataFrame, starts: list[int], names: list[str], title_row: int, first_row: int) -> DataFrame:
    """Blocks of columns side by side as rows below each other: file, sheet, row, block (its first column, from 0),
    title (the block's cell of `title_row`) and a column of text for each of `names`. Rows count from 1; a block without
    a title, and rows whose first cell of the block is no number, are left out. Files are read once."""
    wide = cut(rows.where(F.col("row") >= min(title_row, first_row)))
    block = F.explode(F.array(*[F.lit(s) for s in starts]))
    stacked = wide.select("file", "sheet", "row", "cells", block.alias("block"))
    stacked = stacked.select("file", "sheet", "row", "block", *[F.get("cells", F.col("block") + i).alias(n) for i, n in enumerate(names)])
    titles = stacked.where(F.col("row") == title_row).select("file", "sheet", "block", F.trim(names[0]).alias("title")).where("title <> ''")
    data = stacked.where((F.col("row") >= first_row) & number(F.col(names[0])).isNotNull())
    return data.join(titles, ["file", "sheet", "block"]).select("file", "sheet", "row", "block", "title", *names)


def workbook(sheets: dict[str, list[list]], shared: bool = True) -> bytes:
    """A workbook of these sheets, rows of cells (None, text, numbers or booleans), as a file's bytes."""
    strings: dict[str, int] = {}

    def letters(k):
        out = ""
        while k >= 0:
            k, r = divmod(k, 26)
            out, k = chr(65 + r) + out, k - 1
        return out

    def quoted(v):
        return str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def cell(v, ref):
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        if shared:
            return f'<c r="{ref}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{quoted(v)}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for k, rows in enumerate(sheets.values(), 1):
            width = max([len(r) for r in rows], default=1) or 1
            body = "".join(
                f'<row r="{i}">' + "".join(cell(v, f"{letters(j)}{i}") for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows, 1) if r
            )
            book.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><dimension ref="A1:{letters(width - 1)}{max(1, len(rows))}"/><sheetData>{body}</sheetData></worksheet>')
        listed_sheets = "".join(f'<sheet name="{quoted(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed_sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}<Relationship Id="rId0" Type="{office}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
        if shared:
            book.writestr(_STRINGS, f'<sst xmlns="{main}">' + "".join(f'<si><t xml:space="preserve">{quoted(s)}</t></si>' for s in strings) + "</sst>")
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    return out.getvalue()
