"""Workbooks (xlsx) as the Spark data source ``workbook``.

Read: ``spark.read.format("workbook").option("sheet", name).load(folder or file)``. A partition is one file's sheet; the task
streams its rows out of the sheet's XML, some thousands at a time (``sheetrows``), and holds the file's shared strings, nothing
else. Bytes that are not in plain form are parsed cell by cell. All cells come as text, with
``row_no``, the row's number in the sheet: numbers as short as they can be written, dates as yyyy-MM-dd (with a time of day
where they have one), booleans as True and False, empty cells and errors as null. Rows without cells that lie between others
are rows of nulls. The columns are the first file's headers; other files' columns are found by their headers. A sheet has at most
a million rows, so a larger one goes on in further workbooks ``name.after-n.xlsx``, whose rows are numbered as those after n rows.

Write: rows (file, number of the sheet, cells in one text) that are ordered within a task, each file's rows in one task, as
``write_workbooks`` makes them. A task streams its files into a temporary folder; they take their places when all tasks are done.

Files are reached by ``pyarrow.fs`` (local paths, file://, hdfs://, s3://, gs://), on the executors. Both classes are pickled
by value, so that executors need no copy of this package.
"""

from __future__ import annotations

import datetime
import json
import posixpath
import re
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.internal import InternalFunction

from . import sheetrows

#: Rows of a sheet, the header included: a limit of the format.
MAX_ROWS = 1_048_576
#: Rows of a sheet after which a continued workbook goes on in a further file, about.
PART_ROWS = 400_000
#: Rows that are put into XML at once, and how hard a written workbook is compressed (1 to 9).
PIECE, DEFLATE = 10_000, 1
#: The name of a file that continues another one: so many of its rows come before.
CONTINUED = re.compile(r"\.after-(\d+)\.xlsx$")
#: What is between cells of a row that is to be written: a character that XML cannot hold.
BETWEEN = "\x1f"
# Fixed values of the format: days are counted from here, number formats that are dates, and what makes a custom one a date.
EPOCHS = {False: datetime.datetime(1899, 12, 30), True: datetime.datetime(1904, 1, 1)}
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DATE_CODE = re.compile(r"[dmyhs]", re.IGNORECASE)
NOT_CODE = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
DATA, ROW, TEXT = (f"{{{MAIN}}}{x}" for x in ("sheetData", "row", "t"))
#: Bytes of a sheet's XML that are taken at once, and beyond which a piece of it without the end of a row is parsed as it comes.
CHUNK, LONGEST = 1 << 20, 1 << 24
ENCODING = re.compile(rb"""<\?xml[^>]*encoding=["']([^"']*)["']""")


def file_system(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else posixpath.abspath(path))


def files(path: str) -> list[str]:
    """The workbooks of a folder, or the one file, as paths of its file system."""
    from pyarrow import fs

    store, at = file_system(path)
    if store.get_file_info(at).type == fs.FileType.File:
        return [at]
    found = store.get_file_info(fs.FileSelector(at))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".xlsx") and f.base_name[0] not in "._~")


def _name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


class Book:
    """One opened workbook."""

    def __init__(self, path: str, at: str):
        self._zip = zipfile.ZipFile(file_system(path)[0].open_input_file(at))
        book = self._xml("xl/workbook.xml")
        links = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets = {s.get("name"): self._place(links[s.get(f"{{{LINKS}}}id")]) for s in book.iter(f"{{{MAIN}}}sheet")}
        self.epoch = EPOCHS[any(p.get("date1904") in ("1", "true") for p in book.iter(f"{{{MAIN}}}workbookPr"))]

    def __enter__(self) -> Book:
        return self

    def __exit__(self, *_) -> None:
        self._zip.close()

    @staticmethod
    def _place(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self._zip.read(name))

    @cached_property
    def _shared(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self._zip.namelist():
            return []
        out = []
        with self._zip.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if _name(e) == "si":
                    out.append(_text(e))
                    e.clear()
        return out

    @cached_property
    def _dates(self) -> set[int]:
        """Numbers of the cell styles that are dates."""
        if "xl/styles.xml" not in self._zip.namelist():
            return set()
        styles = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): bool(DATE_CODE.search(NOT_CODE.sub("", f.get("formatCode", "")))) for f in styles.iter(f"{{{MAIN}}}numFmt")}
        used = [int(x.get("numFmtId", 0)) for xs in styles.iter(f"{{{MAIN}}}cellXfs") for x in xs]
        return {k for k, n in enumerate(used) if own.get(n, n in DATE_FORMATS)}

    def _number(self, text: str, is_date: bool) -> str:
        x = float(text)
        if is_date:
            at = self.epoch + datetime.timedelta(days=round(x * 86400) / 86400)
            return at.strftime("%Y-%m-%d" if at.time() == datetime.time() else "%Y-%m-%d %H:%M:%S")
        return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)

    def rows(self, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
        """(number, cells) of the sheet's rows, as the XML has them."""
        parsed = Parsed(self)
        with self._zip.open(self.sheets[sheet]) as f:
            while data := f.read(1 << 14):
                yield from parsed.rows(data)
            yield from parsed.rows(None)

    def pieces(self, sheet: str, width: int) -> Iterator[sheetrows.Rows | list[tuple[int, list[str | None]]]]:
        """The same in pieces: arrays, with the first ``width`` cells of each row, or where the XML is not plain as ``rows`` has them."""
        parsed, rest, plain = Parsed(self), b"", None
        with self._zip.open(self.sheets[sheet]) as f:
            while data := f.read(CHUNK):
                data, rest = rest + data, b""
                if plain is None:  # the first piece: what comes before the rows is always parsed
                    head = data.find(b"<sheetData>") + len(b"<sheetData>")
                    encoding = ENCODING.match(data.removeprefix(b"\xef\xbb\xbf"))
                    plain = head >= len(b"<sheetData>") and b"<!" not in data[:head] and (not encoding or encoding[1].lower() in (b"utf-8", b"us-ascii"))
                    if plain:
                        yield list(parsed.rows(data[:head]))
                        data, plain = data[head:], parsed.top is not None
                if plain:
                    end = data.rfind(b"</row>") + len(b"</row>")
                    if end >= len(b"</row>"):
                        data, rest = data[:end], data[end:]
                    elif len(data) < LONGEST:
                        rest = data
                        continue
                    found = sheetrows.plain(data, width, parsed.nth, self._value)
                    if found:
                        parsed.nth = int(found.numbers[-1])
                        yield found
                        continue
                    # What begins in such a piece may end in a later one.
                    plain = not any(x in data for x in (b"<!", b"<?", b"</sheetData", b"<sheetData"))
                yield list(parsed.rows(data if plain else data + rest))
                rest = rest if plain else b""
            yield [*parsed.rows(rest), *parsed.rows(None)]

    def cell(self, c: ElementTree.Element) -> str | None:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            plain = len(c) == 1 and len(c[0]) == 1 and c[0][0].tag == TEXT
            return (c[0][0].text if plain else _text(c)) or None
        value = next((e.text for e in c if _name(e) == "v"), None)
        return self._value(kind, value, int(c.get("s", 0))) if value else None

    def _value(self, kind: str, value: str, style: int) -> str | None:
        if kind == "e":
            return None
        if kind == "s":
            return self._shared[int(value)] or None
        if kind == "b":
            return "True" if value == "1" else "False"
        return self._number(value, style in self._dates) if kind == "n" else value

    def header(self, sheet: str) -> list[str]:
        """The first row's names; an empty one is named by its place, a repeated one numbered."""
        _, cells = next(self.rows(sheet), (0, []))
        names: list[str] = []
        for k, c in enumerate(cells):
            name = c if c is not None else f"Unnamed: {k}"
            n = sum(x == name or re.fullmatch(re.escape(name) + r"\.\d+", x) is not None for x in names)
            names.append(f"{name}.{n}" if n else name)
        return names


class Parsed:
    """Rows of a sheet's XML as an XML parser finds them in what it is given, piece after piece."""

    def __init__(self, book: Book):
        self._book, self._parser = book, ElementTree.XMLPullParser(("start", "end"))
        self.top: ElementTree.Element | None = None
        self.nth = 0

    def rows(self, data: bytes | None) -> Iterator[tuple[int, list[str | None]]]:
        """Rows that end in this piece; None is the end of the XML."""
        self._parser.close() if data is None else self._parser.feed(data)
        for event, e in self._parser.read_events():
            if event == "start":
                self.top = e if self.top is None and e.tag == DATA else self.top
                continue
            if e.tag != ROW:
                continue
            self.nth = int(e.get("r") or self.nth + 1)
            cells: list[str | None] = []
            for c in e:
                ref = c.get("r")
                if ref:
                    cells += [None] * (sheetrows.column(ref) - len(cells))
                cells.append(self._book.cell(c))
            yield self.nth, cells
            self.top.clear()


def _text(e: ElementTree.Element) -> str:
    """All text of a string item but its phonetic hints."""
    return "".join(t.text or "" for part in e if _name(part) != "rPh" for t in part.iter() if _name(t) == "t")


@dataclass
class SheetOfFile(InputPartition):
    file: str


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str, columns: list[str]):
        self.path, self.sheet, self.columns = path, sheet, columns

    def partitions(self) -> list[InputPartition]:
        return [SheetOfFile(f) for f in files(self.path)]

    def read(self, partition: SheetOfFile) -> Iterator[pa.RecordBatch]:
        with Book(self.path, partition.file) as book:
            at = {name: k for k, name in enumerate(book.header(self.sheet))}
            order = [at.get(c, -1) for c in self.columns[:-1]]
            found = CONTINUED.search(partition.file)
            before = int(found[1]) if found else 0
            last = 1
            for piece in book.pieces(self.sheet, len(at)):
                if isinstance(piece, list):
                    numbers, columns = _listed(piece, order, last)
                else:
                    numbers, columns = _taken(piece, order, last)
                if len(numbers):
                    last = int(numbers[-1])
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers + before, pa.int64())], self.columns)


def _listed(rows: list[tuple[int, list[str | None]]], order: list[int], last: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Numbers and columns of rows but the header; rows without cells that lie between others are rows of nulls."""
    numbers: list[int] = []
    out: list[list[str | None]] = []
    for nth, cells in rows:
        if nth == 1 or all(c is None for c in cells):
            continue
        gap = range(last + 1, nth)
        numbers += [*gap, nth]
        out += [[]] * len(gap) + [cells]
        last = nth
    return np.array(numbers, np.int64), [pa.array([cells[k] if 0 <= k < len(cells) else None for cells in out], pa.string()) for k in order]


def _taken(rows: sheetrows.Rows, order: list[int], last: int) -> tuple[np.ndarray, list[pa.Array]]:
    """The same from arrays."""
    kept = np.flatnonzero(rows.filled & (rows.numbers != 1))
    numbers, cells = rows.numbers[kept], rows.cells[kept]
    steps = np.diff(numbers, prepend=last)
    if (steps > 1).any():  # the n-th place of a step's rows is its last one's
        gaps = np.maximum(steps, 1)
        to = np.cumsum(gaps) - 1
        spread = np.full((int(gaps.sum()), cells.shape[1]), -1)
        spread[to] = cells
        numbers, cells = np.repeat(numbers - to, gaps) + np.arange(len(spread)), spread
    none = pa.nulls(len(numbers), pa.string())
    return numbers, [none if k < 0 else rows.pool.take(pa.array(cells[:, k], mask=cells[:, k] < 0)) for k in order]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, sheets: dict[str, list[list[str]]]):
        self.path, self.overwrite, self.sheets = path, overwrite, sheets
        self.part = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, at = file_system(self.path)
        task = uuid.uuid4().hex
        folder = f"{at}/{self.part}/{task}"
        store.create_dir(folder, recursive=True)
        names: list[str] = []
        out = None
        for file, sheet, cells in _runs(iterator):
            if not names or names[-1] != file:
                if out:
                    out.close()
                names.append(file)
                out = BookOut(store, f"{folder}/{file}.xlsx", self.sheets)
            out.rows(list(self.sheets)[sheet], cells)
        if out:
            out.close()
        return Written([f"{task}/{n}.xlsx" for n in names])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = file_system(self.path)
        if self.overwrite:
            for old in files(self.path):
                store.delete_file(old)
        for m in messages:
            for name in m.names if m else []:
                store.move(f"{at}/{self.part}/{name}", f"{at}/{posixpath.basename(name)}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, at = file_system(self.path)
        if store.get_file_info(f"{at}/{self.part}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.part}")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, sheet, cells) of rows that come one after another."""
    for batch in batches:
        for k in range(0, batch.num_rows, PIECE):
            file, sheet, cells = batch.slice(k, PIECE).columns
            changes = np.flatnonzero((np.diff(file.dictionary_encode().indices.to_numpy()) != 0) | (np.diff(sheet.to_numpy()) != 0)) + 1
            for a, b in zip([0, *changes.tolist()], [*changes.tolist(), len(cells)], strict=True):
                yield file[a].as_py(), sheet[a].as_py(), cells.slice(a, b - a)


class BookOut:
    """A workbook that is written sheet after sheet, row after row; sheets that get no rows have their header alone."""

    def __init__(self, store, path: str, sheets: dict[str, list[list[str]]]):
        self._sink = store.open_output_stream(path)
        self._zip = zipfile.ZipFile(self._sink, "w", zipfile.ZIP_DEFLATED, compresslevel=DEFLATE)
        self._sheets, self._open, self._begun, self._nth = sheets, None, [], 0

    def rows(self, sheet: str, cells: pa.Array) -> None:
        if not self._begun or self._begun[-1] != sheet:
            self._begin(sheet)
        kinds = [kind for _, kind in self._sheets[sheet]]
        flat = pc.split_pattern(cells, BETWEEN).flatten() if kinds else cells[:0]
        if len(flat) != len(kinds) * len(cells):
            raise ValueError(f"rows of {sheet!r} have {len(kinds)} cells")
        self._put([flat.take(pa.array(np.arange(k, len(flat), len(kinds)))) for k in range(len(kinds))], kinds, len(cells))

    def _begin(self, sheet: str) -> None:
        self._end()
        self._begun.append(sheet)
        self._open, self._nth = self._zip.open(f"xl/worksheets/sheet{list(self._sheets).index(sheet) + 1}.xml", "w"), 0
        self._open.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
        names = [name for name, _ in self._sheets[sheet]]
        self._put([pa.array([name], pa.string()) for name in names], ["string"] * len(names), 1)

    def _end(self) -> None:
        if self._open:
            self._open.write(b"</sheetData></worksheet>")
            self._open.close()
            self._open = None

    def _put(self, columns: list[pa.Array], kinds: list[str], n: int) -> None:
        if self._nth + n > MAX_ROWS:
            raise ValueError(f"a sheet has at most {MAX_ROWS} rows; write more files")
        self._nth += n
        cells = []
        for column, kind in zip(columns, kinds, strict=True):  # each different value is put into XML once
            coded = column.dictionary_encode("encode")
            cells.append(pa.array([_cell(c, kind) for c in coded.dictionary.to_pylist()], pa.large_string()).take(coded.indices))
        if not cells:
            self._open.write(b"<row></row>" * n)
            return
        begin, end, nothing = (pa.scalar(x, pa.large_string()) for x in ("<row>", "</row>", ""))
        text = pc.binary_join_element_wise(begin, *cells, end, nothing)
        size = int(np.frombuffer(text.buffers()[1], np.int64)[n])
        self._open.write(memoryview(text.buffers()[2])[:size])

    def close(self) -> None:
        for sheet in self._sheets:
            if sheet not in self._begun:
                self._begin(sheet)
        self._end()
        numbered = list(enumerate(self._sheets, 1))
        part = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = [("/xl/workbook.xml", "sheet.main"), ("/xl/styles.xml", "styles"), *[(f"/xl/worksheets/sheet{k}.xml", "worksheet") for k, _ in numbered]]
        links = [*[(f"rId{k}", "worksheet", f"worksheets/sheet{k}.xml") for k, _ in numbered], (f"rId{len(numbered) + 1}", "styles", "styles.xml")]
        texts = {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            + "".join(f'<Override PartName="{p}" ContentType="{part}.{kind}+xml"/>' for p, kind in parts) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{k}" r:id="rId{k}"/>' for k, s in numbered) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{LINKS}/{kind}" Target="{to}"/>' for i, kind, to in links) + "</Relationships>",
            "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
            '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
        }
        for name, text in texts.items():
            self._zip.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{text}')
        self._zip.close()
        self._sink.close()


def _cell(c: str | None, kind: str) -> str:
    if c is None or c == "":
        return "<c/>"
    if kind == "date":
        return f'<c s="1"><v>{(datetime.datetime.fromisoformat(c) - EPOCHS[False]).days}</v></c>'
    if kind == "boolean":
        return f'<c t="b"><v>{int(c == "true")}</v></c>'
    if kind != "string" and c not in ("NaN", "Infinity", "-Infinity"):
        return f"<c><v>{c}</v></c>"
    if not c.isalnum() and SPECIAL.search(c):
        space = ' xml:space="preserve"' if SPACE.search(c) else ""
        return f'<c t="inlineStr"><is><t{space}>{escape(NOT_XML.sub("", c))}</t></is></c>'
    return f'<c t="str"><v>{c}</v></c>'  # the shortest form of a text


#: White space that a reader may take away: at the ends, or more than one, or other than a space.
SPACE = re.compile(r"^\s|\s$|\s\s|[^\S ]")
#: Characters that XML cannot hold; with those that it escapes and that white space.
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
SPECIAL = re.compile(rf"[&<>]|{NOT_XML.pattern}|{SPACE.pattern}")


class Workbooks(DataSource):
    """Options: ``path``, and for reading ``sheet`` (the first one where it is not given)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _sheet(self) -> tuple[str, list[str]]:
        path = self.options["path"]
        for f in files(path):
            with Book(path, f) as book:
                sheet = self.options.get("sheet") or next(iter(book.sheets))
                if sheet not in book.sheets:
                    raise ValueError(f"{f} has no sheet {sheet!r}")
                return sheet, book.header(sheet)
        raise FileNotFoundError(f"no workbook in {path}")

    def schema(self) -> T.StructType:
        return T.StructType([*[T.StructField(c, T.StringType()) for c in self._sheet()[1]], T.StructField("row_no", T.LongType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if schema.names[-1] != "row_no":
            raise ValueError("the last column is row_no")
        return WorkbookReader(self.options["path"], self.options.get("sheet") or self._sheet()[0], schema.names)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options["path"], overwrite, json.loads(self.options["sheets"]))


for _module in (sys.modules[__name__], sheetrows):
    cloudpickle.register_pickle_by_value(_module)


def sheet_names(path: str) -> list[str]:
    """The sheets of a workbook, or of the first one of a folder."""
    with Book(path, files(path)[0]) as book:
        return list(book.sheets)


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """One sheet of the workbooks under a path: a partition for each file."""
    spark.dataSource.register(Workbooks)
    return spark.read.format("workbook").option("sheet", sheet).load(path)


def _thinned(cuts: list[int], n: int) -> list[int]:
    """Of the cuts into many equal parts those into ``n``, or next to them."""
    return sorted({cuts[i * (len(cuts) + 1) // n - 1] for i in range(1, n)})


def _continued(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Rows whose file is the part that they are in, and how many files there are; a sheet has ``most`` rows in all files.

    Parts of a sheet are cut at quantiles of its rows' order, so rows are counted by part and never ranked one by one. The driver
    gets a number a part, which fixes the cuts for counting and writing; rows of one place in the order stay in one part."""
    keys, spark = ["file", "sheet"], rows.sparkSession
    # How many parts a file has is not known yet: cuts into four times as many as it can have, of which some are taken.
    k = 4 * -(-most // PART_ROWS) if most > PART_ROWS else 1
    cuts = F.percentile_approx("row_no", [i / k for i in range(1, k)], 10_000) if k > 1 else F.array().cast("array<long>")
    sizes = rows.groupBy(*keys).agg(cuts.alias("cuts"), F.count("*").alias("n")).collect()
    of = {(r.file, r.sheet): _thinned(r.cuts, -(-r.n // PART_ROWS)) for r in sizes}
    if not any(of.values()):
        return rows, len({file for file, _ in of})
    sorted_cuts = T.StructType([T.StructField("file", T.StringType()), T.StructField("sheet", T.IntegerType()), T.StructField("cuts", T.ArrayType(T.LongType(), containsNull=False))])
    found = InternalFunction.array_binary_search(F.col("cuts"), F.col("row_no"))  # -1 less the place where it is none of them
    part = F.coalesce(F.when(found < 0, -found - 1).otherwise(found), F.lit(0))
    in_part = rows.join(F.broadcast(spark.createDataFrame([(*key, c) for key, c in of.items()], sorted_cuts)), keys)
    counted = {(r.file, r.sheet, r.part): r["count"] for r in in_part.groupBy(*keys, part.alias("part")).count().collect()}
    parts = []
    for (file, sheet), c in of.items():
        before, names = 0, []
        for p in range(len(c) + 1):
            names.append(f"{file}.after-{before}" if before else file)
            before += counted.get((file, sheet, p), 0)
        parts.append((file, sheet, c, names))
    named = spark.createDataFrame(parts, T.StructType([*sorted_cuts, T.StructField("names", T.ArrayType(T.StringType()))]))
    placed = rows.join(F.broadcast(named), keys).select(F.get("names", part).alias("file"), "sheet", "row_no", "cells")
    return placed, len({n for *_, names in parts for n in names})


def write_workbooks(sheets: dict[str, DataFrame], path: str, by: str | None = None, order: str | None = None, continued: bool = False) -> None:
    """These sheets as workbooks in a folder: one for each value of the column ``by`` (a text that every sheet has and that is
    not written), else a single one ``workbook``; rows in the order of the column ``order``, which is not written either.

    What replaces another write of the folder is there at once. A file's rows meet in one task, in order: the format bounds
    them (``MAX_ROWS`` a sheet). More rows are an error, or, if ``continued``, go on in further files, which are read as one."""
    spark = next(iter(sheets.values())).sparkSession
    spark.dataSource.register(Workbooks)
    kinds = {s: [(c, k) for c, k in df.dtypes if c not in (by, order)] for s, df in sheets.items()}
    rows = None
    for nth, (s, df) in enumerate(sheets.items()):
        cells = F.concat_ws(BETWEEN, *[F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit(BETWEEN)), F.lit("")) for c, _ in kinds[s]])
        at = F.col(order).cast("long") if order else F.monotonically_increasing_id()
        one = df.select((F.col(by).cast("string") if by else F.lit("workbook")).alias("file"), F.lit(nth).alias("sheet"), at.alias("row_no"), cells.alias("cells"))
        rows = one if rows is None else rows.unionByName(one)
    if continued:
        rows, n_files = _continued(rows, max(df.count() for df in sheets.values()))
        rows = rows.repartition(4 * n_files, "file")  # so many that few tasks get two files
    else:
        rows = rows.repartition("file")
    ordered = rows.sortWithinPartitions("file", "sheet", "row_no").drop("row_no")
    ordered.write.format("workbook").option("sheets", json.dumps(kinds)).mode("overwrite").save(path)
