"""Excel workbooks (S9, S13): coder sheets in and out.

Files are read as bytes by Spark, so they may be wherever Spark reads, and each is parsed in the task
that has it, row by row. Writing is a Spark data source: a task writes its rows into a workbook of
its own in a pending folder, and only the commit moves it to its place, so tasks that are run again
or a job that fails leave no sheet behind. A sheet holds at most 1,048,575 rows beside its header.
"""

from __future__ import annotations

import re
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from io import BytesIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs as files
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# Fixed values of the format: its namespaces, the rows a sheet may hold, the day that dates count from, its own numbers of date formats.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS = 1_048_576
DAY_ZERO = datetime(1899, 12, 30)
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def column_number(ref: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    out = 0
    for c in re.match("[A-Z]+", ref).group():
        out = out * 26 + ord(c) - 64
    return out - 1


def column_name(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def text_of(element) -> str:
    """The text of a string with or without formatted runs; phonetic hints are no text."""
    return "".join(t.text or "" for e in element for t in ([e] if e.tag == tag("t") else e.findall(tag("t")) if e.tag == tag("r") else []))


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles whose numbers are dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(tag("numFmt")) if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode").lower()))}
    cells = root.find(tag("cellXfs"))
    return {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def number_text(raw: str, is_date: bool) -> str:
    if is_date:
        when = DAY_ZERO + timedelta(days=float(raw))
        return when.strftime("%Y-%m-%d" if when.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
    value = float(raw)
    return str(int(value)) if value.is_integer() and abs(value) < 2**53 else repr(value)


def sheet_path(book: zipfile.ZipFile, sheet: str | None) -> str:
    """Where the named sheet is, or the first."""
    names = ElementTree.fromstring(book.read("xl/workbook.xml")).find(tag("sheets"))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for s in names:
        if sheet is None or s.get("name") == sheet:
            target = links[s.get(f"{{{LINK}}}id")]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"no sheet {sheet!r}")


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet as texts, gaps as None; errors are gaps too. Elements are let go as they are read."""
    with zipfile.ZipFile(BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [text_of(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        dates = date_styles(book)
        with book.open(sheet_path(book, sheet)) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != tag("row"):
                    continue
                out: list[str | None] = []
                for cell in row:
                    at = column_number(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    kind, v = cell.get("t", "n"), cell.find(tag("v"))
                    inline = cell.find(tag("is"))
                    if kind == "inlineStr":
                        out[at] = text_of(inline) if inline is not None else None
                    elif v is not None and v.text is not None and kind != "e":
                        if kind == "s":
                            out[at] = shared[int(v.text)]
                        elif kind == "b":
                            out[at] = "true" if v.text == "1" else "false"
                        elif kind == "n":
                            out[at] = number_text(v.text, int(cell.get("s", 0)) in dates)
                        else:
                            out[at] = v.text
                    if out[at] == "":
                        out[at] = None
                yield out
                row.clear()


def read_workbooks(spark: SparkSession, path: str, schema: str, sheet: str | None = None) -> DataFrame:
    """Rows of all workbooks at a path (a file, a folder or a pattern) under a declared schema.

    The first row names the columns; those of the schema must be there, others are left out. Empty
    cells are null, rows without any value are none, and what does not fit its type fails.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    wanted = StructType.fromDDL(schema)
    names = wanted.names
    arrow = pa.schema([(n, pa.string()) for n in names])

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = sheet_rows(content, sheet)
                header = next(rows, [])
                missing = [n for n in names if n not in header]
                if missing:
                    raise ValueError(f"no column {', '.join(missing)} in {header}")
                at, block = [header.index(n) for n in names], []
                for row in rows:
                    if any(v is not None for v in row):
                        block.append([row[i] if i < len(row) else None for i in at])
                    if len(block) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*block)], schema=arrow)
                        block = []
                if block:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*block)], schema=arrow)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*.xlsx").load(path).select("content")
    text = found.mapInArrow(run, ", ".join(f"`{n}` string" for n in names))
    return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


# ---- writing --------------------------------------------------------------------


def cell(ref: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    if isinstance(value, date):  # and times
        value = value.isoformat(" ") if isinstance(value, datetime) else value.isoformat()
    plain = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value)).replace("\r\n", "\n").replace("\r", "\n")
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(plain)}</t></is></c>'


def write_sheet(out, columns: list[str], rows: Iterator, sheet: str) -> int:
    """A workbook of one sheet into a file that is open for writing, row by row; returns how many rows."""
    name = escape(sheet, {'"': "&quot;"})
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINK}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    letters = [column_name(i) for i in range(len(columns))]
    line = lambda n, values: f'<row r="{n}">{"".join(cell(f"{c}{n}", v) for c, v in zip(letters, values))}</row>'.encode()
    n = 1
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for path, xml in parts.items():
            book.writestr(path, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{xml}')
        with book.open("xl/worksheets/sheet1.xml", "w") as stream:
            stream.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{MAIN}"><sheetData>'.encode() + line(1, columns))
            for row in rows:
                n += 1
                if n > MOST_ROWS:
                    raise ValueError("more rows than a sheet holds: write more partitions")
                stream.write(line(n, row))
            stream.write(b"</sheetData></worksheet>")
    return n - 1


@dataclass
class Written(WriterCommitMessage):
    pending: str
    rows: int


class WorkbookWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns
        self.folder = f"_pending-{uuid.uuid4().hex}"

    def place(self) -> tuple[files.FileSystem, str]:
        uri = self.options["path"]
        return files.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])

    def write(self, iterator: Iterator) -> Written:
        store, root = self.place()
        path = f"{root}/{self.folder}/part-{uuid.uuid4().hex}.xlsx"
        store.create_dir(f"{root}/{self.folder}")
        with store.open_output_stream(path) as out:
            return Written(path, write_sheet(out, self.columns, iterator, self.options.get("sheet", "Sheet1")))

    def commit(self, messages: list) -> None:
        store, root = self.place()
        for m in messages:
            if m is not None and m.rows:
                store.move(m.pending, f"{root}/{m.pending.rsplit('/', 1)[-1]}")
        store.delete_dir(f"{root}/{self.folder}")

    def abort(self, messages: list) -> None:
        store, root = self.place()
        if store.get_file_info(f"{root}/{self.folder}").type != files.FileType.NotFound:
            store.delete_dir(f"{root}/{self.folder}")


class WorkbookSink(DataSource):
    """format("workbook") for writing: one workbook a partition that has rows. Options: path, sheet."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(dict(self.options), schema.names)


def write_workbooks(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """df as workbooks in a folder, one a partition (``df.coalesce(1)`` for one). Arrays and structs are written as JSON."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark = df.sparkSession
    spark.dataSource.register(WorkbookSink)
    flat = [F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`").cast("double" if t.startswith("decimal") else t).alias(c) for c, t in df.dtypes]
    df.select(*flat).write.format("workbook").mode("append").options(path=path, sheet=sheet).save()
