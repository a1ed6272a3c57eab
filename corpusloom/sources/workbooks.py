"""Workbooks: one file that people open, and a Spark data source that writes one a task, with commit and abort."""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from corpusloom.operators.report import column_widths
from corpusloom.session import ship

#: Rows of a sheet, by the workbook format.
SHEET_ROWS = 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def column_name(index: int) -> str:
    name = ""
    while index >= 0:
        name, index = chr(65 + index % 26) + name, index // 26 - 1
    return name


def _cell(value: Any, at: str) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    text = "".join(ch for ch in str(value) if ch in "\t\n\r" or ord(ch) >= 32)
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_book(out: BinaryIO, rows: Iterable[Iterable[Any]], header: list[str], widths: list[int], sheet: str = "translations", sheet_rows: int = SHEET_ROWS) -> int:
    """Writes a workbook as rows come, a new sheet whenever one is full; returns the rows. Each sheet has the header,
    frozen; text cells are inline, numbers and booleans as such. Holds no more than a row."""
    letters = [column_name(i) for i in range(len(header))]
    columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    freeze = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'

    def line(values: Iterable[Any], number: int) -> bytes:
        return f'<row r="{number}">{"".join(_cell(v, f"{c}{number}") for c, v in zip(letters, values, strict=True))}</row>'.encode()

    left, total, sheets, more = iter(rows), 0, 0, True
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        first = next(left, None)
        while more:
            sheets, number = sheets + 1, 1
            with z.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as s:
                s.write(f'{_HEAD}<worksheet xmlns="{_MAIN}">{freeze}<cols>{columns}</cols><sheetData>'.encode() + line(header, 1))
                while first is not None and number < sheet_rows:
                    number, total = number + 1, total + 1
                    s.write(line(first, number))
                    first = next(left, None)
                s.write(b"</sheetData></worksheet>")
            more = first is not None
        every = range(1, sheets + 1)
        names = [sheet if sheets == 1 else f"{sheet} {i}" for i in every]
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KIND}.worksheet+xml"/>' for i in every) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(every, names, strict=True)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in every) + "</Relationships>",
        }
        for name, text in parts.items():
            z.writestr(name, _HEAD + text)
    return total


# --- a data source ------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """What a task has written beside the target: nothing if it had no rows."""

    file: str | None
    rows: int


class WorkbookWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        from pyarrow.fs import FileSystem

        path = options.get("path") or ""
        if not path:
            raise ValueError("a folder of workbooks needs a path")
        FileSystem.from_uri(path)  # a store that executors can't write to is refused before anything runs
        self.path, self.header, self.overwrite = path.rstrip("/"), schema.names, overwrite
        widths = json.loads(options.get("widths") or "{}")
        self.widths = [int(widths.get(c, 20)) for c in self.header]
        self.sheet, self.sheet_rows = options.get("sheet", "translations"), int(options.get("sheetrows", SHEET_ROWS))
        self.job = uuid.uuid4().hex

    def _place(self, name: str = ""):
        from pyarrow.fs import FileSystem

        fs, top = FileSystem.from_uri(self.path)
        return fs, f"{top}/{name}" if name else top

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        first = next(iterator, None)
        if first is None:
            return Written(None, 0)
        task = TaskContext.get()
        # a task that is tried again, or twice at once, writes a file of its own
        name = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}.xlsx"
        fs, at = self._place(f"_temporary/{self.job}/{name}")
        fs.create_dir(at.rpartition("/")[0], recursive=True)

        def rows() -> Iterator:
            yield first
            yield from iterator

        with fs.open_output_stream(at) as out:
            n = write_book(out, rows(), self.header, self.widths, self.sheet, self.sheet_rows)
        return Written(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Puts the files of the tasks that count in place; those that a former write left go only then."""
        from pyarrow.fs import FileSelector

        fs, top = self._place()
        fs.create_dir(top, recursive=True)
        old = [f.path for f in fs.get_file_info(FileSelector(top)) if f.base_name.endswith(".xlsx")] if self.overwrite else []
        for m in messages:
            if m is not None and m.file is not None:
                fs.move(f"{top}/_temporary/{self.job}/{m.file}", f"{top}/{m.file}")
        for path in old:
            fs.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileType

        fs, at = self._place("_temporary")
        for folder in (f"{at}/{self.job}", at):
            if fs.get_file_info(folder).type == FileType.Directory and (folder != at or not self._busy(fs, at)):
                fs.delete_dir(folder)

    @staticmethod
    def _busy(fs, at: str) -> bool:
        from pyarrow.fs import FileSelector

        return bool(fs.get_file_info(FileSelector(at)))


class WorkbookSource(DataSource):
    """``df.write.format("workbook").option("path", folder)``: a workbook for each task that has rows.

    Options: sheet (name of the sheets), sheetRows, widths (JSON of column to width).
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


def write_workbooks(table: DataFrame, path: str, order: tuple[str, ...] = (), *, overwrite: bool = True, sheet: str = "translations") -> None:
    """The table as a folder of workbooks, written where the rows are: nothing but file names reaches the driver.

    In ``order`` each file holds a range of it, and names sort as ranges do. Widths are those of all rows. The folder is
    in a store that executors write to by its URI; all files appear once all are written, or none.
    """
    spark = table.sparkSession
    ship(spark)
    spark.dataSource.register(WorkbookSource)
    widths = {r.name: r.width for r in column_widths(table).collect()}  # a number a column
    out = table.orderBy(*order) if order else table
    out.write.format("workbook").option("path", path).option("widths", json.dumps(widths)).option("sheet", sheet).mode("overwrite" if overwrite else "append").save()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, cells): the rows of all workbooks of a folder below their headers, cells as text by column name; a task a file."""
    ship(spark)
    kind = "file string, sheet int, row long, cells map<string,string>"

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted((n for n in z.namelist() if n.startswith("xl/worksheets/")), key=lambda n: int("".join(filter(str.isdigit, n))))
                    for sheet, name in enumerate(names, 1):
                        header: dict[str, str] = {}
                        held: list[tuple] = []
                        with z.open(name) as s:
                            for _, e in ElementTree.iterparse(s):
                                if e.tag != f"{{{_MAIN}}}row":
                                    continue
                                cells = {c.get("r", "").rstrip("0123456789"): "".join(c.itertext()) for c in e}
                                if not header:
                                    header = cells
                                else:
                                    held.append((file, sheet, int(e.get("r")) - 1, {header[k]: v for k, v in cells.items()}))
                                e.clear()
                                if len(held) >= 1000:
                                    yield pd.DataFrame(held, columns=["file", "sheet", "row", "cells"])
                                    held = []
                        if held:
                            yield pd.DataFrame(held, columns=["file", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(f"{path.rstrip('/')}/*.xlsx").select("path", "content").mapInPandas(rows, kind).withColumn("file", F.element_at(F.split("file", "/"), -1))
