"""Excel workbooks as rows: ``spark.read.format("xlsx").load("events.xlsx")``.

The first sheet's first row names the columns; all are strings, so that a cast
decides their type and keys keep their form. A sheet is one stream of XML of a
million rows at most, so it is one partition, read row by row.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from .geotiff import opened

#: Fixed values of the format: its name spaces.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheet(book: zipfile.ZipFile) -> str:
    """The path of the workbook's first sheet within the archive."""
    first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet").get(_LINK)
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(x.get("Target") for x in links if x.get("Id") == first)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _column(reference: str) -> int:
    at = 0
    for c in re.match("[A-Z]+", reference).group():
        at = 26 * at + ord(c) - 64
    return at - 1


def _rows(path: str) -> Iterator[list[str | None]]:
    system, inner = opened(path)
    with system.open_input_file(inner) as f, zipfile.ZipFile(f) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        with book.open(_sheet(book)) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str | None] = {}
                for k, c in enumerate(row.findall(f"{_MAIN}c")):
                    value, kind = c.findtext(f"{_MAIN}v"), c.get("t")
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif kind == "b":
                        value = {"1": "true", "0": "false"}.get(value)
                    cells[_column(c.get("r")) if c.get("r") else k] = value
                yield [cells.get(k) for k in range(max(cells, default=-1) + 1)]
                row.clear()


class _Reader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = _rows(self.path)
        next(rows, None)
        for row in rows:
            yield tuple((row + [None] * self.width)[: self.width])


class Excel(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        head = next(_rows(self.options["path"]), [])
        return StructType([StructField(n or f"column_{k}", StringType()) for k, n in enumerate(head)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], len(schema.fields))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Excel)
