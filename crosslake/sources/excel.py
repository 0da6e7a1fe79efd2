"""Excel workbooks as a Spark data source, read with zipfile and an XML pull parser only."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from crosslake.functions.common import ship

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}  # fixed value: built-in number formats that show dates or times


def sheets(path: str) -> list[tuple[str, str]]:
    """(sheet name, part of the archive), in the workbook's order."""
    with zipfile.ZipFile(path) as z:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        out = []
        for s in book.iter(f"{_MAIN}sheet"):
            target = targets[s.get(f"{_REL}id")]
            out.append((s.get("name", ""), target.lstrip("/") if target.startswith("/") else "xl/" + target))
        return out


def sheet_names(path: str) -> list[str]:
    return [n for n, _ in sheets(path)]


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def _dated(z: zipfile.ZipFile) -> set[int]:
    """Which cell styles show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId", 0)) for f in root.iter(f"{_MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.IGNORECASE)}
    cells = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def rows(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet (an unknown or missing name means the first) as texts; absent cells are null."""
    parts = sheets(path)
    part = dict(parts).get(sheet or "", parts[0][1])
    with zipfile.ZipFile(path) as z:
        strings, dated = _shared(z), _dated(z)
        with z.open(part) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{_MAIN}row":
                    continue
                out: list[str | None] = []
                for i, c in enumerate(e.iter(f"{_MAIN}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    out += [None] * (at + 1 - len(out))
                    v, kind = c.find(f"{_MAIN}v"), c.get("t")
                    text = v.text if v is not None else None
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif kind == "s" and text is not None:
                        text = strings[int(text)]
                    elif kind == "b" and text is not None:
                        text = "true" if text == "1" else "false"
                    elif kind is None and text is not None and int(c.get("s", 0)) in dated:
                        text = (datetime(1899, 12, 30) + timedelta(days=float(text))).isoformat(timespec="seconds")
                    out[at] = text
                e.clear()
                yield out


class _Whole(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.o, self.n = options, len(schema.fields) - 1

    def partitions(self) -> list[InputPartition]:
        return [_Whole(None)]  # one compressed stream holds a sheet

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        header = self.o.get("header", "true") == "true"
        for i, r in enumerate(rows(self.o["path"], self.o.get("sheet")), 1):
            if (header and i == 1) or all(v is None for v in r):
                continue
            yield (i, *(r + [None] * self.n)[: self.n])


class ExcelSource(DataSource):
    """Options: path, sheet (else the first), header (true). All columns are text, and _row is the sheet's row: 2 is the first below a header."""

    @classmethod
    def name(cls) -> str:
        return "crosslake_excel"

    def schema(self) -> T.StructType:
        first = next(rows(self.options["path"], self.options.get("sheet")), [])
        header = self.options.get("header", "true") == "true"
        names = [(v or f"column_{i}") if header else str(i) for i, v in enumerate(first)]
        return T.StructType([T.StructField("_row", T.LongType()), *[T.StructField(n, T.StringType()) for n in names]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ExcelSource)
