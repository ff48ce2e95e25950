"""Price sheets of a workbook as a Spark source: rows of the sheet's XML are streamed into partitions.

A sheet has tickers in its first row, countries in its second, and then a date and prices a row. Partitions are ranges of
rows. The XML is inflated and read in pieces; rows before a partition's first are passed by their tags without being parsed.
The schema given to the reader prunes columns, and filters on the country prune cells.
"""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..schemas import PRICES

FORMAT = "price_sheet"
EPOCH = dt.date(1899, 12, 30)  # day 0 of workbook dates
HEAD = 2  # rows of tickers and countries
PIECE = 1 << 18
BATCH = 10_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ROW = re.compile(rb"<(?:\w+:)?row(?=[\s>/])")


def opened(path: str):
    """A file that can be read at any place, from a path or a URI."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def column(cell: str) -> int:
    """The place of a cell such as BM12 in its row."""
    n = 0
    for x in re.match(r"[A-Z]*", cell)[0]:
        n = 26 * n + ord(x) - 64
    return n - 1


class Sheet:
    """A sheet of an open workbook."""

    def __init__(self, book: zipfile.ZipFile, name: str) -> None:
        self.book = book
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        ids = {s.get("name"): s.get(_REL) for s in root.iter(f"{_MAIN}sheet")}
        if name not in ids:
            raise ValueError(f"no sheet {name}")
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = rels[ids[name]].lstrip("/")
        self.part = target if target.startswith("xl/") else f"xl/{target}"
        self._shared: list[str] | None = None

    def shared(self, i: int) -> str:
        """A text of the book's table of texts, which is read when a cell first needs it."""
        if self._shared is None:
            self._shared = []
            with self.book.open("xl/sharedStrings.xml") as f:
                for _, x in ElementTree.iterparse(f):
                    if x.tag == f"{_MAIN}si":
                        self._shared.append("".join(t.text or "" for t in x.iter(f"{_MAIN}t")))
                        x.clear()
        return self._shared[i]

    def count(self) -> int:
        """The number of rows, by their tags."""
        n, rest = 0, b""
        with self.book.open(self.part) as f:
            while piece := f.read(PIECE):
                data = rest + piece
                found = list(_ROW.finditer(data))
                n += len(found)
                # a tag may be cut off: go on behind the last one, or shortly before the end
                rest = data[max(found[-1].end() if found else 0, len(data) - 64) :]
        return n

    def rows(self, low: int, high: int) -> Iterator[dict[int, str | float]]:
        """The cells of rows low to high - 1, by column."""
        parser = ElementTree.XMLPullParser(("end",))
        seen, rest, feeding, prolog = 0, b"", False, True
        with self.book.open(self.part) as f:
            while seen < high or rest:
                piece = f.read(PIECE)
                if not piece and not rest:
                    return
                data, rest = rest + piece, b""
                if not feeding:
                    found = [m.start() for m in _ROW.finditer(data)]
                    if prolog and found:  # what comes before the first row declares the names
                        parser.feed(data[: found[0]])
                        prolog = False
                    elif prolog:
                        if not piece:
                            return
                        rest = data
                        continue
                    if seen + len(found) <= low:
                        if not piece:
                            return
                        keep = max(found[-1] + 1 if found else 0, len(data) - 64)
                        seen, rest = seen + len(found), data[keep:]
                        continue
                    data, seen, feeding = data[found[low - seen] :], low, True
                if not data:
                    return
                parser.feed(data)
                for _, x in parser.read_events():
                    if x.tag == f"{_MAIN}row":
                        if seen < high:
                            yield self._cells(x)
                        seen += 1
                        x.clear()
                if seen >= high or not piece:
                    return

    def _cells(self, row: ElementTree.Element) -> dict[int, str | float]:
        out, at = {}, -1
        for c in row.iter(f"{_MAIN}c"):
            at = column(c.get("r")) if c.get("r") else at + 1
            kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
            if kind == "inlineStr":
                out[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif v is not None and v.text is not None:
                out[at] = self.shared(int(v.text)) if kind == "s" else v.text if kind in ("str", "d", "e", "b") else float(v.text)
        return out


def to_date(x: str | float) -> dt.date:
    return EPOCH + dt.timedelta(days=int(x)) if isinstance(x, float) else dt.date.fromisoformat(x[:10])


@dataclass
class Rows(InputPartition):
    low: int
    high: int


class PriceReader(DataSourceReader):
    def __init__(self, schema, options: dict) -> None:
        self.fields = [f.name for f in schema.fields]
        self.options = dict(options)
        self.countries: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Countries are picked while cells are read; all else is left to Spark."""
        for f in filters:
            match f:
                case EqualTo(("country",), str(x)):
                    self._only({x})
                case In(("country",), xs):
                    self._only(set(xs))
                case _:
                    yield f

    def _only(self, countries: set[str]) -> None:
        self.countries = countries if self.countries is None else self.countries & countries

    def _sheet(self, book: zipfile.ZipFile) -> Sheet:
        return Sheet(book, self.options["sheet"])

    def partitions(self) -> list[InputPartition]:
        each = int(self.options.get("rows_per_partition", 5000))
        with opened(self.options["path"]) as f, zipfile.ZipFile(f) as book:
            n = self._sheet(book).count()
        return [Rows(i, min(i + each, n)) for i in range(HEAD, n, each)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        kinds = {"date": pa.date32(), "country": pa.string(), "asset_class": pa.string(), "price": pa.float64()}
        schema = pa.schema([(c, kinds[c]) for c in self.fields])
        if partition is None:
            return
        with opened(self.options["path"]) as f, zipfile.ZipFile(f) as book:
            sheet = self._sheet(book)
            names = next(sheet.rows(1, 2), {})
            picked = [(j, str(x)) for j, x in names.items() if j > 0 and x != "" and (self.countries is None or str(x) in self.countries)]
            out: list[tuple] = []
            for cells in sheet.rows(partition.low, partition.high):
                if cells.get(0) in (None, ""):
                    continue
                day = to_date(cells[0])
                for j, country in picked:
                    price = cells.get(j)
                    out.append((day, country, price if isinstance(price, float) else None))
                if len(out) >= BATCH:
                    yield self._batch(out, schema)
                    out = []
            if out:
                yield self._batch(out, schema)

    def _batch(self, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        days, countries, prices = zip(*rows, strict=True)
        have = {"date": days, "country": countries, "asset_class": [self.options["asset_class"]] * len(rows), "price": prices}
        return pa.RecordBatch.from_arrays([pa.array(have[f.name], f.type) for f in schema], schema=schema)


class PriceSheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PRICES

    def reader(self, schema) -> DataSourceReader:
        return PriceReader(schema, self.options)
