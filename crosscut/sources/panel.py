"""Readers of the inputs: universe, prices, workbook sheets, macro series, composites, and fingerprints."""

from __future__ import annotations

import datetime as dt
import hashlib
import subprocess
import time
import zipfile
from collections.abc import Callable, Iterable
from functools import reduce
from pathlib import Path
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.cuts import COMPOSITE_NAMES
from . import workbook
from .fingerprints import input_fingerprint

# The workbook's sheets and columns, and the macro series.
PANEL_COLUMNS = {"Country": "country", "Segment": "segment", "Equity_Mkt_Cap_Val": "eq_mcap", "Fixed_Income_Mkt_Cap_Val": "fi_mcap"}
SHEETS = {"Eq": "Equity_LC", "FI": "Fixed_Income_LC"}
MACRO_IDS = ("VIXCLS", "BAMLC0A4CBBB", "BAMLEMCBPIOAS", "BAMLH0A0HYM2", "T10Y2Y")

def read_sheet(path: str | Path, name: str) -> list[list[str | float | None]]:
    """Cells of a small sheet, such as the universe's, by row; numbers as float. Price sheets are read by a Spark source."""
    rows = []
    with workbook.opened(str(path)) as f, zipfile.ZipFile(f) as book:
        for cells in workbook.Sheet(book, name).rows(0, 1 << 40):
            rows.append([cells.get(j) for j in range(max(cells, default=-1) + 1)])
    return rows


def price_sheet(spark: SparkSession, path: str | Path, sheet: str, asset_class: str, rows_per_partition: int = 5000) -> DataFrame:
    """date, country, asset_class, price of a workbook's sheet; the driver only counts its rows."""
    spark.dataSource.register(workbook.PriceSheetSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"path": str(path), "sheet": sheet, "asset_class": asset_class, "rows_per_partition": str(rows_per_partition)}
    return spark.read.format(workbook.FORMAT).options(**options).load()


def universe_frame(rows: DataFrame) -> DataFrame:
    """Panel rows with the reserved composite names told apart; the four needed columns must be there."""
    missing = sorted(set(PANEL_COLUMNS) - set(rows.columns))
    if missing:
        raise ValueError(f"Panel lacks columns: {missing}")
    return rows.withColumnsRenamed(PANEL_COLUMNS).withColumn("is_composite", F.col("country").isin(*COMPOSITE_NAMES))


def load_universe(spark: SparkSession, path: str | Path) -> DataFrame:
    """A workbook's Panel sheet, or a table with its columns."""
    if str(path).endswith(".xlsx"):
        head, *body = read_sheet(path, "Panel")
        need = [c for c in PANEL_COLUMNS if c in head]
        rows = [tuple(r[head.index(c)] if head.index(c) < len(r) else None for c in need) for r in body if r and r[0] is not None]
        kinds = ", ".join(f"{c} {'double' if c.endswith('Val') else 'string'}" for c in need)
        return universe_frame(spark.createDataFrame(rows, kinds)).select(*PANEL_COLUMNS.values(), "is_composite")
    return universe_frame(read_table(spark, path))


def shared_countries(prices: DataFrame) -> DataFrame:
    """Prices of countries that have both asset classes."""
    both = prices.groupBy("country").agg(F.count_distinct("asset_class").alias("n")).filter("n = 2").select("country")
    return prices.join(both, "country", "left_semi")


def load_prices(spark: SparkSession, path: str | Path) -> DataFrame:
    """Long prices of a workbook, or of a table with the price schema, for countries with both asset classes."""
    if str(path).endswith(".xlsx"):
        prices = reduce(DataFrame.unionByName, [price_sheet(spark, path, sheet, kind) for kind, sheet in SHEETS.items()])
    else:
        prices = schemas.require(read_table(spark, path, schemas.PRICES), ("date", "country", "asset_class", "price"))
    return shared_countries(schemas.nan_to_null(prices))


def read_table(spark: SparkSession, path: str | Path, schema: str | None = None) -> DataFrame:
    """Parquet, CSV (header) or JSON by the path's ending; no inference where a schema is given."""
    reader = spark.read.schema(schema) if schema else spark.read
    path = str(path)
    if path.endswith(".csv"):
        return reader.option("header", "true").csv(path)
    return reader.json(path) if path.endswith(".json") else reader.parquet(path)


def melt(wide: DataFrame, value: str, key: str = "segment", date: str = "date") -> DataFrame:
    """date, key, value of a wide frame."""
    return wide.unpivot(date, [c for c in wide.columns if c != date], key, value)


@runtime_checkable
class MacroClient(Protocol):
    def fetch(self, series_id: str, start: dt.date, end: dt.date) -> DataFrame: ...


class TableClient:
    """Series from a table with the macro schema; an unknown id has no rows, both ends are included."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def fetch(self, series_id: str, start: dt.date, end: dt.date) -> DataFrame:
        return self.fetch_all([series_id], start, end)

    def fetch_all(self, ids: Iterable[str], start: dt.date, end: dt.date) -> DataFrame:
        return self.table.filter(F.col("macro_id").isin(list(ids)) & F.col("date").between(start, end))


class RetryingClient:
    """Another client's fetch, tried again after a pause; the last error is raised."""

    def __init__(self, inner: MacroClient, tries: int = 3, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> None:
        self.inner, self.tries, self.pause, self.sleep = inner, tries, pause, sleep

    def fetch(self, series_id: str, start: dt.date, end: dt.date) -> DataFrame:
        for left in range(self.tries - 1, -1, -1):
            try:
                return self.inner.fetch(series_id, start, end)
            except Exception:
                if not left:
                    raise
                self.sleep(self.pause)
        raise AssertionError


def load_macro(client: MacroClient, start: dt.date, end: dt.date, ids: tuple[str, ...] = MACRO_IDS) -> DataFrame:
    """All series: in one scan if the client has `fetch_all`, else under one another."""
    if hasattr(client, "fetch_all"):
        out = client.fetch_all(ids, start, end).select("date", "macro_id", "value")
    else:
        out = reduce(DataFrame.unionByName, [client.fetch(i, start, end).select("date", "macro_id", "value") for i in ids])
    return schemas.nan_to_null(out)


def series_hash(rows: DataFrame, key: str = "macro_id") -> DataFrame:
    """key, hash: sha256 over the sorted MD5 sums of a series' rows, each its date and value as text."""
    row = F.md5(F.concat_ws("|", F.col("date").cast("string"), F.col("value").cast("string")))
    return rows.groupBy(key).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(row))), 256).alias("hash"))


def file_fingerprint(path: str | Path) -> dict[str, str]:
    p = Path(path)
    if not p.is_file():
        return {"path": str(p)}
    digest = hashlib.sha256()
    with p.open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return {"path": str(p), "sha256": digest.hexdigest(), "mtime": dt.datetime.fromtimestamp(p.stat().st_mtime, dt.UTC).isoformat()}


def fingerprint(spark: SparkSession, path: str | Path) -> dict:
    """Of a local file its digest and time of change; of any other input, such as a folder of Parquet files, a tree's digest."""
    return file_fingerprint(path) if "://" not in str(path) and Path(path).is_file() else input_fingerprint(spark, str(path))


def code_version(folder: str | Path | None = None) -> str:
    """The commit, with a mark for changes; "unknown" where there is none."""
    git = lambda *a: subprocess.run(["git", *a], cwd=folder or Path(__file__).parent, capture_output=True, text=True, timeout=20, check=True).stdout.strip()
    try:
        return git("rev-parse", "HEAD") + ("-dirty" if git("status", "--porcelain") else "")
    except (OSError, subprocess.SubprocessError):
        return "unknown"


