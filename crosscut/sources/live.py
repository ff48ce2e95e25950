"""External series over HTTP as a Spark source: a partition a series, with the ids and the dates asked of the server.

The server answers `<url>?series_id=...&observation_start=...&observation_end=...&file_type=json&api_key=...` with
`{"observations": [{"date": "2020-01-31", "value": "1.5"}, ...]}`, where the value "." is missing. An answer of 400 or 404
says that there is no such series, which then has no rows. Other errors are tried again after a pause.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..schemas import MACRO

#: The public service whose series the engine's ids name.
URL = "https://api.stlouisfed.org/fred/series/observations"
FORMAT = "macro_series"
NO_SERIES = (400, 404)


@dataclass
class Series(InputPartition):
    series_id: str
    start: dt.date | None
    end: dt.date | None


def get(url: str, tries: int, pause: float, timeout: float) -> dict | None:
    """The JSON of an answer; None if the server says that it isn't there. The last error is raised."""
    for left in range(tries - 1, -1, -1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code in NO_SERIES:
                return None
            last: Exception = e
        except (OSError, ValueError) as e:
            last = e
        if left:
            time.sleep(pause)
    # the address holds the key, so the error doesn't name it
    raise OSError(f"no answer after {tries} tries: {type(last).__name__} {getattr(last, 'code', '')}".rstrip()) from None


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.ids: list[str] | None = [x for x in self.options.get("ids", "").split(",") if x] or None
        self.start: dt.date | None = None
        self.end: dt.date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Ids and both ends of the dates go to the server; all else is left to Spark."""
        for f in filters:
            match f:
                case EqualTo(("macro_id",), str(x)):
                    self._only([x])
                case In(("macro_id",), xs):
                    self._only([x for x in xs if x is not None])
                case EqualTo(("date",), dt.date() as x):
                    self._between(x, x)
                case GreaterThanOrEqual(("date",), dt.date() as x):
                    self._between(x, None)
                case LessThanOrEqual(("date",), dt.date() as x):
                    self._between(None, x)
                case GreaterThan(("date",), dt.date() as x):
                    self._between(x + dt.timedelta(1), None)
                case LessThan(("date",), dt.date() as x):
                    self._between(None, x - dt.timedelta(1))
                case _:
                    yield f

    def _only(self, ids: list[str]) -> None:
        known = self.ids
        self.ids = [x for x in dict.fromkeys(ids) if known is None or x in known]

    def _between(self, start: dt.date | None, end: dt.date | None) -> None:
        self.start = max((x for x in (self.start, start) if x), default=None)
        self.end = min((x for x in (self.end, end) if x), default=None)

    def partitions(self) -> list[InputPartition]:
        if self.ids is None:
            raise ValueError("name the series, by the option ids or a filter on macro_id")
        if self.start and self.end and self.start > self.end:
            return []
        return [Series(x, self.start, self.end) for x in self.ids]

    def read(self, partition: Series) -> Iterator[tuple]:
        if partition is None:
            return
        o = self.options
        query = {"series_id": partition.series_id, "file_type": "json", "api_key": o.get("api_key", "")}
        query |= {k: v.isoformat() for k, v in (("observation_start", partition.start), ("observation_end", partition.end)) if v}
        found = get(f"{o.get('url', URL)}?{urllib.parse.urlencode(query)}", int(o.get("tries", 3)), float(o.get("pause", 2.0)), float(o.get("timeout", 60)))
        for x in (found or {}).get("observations", []):
            yield dt.date.fromisoformat(x["date"]), partition.series_id, None if x["value"] in (".", "", None) else float(x["value"])


class SeriesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MACRO

    def reader(self, schema) -> DataSourceReader:
        return SeriesReader(self.options)


class LiveClient:
    """Series of the service; `fetch` has one, `fetch_all` any number in one scan."""

    def __init__(self, spark: SparkSession, api_key: str, url: str = URL, tries: int = 3, pause: float = 2.0) -> None:
        self.spark = spark
        self.options = {"api_key": api_key, "url": url, "tries": str(tries), "pause": str(pause)}
        spark.dataSource.register(SeriesSource)

    def table(self, ids: Iterable[str] = ()) -> DataFrame:
        self.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        return self.spark.read.format(FORMAT).options(**self.options, ids=",".join(ids)).load()

    def fetch_all(self, ids: Iterable[str], start: dt.date | str, end: dt.date | str) -> DataFrame:
        ids = list(ids)
        rows = self.table(ids).filter(F.col("macro_id").isin(ids))
        return rows.filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") <= F.lit(end).cast("date")))

    def fetch(self, series_id: str, start: dt.date | str, end: dt.date | str) -> DataFrame:
        return self.fetch_all([series_id], start, end)
