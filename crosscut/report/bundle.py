"""What a report needs: small results of Spark queries, collected once."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crosssection as cs
from ..operators import cuts as cu
from ..operators import windows as wi
from ..operators.blocks import BLOCK
from ..plans.engine import kernels
from ..sources import panel as src
from ..sources import runs
from ..sources.files import Files

BANDS = ("global", "DM", "EM", "EM_Eq", "EM_FI", "DM_Eq", "DM_FI", "LatAm")
CONFIRM = 21
BETA_ROWS = 63


@dataclass(frozen=True)
class Bundle:
    run_date: str
    methodology_version: str
    dates: list
    points: pd.DataFrame  # date, series_id, country, segment, asset_class, vol, ret, beta
    lines: dict[str, pd.DataFrame]  # by kind: date, cut, segment and the fitted line with its band
    ranges: dict[str, pd.DataFrame]  # by column: cut, lo, hi
    slopes: pd.DataFrame  # date by cut
    regime_runs: pd.DataFrame  # cut, start, end, confirmed


def last_dates(rows: DataFrame, n: int) -> DataFrame:
    """The rows of the last n dates: top-k dates, then a semi join."""
    dates = rows.select("date").distinct().orderBy(F.col("date").desc()).limit(n)
    return rows.join(dates, "date", "left_semi")


def report_members(series: DataFrame) -> DataFrame:
    """cut, series_id, segment for the report's filters."""
    out = None
    for name in cu.REPORT_CUTS:
        part = cu.report_filter(series, name).select(F.lit(name).alias("cut"), "series_id", "segment")
        out = part if out is None else out.unionByName(part)
    return out


def proxy_betas(returns: DataFrame, series: DataFrame, rows: int = BETA_ROWS) -> DataFrame:
    """returns with each series' rolling beta against the cap-weighted proxy."""
    weights = series.select("series_id", F.col("mcap").alias("weight"))
    if (weights.agg(F.sum("weight")).first()[0] or 0) <= 0:
        raise ValueError("the weights must have a positive sum")
    t = returns.join(wi.weighted_proxy(returns, weights), "date", "left")
    return t.withColumn("beta", wi.rolling_beta("r1", "proxy", rows))


def axis_ranges(points: DataFrame, members: DataFrame, value: str, pad: float = 0.05) -> DataFrame:
    """cut, lo, hi with 5 % to spare; a cut without values gets the range of all."""
    ends = lambda df, *k: df.groupBy(*k).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    every = ends(points).withColumnsRenamed({"lo": "all_lo", "hi": "all_hi"})
    t = members.select("cut").distinct().join(ends(points.join(members, "series_id"), "cut"), "cut", "left").crossJoin(every)
    lo, hi = F.coalesce("lo", "all_lo"), F.coalesce("hi", "all_hi")
    room = F.when(hi > lo, hi - lo).otherwise(1.0) * pad
    return t.select("cut", (lo - room).alias("lo"), (hi + room).alias("hi"))


def fitted(points: DataFrame, members: DataFrame, x: str, y: str) -> DataFrame:
    rows = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).join(members.select("cut", "series_id"), "series_id")
    return cs.ols_band(rows.select("date", "cut", "segment", F.col(x).alias("x"), F.col(y).alias("y")))


def confirmed_runs(regimes: DataFrame, rows: int = CONFIRM, key: str = "segment") -> DataFrame:
    held = wi.hysteresis(regimes.select("date", key, "tercile"), "tercile", rows, (key,), size=BLOCK)
    return wi.run_lengths(held.select("date", key, "confirmed"), "confirmed", (key,), size=BLOCK)


def slope_table(beta: DataFrame, scheme: str = "cap_wtd", key: str = "segment") -> DataFrame:
    """date by cut, with the cuts as given so that no extra job looks for them."""
    return beta.filter(F.col("scheme") == scheme).groupBy("date").pivot(key, list(cu.CUTS)).agg(F.first("beta")).orderBy("date")


def load_bundle(spark: SparkSession, run_dir: str | Path, data_path: str | Path, window: int = 252) -> Bundle:
    snap = runs.read_snapshot(run_dir)
    cfg = snap.get("config_resolved", {})
    beta, regimes = runs.read_artifact(spark, run_dir, "beta_series"), runs.read_artifact(spark, run_dir, "regimes")
    if not Files(spark, data_path).exists():
        raise FileNotFoundError(data_path)
    universe, prices = src.load_universe(spark, data_path), src.load_prices(spark, data_path)
    series = cu.series_of(universe)
    returns = kernels(prices, cfg.get("return_window_days", 63), cfg.get("ewma_halflife_days", 30))
    returns = returns.join(series.select("series_id", "country", "segment"), "series_id")
    points = last_dates(proxy_betas(returns, series), window).cache()
    members = report_members(series).cache()
    lines = {x: fitted(points, members, x, "ret").toPandas() for x in ("vol", "beta")}
    ranges = {c: axis_ranges(points, members, c).toPandas() for c in ("vol", "beta", "ret")}
    frame = points.select("date", "series_id", "country", "segment", "asset_class", "vol", "ret", "beta").orderBy("date", "series_id").toPandas()
    return Bundle(
        str(snap["run_date"]), str(snap["methodology_version"]), sorted(frame["date"].unique()), frame, lines, ranges,
        slope_table(beta).toPandas(), confirmed_runs(regimes).orderBy("segment", "start").toPandas(),
    )


