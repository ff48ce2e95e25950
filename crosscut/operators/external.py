"""Agreement with external series: rolling correlation on the union calendar, and the gap to composite indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import gap, safe_log_ratio, tercile
from .cuts import COMPOSITE_MAP
from .windows import forward_fill, percent_ranks, rolling_corr

FILL = 2


def external_corr(percentiles: DataFrame, macro: DataFrame, window: int, fill: int = FILL) -> DataFrame:
    """date, cut, macro_id, rho: on each pair's union of dates, both sides filled forward by up to `fill` rows.

    percentiles: date, cut, percentile. Cuts and series are few; the facts are their dates.
    """
    ids = macro.select("macro_id").distinct()
    cuts = percentiles.select("cut").distinct()
    left = percentiles.select("date", "cut", "percentile").crossJoin(ids)
    right = macro.select("date", "macro_id", "value").crossJoin(cuts)
    t = left.join(right, ["date", "cut", "macro_id"], "full_outer")
    key = ("cut", "macro_id")
    t = t.withColumns({"p": forward_fill("percentile", fill, key), "v": forward_fill("value", fill, key)})
    return t.select("date", "cut", "macro_id", rolling_corr("p", "v", window, key).alias("rho"))


def below_threshold(corr: DataFrame, threshold: float) -> DataFrame:
    """All rows, flagged where the correlation is defined and weak."""
    return corr.withColumn("below_threshold", F.coalesce(F.abs("rho") < threshold, F.lit(False)))


def composite_returns(prices: DataFrame, rows: int) -> DataFrame:
    """date, ticker, ret of composite prices (date, ticker, price); dense dates."""
    from pyspark.sql import Window

    over = Window.partitionBy("ticker").orderBy("date")
    return prices.select("date", "ticker", safe_log_ratio(F.col("price"), F.lag("price", rows).over(over)).alias("ret"))


def blend(returns: DataFrame, mapping: dict[str, tuple[str | None, str | None]] = COMPOSITE_MAP) -> DataFrame:
    """date, cut, ret: the mean of a cut's composites that have a value; cuts without any ticker present have no row."""
    spark = returns.sparkSession
    pairs = [(cut, t) for cut, legs in mapping.items() for t in legs if t]
    bridge = spark.createDataFrame(pairs, "cut string, ticker string")
    return returns.join(F.broadcast(bridge), "ticker").groupBy("date", "cut").agg(F.avg("ret").alias("ret"))


def internal_consistency(regimes: DataFrame, composites: DataFrame, rows: int, mapping: dict[str, tuple[str | None, str | None]] = COMPOSITE_MAP) -> DataFrame:
    """date, cut, gap between the engine's label and that of the composite's full-sample rank."""
    comp = blend(composite_returns(composites, rows), mapping)
    comp = percent_ranks(comp, "ret", ("cut",), "p").select("date", "cut", tercile(F.col("p")).alias("composite_tercile"))
    t = regimes.select("date", "cut", "tercile").join(comp, ["date", "cut"], "full_outer")
    t = t.join(comp.select("cut").distinct(), "cut", "left_semi")
    return t.select("date", "cut", gap(F.col("tercile"), F.col("composite_tercile")).alias("gap"))
