"""Checks of the inputs, each a query of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP = 3


class DataSourceError(ValueError):
    """An input breaks a rule."""


def bad_universe(universe: DataFrame) -> DataFrame:
    """Countries with a cap that isn't positive or a segment other than DM and EM; a missing cap passes."""
    return universe.filter(~F.col("is_composite")).filter(
        (F.col("eq_mcap") <= 0) | (F.col("fi_mcap") <= 0) | ~F.coalesce(F.col("segment").isin("DM", "EM"), F.lit(False))
    )


def longest_gaps(dates: DataFrame, key: tuple[str, ...] = ("asset_class",)) -> DataFrame:
    """key, longest: the most Monday-to-Friday days in a row that a calendar lacks between its ends."""
    key = list(key)
    d = dates.select(*key, "date").distinct()
    ends = d.groupBy(*key).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = ends.select(*key, F.explode(F.sequence("lo", "hi")).alias("date")).filter(F.weekday("date") < 5)
    over = Window.partitionBy(*key).orderBy("date")
    days = days.withColumn("i", F.row_number().over(over))
    lost = days.join(d, [*key, "date"], "left_anti").withColumn("island", F.col("i") - F.row_number().over(over))
    runs = lost.groupBy(*key, "island").count().groupBy(*key).agg(F.max("count").alias("longest"))
    return ends.select(*key).join(runs, key, "left").select(*key, F.coalesce("longest", F.lit(0)).alias("longest"))


def missing_counts(prices: DataFrame, key: tuple[str, ...] = ("asset_class", "country")) -> DataFrame:
    """key, missing: the NULL prices of each dense column that has any."""
    return prices.groupBy(*key).agg(F.count_if(F.col("price").isNull()).alias("missing")).filter("missing > 0")


def price_checks(prices: DataFrame) -> DataFrame:
    """asset_class, longest, missing: both checks of each asset class's calendar; prices is dense."""
    lost = missing_counts(prices, ("asset_class",))
    return longest_gaps(prices).join(lost, "asset_class", "left").select("asset_class", "longest", F.coalesce("missing", F.lit(0)).alias("missing"))


def check_universe(universe: DataFrame) -> None:
    if rows := bad_universe(universe).select("country").limit(5).collect():
        raise DataSourceError(f"bad market cap or segment: {[r[0] for r in rows]}")


def check_prices(prices: DataFrame) -> list[str]:
    """Raises for a long gap; returns a warning per series with missing prices."""
    for r in longest_gaps(prices).filter(F.col("longest") > MAX_GAP).collect():  # a row per asset class
        raise DataSourceError(f"{r[0]}: {r[1]} business days in a row are missing")
    return [f"{r[0]} {r[1]}: {r[2]} missing prices" for r in missing_counts(prices).orderBy("asset_class", "country").collect()]
