"""Events: bucket transitions, disagreement with correlation, and weak external correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import ON

DISAGREEMENT = 0.6


def transitions(regimes: DataFrame, label: str = "tercile") -> DataFrame:
    over = Window.partitionBy("cut").orderBy("date")
    t = regimes.select("date", F.col("cut").alias("segment"), F.lag(label).over(over).alias("from_bucket"), F.col(label).alias("to_bucket"))
    return t.filter(F.col("from_bucket").isNotNull() & ~F.col("from_bucket").eqNullSafe(F.col("to_bucket")))


def disagreement(regimes: DataFrame, correlation: DataFrame, threshold: float = DISAGREEMENT) -> DataFrame:
    """Risk-on although the mean pairwise correlation is high."""
    calm = regimes.filter(F.col("tercile") == ON).select("date", "cut", F.col("tercile").alias("vol_slope_bucket"))
    tight = correlation.filter(F.col("avg_pairwise") > threshold).select("date", "cut", "avg_pairwise")
    return calm.join(tight, ["date", "cut"]).select("date", F.col("cut").alias("segment"), "vol_slope_bucket", "avg_pairwise")


def degradation(flags: DataFrame) -> DataFrame:
    return flags.filter("below_threshold").select("date", F.col("cut").alias("segment"), F.col("macro_id").alias("fred_series"))


def all_alerts(regimes: DataFrame, correlation: DataFrame, flags: DataFrame) -> DataFrame:
    """The three kinds under one another, with their kind."""
    kinds = {"bucket_transition": transitions(regimes), "disagreement": disagreement(regimes, correlation), "validation_degradation": degradation(flags)}
    out = None
    for kind, df in kinds.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
