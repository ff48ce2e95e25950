"""Regimes of each cut from its cap-weighted slope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BucketScheme
from ..functions.labels import bucket, quintile
from . import blocks
from .windows import direction, expanding_count, rolling_percentile


def classify(
    beta: DataFrame,
    scheme: BucketScheme = BucketScheme.TERCILE,
    window: int = 1260,
    lookback: int = 5,
    min_valid: int = 252,
    thin: tuple[str, ...] = ("LatAm",),
    value: str = "beta_cap",
    strict: bool = False,
    size: int = blocks.BLOCK,
) -> DataFrame:
    """beta: dense date x cut rows with the slope and n. Adds percentile, tercile, quintile, direction and flags.

    strict: a missing slope has no percentile; by default it ranks below all others, as the engine always did. A cut with
    more than `size` dates is worked on in blocks of so many.
    """
    t = beta.select("date", "cut", value, "n")
    long = blocks.is_long(t, ("cut",), size)
    if long:
        t = blocks.running_count(blocks.numbered(t, ("cut",), "date"), value, "_valid", ("cut",), "date", size)
        t = blocks.halo(t, lookback - 1, size).withColumn("direction", direction(value, lookback, ("cut", "_block")))
        t = t.filter("_own").drop("_own", "_block")
    else:
        t = t.withColumns({"_valid": expanding_count(value), "direction": direction(value, lookback)})
    t = rolling_percentile(t, value, window, "_p", strict=strict, size=size, long=long)
    t = t.withColumn("percentile", F.when(F.col("_valid") >= min_valid, F.col("_p")))
    p = F.col("percentile")
    return t.select(
        "date", "cut", "percentile", bucket(p, scheme).alias("tercile"), quintile(p).alias("quintile"), "direction", "n",
        F.col("cut").isin(*thin).alias("thin_cut"), (F.col("_valid") < window).alias("bootstrap"),
    )
