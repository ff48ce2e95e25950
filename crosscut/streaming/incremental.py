"""An extension beyond the batch engine: volatility as prices arrive, and windowed counts of an event stream.

State per series is seven numbers, so history is not kept. Late rows within the watermark are put in order by date
within a micro-batch; rows at or before the last date a series has seen are dropped, as their state has moved on.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import YEAR

STATE = "last_day long, price double, mean double, var double, s double, s2 double, seen long"
OUT = "series_id string, date date, r1 double, vol double"
EPOCH = dt.date(1970, 1, 1)


def streaming_vol(prices: DataFrame, halflife: float, annual: int = YEAR) -> DataFrame:
    """series_id, date, r1, vol of a stream of series_id, date, price (dense: one row a series and date).

    The recursion keeps the weighted mean and variance and the sums of weights and squared weights, scaled to 1.
    """
    alpha = 1.0 - math.exp(-math.log(2.0) / halflife)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, price, mean, var, s, s2, seen = state.get if state.exists else (-1, float("nan"), 0.0, 0.0, 1.0, 1.0, 0)
        rows = []
        new = pd.concat(list(frames)).sort_values("date")
        for date, now in zip(new["date"].tolist(), new["price"].tolist(), strict=True):
            day = (date - EPOCH).days
            if day <= last:
                continue
            r = math.log(now / price) if price > 0 and now > 0 else float("nan")
            if not math.isnan(r):
                a = 1.0 if not seen else alpha
                d = r - mean
                mean, var = mean + a * d, (1 - a) * (var + a * d * d)
                s2 = 1.0 if not seen else (1 - a) ** 2 * s2 + a * a
                seen += 1
            vol = math.sqrt(var * s * s / (s * s - s2) * annual) if s * s > s2 and seen > 1 else None
            rows.append((key[0], date, None if math.isnan(r) else r, vol))
            last, price = day, now
        state.update((last, price, mean, var, s, s2, seen))
        yield pd.DataFrame(rows, columns=["series_id", "date", "r1", "vol"])

    return prices.groupBy("series_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum per tumbling window and event type, with a watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
