"""Time-series kernels as window expressions over dense (date x series) rows.

Windows are partitioned by series (or cut), never global: a partition holds one key's dates. All kernels take the key
and order columns, so they run on any long table. EWMA volatility, rolling ranks, running counts, runs and hysteresis also
take histories of any length: given `size`, they deal a key's rows into blocks of so many and carry states across them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import YEAR
from ..functions.labels import safe_log_ratio
from ..sources.files import shared
from . import blocks

#: The scaled sums of an EWMA window cover so many half-lives at most, to stay in the range of doubles.
SAFE_SPAN = 400


def dense(rows: DataFrame, key: Iterable[str], date: str = "date", within: tuple[str, ...] = ()) -> DataFrame:
    """rows with a row for every date and key: shifts count rows of the calendar, so gaps must be rows.

    within: columns of the key that have a calendar each (equity and fixed income trade on their own days).
    """
    key = list(key)
    keys = rows.select(*key).distinct()
    dates = rows.select(*within, date).distinct()
    spine = keys.join(dates, list(within)) if within else keys.crossJoin(dates)
    return spine.join(rows, [*key, date], "left")


def _over(key: Iterable[str], date: str):
    return Window.partitionBy(*key).orderBy(date)


def last_rows(key: Iterable[str], n: int, date: str = "date"):
    return _over(key, date).rowsBetween(-(n - 1), 0)


def log_return(price: str, rows: int, key: Iterable[str] = ("series_id",), date: str = "date") -> Column:
    """ln(P[t] / P[t - rows])."""
    return safe_log_ratio(F.col(price), F.lag(price, rows).over(_over(key, date)))


def ewma_vol(df: DataFrame, r: str, halflife: float, out: str, key: Iterable[str] = ("series_id",), date: str = "date", annual: int = YEAR, size: int | None = None, long: bool | None = None) -> DataFrame:
    """df with the annualised, demeaned and bias-corrected EWMA volatility of r; NULL rows carry the last value.

    Weights relative to the first observation are running products; scaled sums of them give all moments in one window.
    The weights grow as 2**(rows / halflife). Long histories therefore fall into blocks of SAFE_SPAN / 2 half-lives, and
    the rows of a block are summed together with the block before; what is still earlier weighs under 2**-200. size: the
    rows of a series are numbered over many tasks, if it has more than that, and no task holds more than two blocks.
    """
    key = list(key)
    alpha = 1.0 - math.exp(-math.log(2.0) / halflife)
    span = max(1, int(SAFE_SPAN / 2 * halflife))
    x = F.col(r)
    if size is not None and (blocks.is_long(df, key, size) if long is None else long):
        t = blocks.first_of_key(df if "_i" in df.columns else blocks.numbered(df, key, date), r, "_x0", key).withColumn("_block", blocks.block_of(span))
        t = blocks.last_so_far(t, F.when(x.isNotNull(), F.col("_i")), "_p", key, inclusive=False)
        block, end = F.col("_block"), F.col("_end")
        start = F.when(x.isNotNull(), F.col("_x0"))
    else:
        over = _over(key, date)
        t = df.withColumn("_i", F.row_number().over(over) - 1)
        t = t.withColumn("_p", F.last(F.when(x.isNotNull(), F.col("_i")), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
        block, end = F.floor(F.col("_i") / span), F.max("_i").over(Window.partitionBy(*key))
        start = F.first(x, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))
    gap = F.pow(F.lit(1.0 - alpha), (F.col("_i") - F.col("_p")).cast("double"))
    t = t.withColumn("_a", F.when(x.isNotNull(), F.when(F.col("_p").isNull(), 1.0).otherwise(F.lit(alpha) / (gap + F.lit(alpha)))))
    t = t.withColumn("_z", x - start)
    more = end >= (block + 1) * span
    t = t.withColumn("_g", F.when(more, F.array(block, block + 1)).otherwise(F.array(block))).withColumn("_g", F.explode("_g"))
    run = _over([*key, "_g"], "_i").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_l", F.coalesce(F.sum(F.when(F.col("_a") < 1.0, F.log(1.0 - F.col("_a")))).over(run), F.lit(0.0)))
    t = t.withColumn("_w", F.col("_a") * F.exp(-F.col("_l")))
    w, z = F.col("_w"), F.col("_z")
    t = t.withColumns({"_s": F.sum(w).over(run), "_s2": F.sum(w * w).over(run), "_m": F.sum(w * z).over(run), "_q": F.sum(w * z * z).over(run)})
    s, s2 = F.col("_s"), F.col("_s2")
    raw = F.greatest(F.lit(0.0), F.try_divide(F.col("_q"), s) - F.pow(F.try_divide(F.col("_m"), s), F.lit(2.0)))
    var = F.when(s * s > s2, raw * s * s / (s * s - s2))
    t = t.withColumn(out, F.sqrt(var) * math.sqrt(annual)).filter(F.col("_g") == F.floor(F.col("_i") / span))
    return t.drop("_i", "_p", "_a", "_l", "_w", "_z", "_g", "_s", "_s2", "_m", "_q", "_x0", "_end", "_block")


def ewma_vol_grouped(df: DataFrame, r: str, halflife: float, out: str, key: Iterable[str] = ("series_id",), date: str = "date", annual: int = YEAR) -> DataFrame:
    """The same, one series at a time in pandas: what ewma_vol is tested against."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        return pdf.assign(**{out: pdf[r].astype(float).ewm(halflife=halflife, adjust=False).std() * math.sqrt(annual)})

    done = df.groupBy(*key).applyInPandas(one, f"{fields}, `{out}` double")
    return done.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def counts_at_most(values: np.ndarray, rows: int) -> np.ndarray:
    """For each place, how many of the last `rows` values are at most its own; NaN counts nowhere and has 0.

    A wavelet matrix over the values' ranks: a level for each bit, where a range of places maps to a range of places, so a
    window costs the bits of the number of values, whatever its rows. All windows go down together.
    """
    n, some = len(values), ~np.isnan(values)
    ranks = np.full(n, n, np.int64)
    ranks[some] = np.unique(values[some], return_inverse=True)[1]
    high = np.arange(1, n + 1)
    low, want, found = np.maximum(high - rows, 0), ranks + 1, np.zeros(n, np.int64)
    for bit in range(int(n + 1).bit_length() - 1, -1, -1):
        one = (ranks >> bit) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - one)))
        zl, zh, up = zeros[low], zeros[high], ((want >> bit) & 1).astype(bool)
        found += np.where(up, zh - zl, 0)
        low, high = np.where(up, zeros[-1] + low - zl, zl), np.where(up, zeros[-1] + high - zh, zh)
        ranks = np.concatenate((ranks[one == 0], ranks[one == 1]))
    return np.where(some, found, 0)


def rolling_percentile(df: DataFrame, value: str, rows: int, out: str, key: Iterable[str] = ("cut",), date: str = "date", strict: bool = False, size: int = blocks.BLOCK, long: bool | None = None) -> DataFrame:
    """df with (values of the window <= the current one - 1) / (rows of the window - 1).

    A NULL value counts as a row, and in the default mode ranks below all others: -1 / (rows - 1). strict: NULL. No value in
    the window: NULL. A task ranks up to `size` rows of a key and the rows - 1 before them, at the cost of their logarithm.
    long: whether some key has more than `size` rows; counted if it isn't said.
    """
    key = list(key)
    t = df
    long = blocks.is_long(df, key, size) if long is None else long
    if long:
        t = blocks.halo(df if "_i" in df.columns else blocks.numbered(df, key, date), rows - 1, size)
    order = "_i" if long else date

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        x = table[value].cast(pa.float64()).to_numpy(zero_copy_only=False)
        first = table["_i"][0].as_py() if long else 0
        some = np.concatenate(([0], np.cumsum(~np.isnan(x))))
        at = np.arange(1, len(x) + 1)
        valid = some[at] - some[np.maximum(at - rows, 0)]
        rank = (counts_at_most(x, rows) - 1) / np.maximum(np.minimum(at + first, rows) - 1, 1)
        known = (valid > 0) & (~np.isnan(x) | (not strict))
        table = table.append_column(out, pa.array(rank, pa.float64(), mask=~known))
        return table.filter(table["_own"]) if long else table

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema.fields)
    done = t.groupBy(*key, *["_block"] * long).applyInArrow(one, f"{fields}, `{out}` double")
    return done.drop(*[c for c in ("_block", "_own", "_i") if c not in df.columns])


def direction(value: str, rows: int, key: Iterable[str] = ("cut",), date: str = "date") -> Column:
    """rising, falling or stable by the slope of the last rows against a tenth of their spread; NULL if any is NULL."""
    frame = last_rows(key, rows, date)
    n, x = F.count(value).over(frame), F.col(value)
    sx, sy = F.lit(rows * (rows - 1) / 2.0), F.sum(x).over(frame)
    # sum over the window of place * value, with places 0 to rows - 1
    sxy = sum((F.lit(float(k)) * F.lag(value, rows - 1 - k).over(_over(key, date)) for k in range(1, rows)), F.lit(0.0))
    slope = (sxy - sx * sy / rows) / (rows * (rows * rows - 1) / 12.0)
    spread = F.stddev_pop(x).over(frame)
    return F.when((n == rows) & (rows >= 2), F.when((spread == 0) | (F.abs(slope) < 0.1 * spread), "stable").when(slope > 0, "rising").otherwise("falling"))


def expanding_count(value: str, key: Iterable[str] = ("cut",), date: str = "date") -> Column:
    return F.count(value).over(_over(key, date).rowsBetween(Window.unboundedPreceding, 0))


def forward_fill(value: str, limit: int, key: Iterable[str], date: str = "date") -> Column:
    """The last value within so many rows."""
    return F.last(value, ignorenulls=True).over(_over(key, date).rowsBetween(-limit, 0))


def rolling_corr(a: str, b: str, rows: int, key: Iterable[str], date: str = "date") -> Column:
    """Pearson over rows that must all be pairs; NULL if either side is constant."""
    frame = last_rows(key, rows, date)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    spread = F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame)
    full = F.count(F.when(both, 1)).over(frame) == rows
    return F.when(full, F.try_divide(F.covar_samp(x, y).over(frame), F.when(spread > 1e-300, spread)))


def rolling_beta(r: str, proxy: str, rows: int, key: Iterable[str] = ("series_id",), date: str = "date") -> Column:
    """cov(r, proxy) / var(proxy) over full windows."""
    frame = last_rows(key, rows, date)
    full = (F.count(r).over(frame) == rows) & (F.count(proxy).over(frame) == rows)
    return F.when(full, F.try_divide(F.covar_samp(r, proxy).over(frame), F.var_samp(proxy).over(frame)))


def rolling_vol(r: str, rows: int, key: Iterable[str], date: str = "date", annual: int = YEAR) -> Column:
    frame = last_rows(key, rows, date)
    return F.when(F.count(r).over(frame) == rows, F.stddev_samp(r).over(frame) * math.sqrt(annual))


def weighted_proxy(returns: DataFrame, weights: DataFrame, r: str = "r1", date: str = "date") -> DataFrame:
    """date, proxy: the sum of weight * return over the sum of all weights; missing returns and weights count as 0."""
    w = F.coalesce(F.col("weight"), F.lit(0.0))
    rows = returns.select("series_id", date, r).join(weights.select("series_id", "weight"), "series_id", "left")
    total = rows.select("series_id", w.alias("w")).distinct().agg(F.sum("w").alias("_total"))
    sums = rows.groupBy(date).agg(F.sum(w * F.coalesce(F.col(r), F.lit(0.0))).alias("_s"))
    return sums.crossJoin(F.broadcast(total)).select(date, F.try_divide("_s", "_total").alias("proxy"))


def percent_rank(value: str, key: Iterable[str]) -> Column:
    """Rank over the count of non-NULL values, ties at their mean."""
    by = Window.partitionBy(*key)
    ties = F.count(value).over(Window.partitionBy(*key, value))
    low = F.rank().over(by.orderBy(F.col(value).asc_nulls_last()))
    return F.when(F.col(value).isNotNull(), (low + (ties - 1) / 2) / F.count(value).over(by))


def percent_ranks(df: DataFrame, value: str, key: Iterable[str], out: str, size: int = blocks.BLOCK) -> DataFrame:
    """df with percent_rank, for keys of any number of rows.

    Equal values are counted first, so a value that very many rows share is one row. The values of a key are dealt into
    ranges; how many rows lie below a range is the sum over the ranges before.
    """
    key = list(key)
    if not blocks.is_long(df, key, size):
        return df.withColumn(out, percent_rank(value, key))
    ties = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_ties"))
    at = shared(ties, "values").repartitionByRange(*key, value).sortWithinPartitions(*key, value).withColumn("_range", F.spark_partition_id())
    at = shared(at, "ranked")
    held = at.groupBy(*key, "_range").agg(F.sum("_ties").alias("_n"))
    over = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*key, "_range", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*key)).alias("_all"))
    t = blocks.null_safe_join(at, held, [*key, "_range"])
    below = F.sum("_ties").over(Window.partitionBy(*key, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_ties")
    rank = (F.col("_before") + below + 1 + (F.col("_ties") - 1) / 2) / F.col("_all")
    return blocks.null_safe_join(df, t.select(*key, value, rank.alias(out)), [*key, value], "left")


def runs(df: DataFrame, label: str, key: Iterable[str], date: str = "date", size: int | None = None) -> DataFrame:
    """df without NULL labels, with the number of each row's run of equal labels and its place in it."""
    key = list(key)
    if size is not None and blocks.is_long(df, key, size):
        return blocks.places(df, label, key, date, size).drop("_i", "_block", "_first")
    over = _over(key, date)
    t = df.filter(F.col(label).isNotNull()).withColumn("_new", (~F.col(label).eqNullSafe(F.lag(label).over(over))).cast("int"))
    t = t.withColumn("run", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return t.withColumn("place", F.row_number().over(Window.partitionBy(*key, "run").orderBy(date))).drop("_new")


def run_lengths(df: DataFrame, label: str, key: Iterable[str], date: str = "date", size: int | None = None) -> DataFrame:
    """key, run, start, end, label, rows of each run."""
    key = list(key)
    return runs(df, label, key, date, size).groupBy(*key, "run").agg(
        F.min(date).alias("start"), F.max(date).alias("end"), F.first(label).alias(label), F.count("*").alias("rows")
    )


def hysteresis(df: DataFrame, label: str, rows: int, key: Iterable[str], date: str = "date", out: str = "confirmed", size: int | None = None) -> DataFrame:
    """A new label counts once it has lasted so many rows; the first label seeds.

    The confirmed label of a row is that of the last row that stood at place `rows` or later in its run; places are
    counted while another label is confirmed, which is the case for every run but those of the confirmed label.
    """
    key = list(key)
    held = F.when(F.col("place") >= rows, F.col(label))
    if size is not None and blocks.is_long(df, key, size):
        t = blocks.last_so_far(blocks.places(df, label, key, date, size), held, "_held", key)
        return t.withColumn(out, F.coalesce("_held", "_first")).drop("run", "place", "_held", "_first", "_i", "_block")
    over = _over(key, date)
    t = runs(df, label, key, date)
    held = F.last(held, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(label).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return t.withColumn(out, F.coalesce(held, first)).drop("run", "place")
