"""Rolling correlation structure of each cut: mean pairwise correlation and the first component's variance share."""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import last_rows

MIN_ROWS, MIN_COLUMNS = 3, 2
#: A series whose deviation in a window is at or below this has no correlation there.
FLAT = 1e-150
#: So many window ends make one block of the rolling matrices.
BLOCK = 256


def avg_pairwise(returns: DataFrame, members: DataFrame, window: int, r: str = "r1") -> DataFrame:
    """date, cut, avg_pairwise: the mean over pairs with a defined correlation; no row without a pair.

    returns is dense. A pair's correlation is defined where both series are whole in the window, so with z a series'
    window, centred and of length 1, the k series that are whole have the pairwise sum (|sum of z|**2 - k) / 2. No pairs
    are formed: one window a series and one partial aggregate of `window` sums a date and cut.
    """
    over = last_rows(("series_id",), window)
    t = returns.select(
        "date",
        "series_id",
        F.count(r).over(over).alias("n"),
        F.avg(r).over(over).alias("mean"),
        (F.stddev_samp(r).over(over)).alias("sd"),
        F.collect_list(r).over(over).alias("v"),
    ).filter((F.col("n") == window) & (F.col("sd") > FLAT))
    scale = F.col("sd") * sqrt(window - 1)
    t = t.select("date", "series_id", F.transform("v", lambda e: (e - F.col("mean")) / scale).alias("z"))
    sums = [F.sum(F.col("z")[i]).alias(f"s{i}") for i in range(window)]
    t = t.join(members.select("cut", "series_id"), "series_id").groupBy("date", "cut").agg(F.count("*").alias("k"), *sums)
    length = F.aggregate(F.array(*[F.col(f"s{i}") for i in range(window)]), F.lit(0.0), lambda a, e: a + e * e)
    k = F.col("k")
    return t.filter(k > 1).select("date", "cut", ((length - k) / (k * (k - 1))).alias("avg_pairwise"))


def first_component(window: np.ndarray) -> float | None:
    """Largest eigenvalue over the trace of the covariance; NULL if any entry isn't finite or the trace isn't positive.

    The products of rows have the same nonzero eigenvalues as those of columns; the smaller of the two is taken.
    """
    if window.shape[0] < MIN_ROWS or window.shape[1] < MIN_COLUMNS or not np.isfinite(window).all():
        return None
    z = window - window.mean(0)
    values = np.linalg.eigvalsh(z @ z.T if z.shape[0] < z.shape[1] else z.T @ z)
    total = float(values.sum())
    return float(values[-1] / total) if total > 0 else None


def rolling_matrix(
    returns: DataFrame, members: DataFrame, window: int, reducer: Callable[[np.ndarray], float | None], out: str, r: str = "r1", block: int = BLOCK
) -> DataFrame:
    """date, cut, out: a reducer over each window's matrix without its all-missing columns; NULL before the first whole window.

    There is no SQL form of an eigenvalue, so a cut's dates are dealt into blocks of window ends, each with the window - 1
    dates before it; a pandas group is one block of one cut. Only the calendar, a row per date, is numbered in one task.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="i", columns="series_id", values="r").sort_index()
        dates, first = pdf.drop_duplicates("i").set_index("i")["date"], int(pdf["block"].iloc[0]) * block
        a, at = wide.to_numpy(float), wide.index.to_numpy()
        some = ~np.isnan(a)
        count = np.concatenate((np.zeros((1, a.shape[1])), np.cumsum(some, 0)))
        ends = np.flatnonzero((at >= first) & (at < first + block))
        values: list[float | None] = [None] * len(ends)
        for n, end in enumerate(ends):
            if end >= window - 1:
                has = count[end + 1] - count[end + 1 - window] > 0
                values[n] = reducer(a[end + 1 - window : end + 1][:, has])
        return pd.DataFrame({"date": dates.loc[at[ends]].to_numpy(), "cut": pdf["cut"].iloc[0], out: pd.array(values, dtype="Float64")})

    calendar = returns.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    block_of = F.explode(F.sequence(F.floor(F.col("i") / block), F.floor((F.col("i") + window - 1) / block))).alias("block")
    rows = returns.select("date", "series_id", F.col(r).alias("r")).join(calendar, "date").select("*", block_of)
    rows = rows.join(members.select("cut", "series_id"), "series_id")
    return rows.groupBy("cut", "block").applyInPandas(one, f"date date, cut string, {out} double")


#: The Gram matrix is formed anew after so many updates, so that rounding doesn't add up.
REFRESH = 64
#: A trace at or below this share of the uncentred one has lost digits to cancellation: that window is centred by itself.
CANCELLED = 1e-6


def top_eigenvalue(c: np.ndarray, start: np.ndarray | None = None, steps: int = 60) -> tuple[float, np.ndarray]:
    """Largest eigenvalue of a symmetric nonnegative matrix, and its vector, by power iteration from a vector nearby.

    A Rayleigh quotient q with residual r is an eigenvalue within r * r / (q - o), if no other exceeds o < q; and the others
    are at most trace - q, and at most the root of the squared norm less q * q. Where neither proves that q is the largest
    to 1e-12 of the trace, all eigenvalues are computed.
    """
    trace, norm = float(np.trace(c)), float((c * c).sum())
    v = np.ones(len(c)) if start is None or not np.isfinite(start).all() or not start.any() else start
    v = v / np.sqrt(v @ v)
    for _ in range(steps):
        w = c @ v
        q = float(v @ w)
        r = w - q * v
        others = min(trace - q, np.sqrt(max(norm - q * q, 0.0)))
        if q > others and float(r @ r) <= 1e-12 * trace * (q - others):
            return q, v
        size = np.sqrt(w @ w)
        if not size > 0:
            break
        v = w / size
    values, vectors = np.linalg.eigh(c)
    return float(values[-1]), vectors[:, -1]


def rolling_shares(a: np.ndarray, first: int, window: int) -> list[float | None]:
    """The first component's share in the windows that end at `first` and later: rows are dates, columns series.

    A window's products of columns follow from those of the window before by the row that comes and the row that goes. The
    share is NULL where a column has some but not all values, where fewer than two have any, and without any variance.
    """
    n, p = a.shape
    some, fine = ~np.isnan(a), np.isfinite(a)
    held = lambda x: np.concatenate((np.zeros((1, p), np.int64), np.cumsum(x, 0)))
    has, whole = held(some), held(fine)
    with np.errstate(invalid="ignore"):
        shift = np.where(fine, a, 0.0).sum(0) / np.maximum(fine.sum(0), 1)
        x = np.where(fine, a - shift, 0.0)
    out: list[float | None] = []
    gram = total = vector = columns = None
    since = 0
    for end in range(first, n):
        low = end + 1 - window
        if gram is None or since >= REFRESH:
            gram, total, since = x[low : end + 1].T @ x[low : end + 1], x[low : end + 1].sum(0), 0
        else:
            gram += np.outer(x[end], x[end]) - np.outer(x[low - 1], x[low - 1])
            total += x[end] - x[low - 1]
            since += 1
        full = whole[end + 1] - whole[low] == window
        if window < MIN_ROWS or full.sum() < MIN_COLUMNS or ((has[end + 1] - has[low] > 0) != full).any():
            out.append(None)
            continue
        c, t = (gram, total) if full.all() else (gram[np.ix_(full, full)], total[full])
        raw = float(np.trace(c))
        c = c - np.outer(t, t) / window
        if np.trace(c) <= CANCELLED * raw:
            z = a[low : end + 1][:, full]
            z = z - z.mean(0)
            c = z.T @ z
        trace = float(np.trace(c))
        if not trace > 0:
            out.append(None)
            continue
        value, vector = top_eigenvalue(c, vector if columns is not None and (columns == full).all() else None)
        columns = full
        out.append(value / trace)
    return out


def first_component_share(returns: DataFrame, members: DataFrame, window: int, out: str = "pc1_share", r: str = "r1", block: int = BLOCK) -> DataFrame:
    """date, cut, out: the share of the first principal component in the window's covariance; NULL before the first whole window.

    A cut's dates are dealt into blocks of window ends, each with the window - 1 dates before it. Rows come as numbers, of
    the date and of the series in its cut, and are put into their cells.
    """

    def one(table: pa.Table) -> pa.Table:
        i, j, v = (table[c].to_numpy() for c in ("i", "j", "r"))
        lo = int(table["block"][0].as_py()) * block
        begin = int(i.min())
        a = np.full((int(i.max()) - begin + 1, int(j.max()) + 1), np.nan)
        a[i - begin, j] = v
        a = a[:, (~np.isnan(a)).any(0)]
        day = np.empty(len(a), table["date"].to_numpy().dtype)
        day[i - begin] = table["date"].to_numpy()
        own = np.arange(lo - begin, min(lo + block - begin, len(a)))  # none in a block behind the last date
        ready = max(lo - begin, window - 1)
        values = [None] * min(ready - (lo - begin), len(own)) + (rolling_shares(a, ready, window) if ready < len(a) else [])[: max(len(own), 0)]
        values = values[: len(own)]
        return pa.table({"date": pa.array(day[own]).cast(pa.date32()), "cut": pa.array([table["cut"][0].as_py()] * len(own), pa.string()), out: pa.array(values, pa.float64())})

    calendar = returns.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    block_of = F.explode(F.sequence(F.floor(F.col("i") / block), F.floor((F.col("i") + window - 1) / block))).alias("block")
    place = members.select("cut", "series_id", (F.dense_rank().over(Window.partitionBy("cut").orderBy("series_id")) - 1).alias("j"))
    value = F.coalesce(F.col(r), F.lit(float("nan"))).alias("r")
    rows = returns.select("date", "series_id", value).join(calendar, "date").join(place, "series_id").select("date", "cut", "i", "j", "r", block_of)
    return rows.groupBy("cut", "block").applyInArrow(one, f"date date, cut string, {out} double")


def correlation_panel(returns: DataFrame, members: DataFrame, spine: DataFrame, window: int, r: str = "r1") -> DataFrame:
    """date, cut, avg_pairwise, pc1_share on every date of the spine."""
    share = first_component_share(returns, members, window, "pc1_share", r)
    t = spine.select("date", "cut").join(avg_pairwise(returns, members, window, r), ["date", "cut"], "left")
    return t.join(share, ["date", "cut"], "left")
