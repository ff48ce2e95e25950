"""Weighted cross-sectional regression of return on volatility, per date and cut, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A weighted variance of x at or below this share of its squared mean is a constant x.
SINGULAR = 1e-12


def panel(returns: DataFrame, members: DataFrame, series: DataFrame, y: str = "ret", x: str = "vol") -> DataFrame:
    """date, cut, x, y, w of each series with both values; whether the dimension is broadcast is Spark's choice by its size."""
    dim = members.join(series.select("series_id", "mcap"), "series_id")
    rows = returns.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    return rows.join(dim, "series_id").select("date", "cut", F.col(x).alias("x"), F.col(y).alias("y"), F.col("mcap").alias("w"))


def _fit(w: str, mx: str, my: str) -> dict[str, Column]:
    """Centred sums: the raw-moment form would lose the singularity test to rounding."""
    dx, dy, weight = F.col("x") - F.col(mx), F.col("y") - F.col(my), F.col(w)
    return {"sxx": F.sum(weight * dx * dx), "sxy": F.sum(weight * dx * dy), "syy": F.sum(weight * dy * dy), "sw": F.sum(weight)}


def _slope(p: str, mx: str) -> tuple[Column, Column, Column]:
    sxx, sxy, syy = (F.col(f"{p}_{k}") / F.col(f"{p}_sw") for k in ("sxx", "sxy", "syy"))
    singular = (sxx <= 0) | (sxx <= F.lit(SINGULAR) * F.col(mx) * F.col(mx))
    beta = F.when(~singular, F.try_divide(sxy, sxx))
    r2 = F.when(~singular & (syy > 0), F.try_divide(sxy * sxy, sxx * syy))
    return beta, r2, singular


def fit(rows: DataFrame, min_n: int) -> DataFrame:
    """Per date and cut: beta_cap, r2_cap, beta_eq, r2_eq, slope_spread, n, suppressed, singular.

    Two aggregates on one key: weighted means, then centred sums; the means are joined back on the same partitioning.
    """
    ok = rows.withColumn("u", F.lit(1.0))
    mean = ok.groupBy("date", "cut").agg(
        F.count("*").alias("n"),
        F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("cx"),
        F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w")).alias("cy"),
        F.avg("x").alias("ex"),
        F.avg("y").alias("ey"),
    )
    sums = [c.alias(f"{p}_{k}") for p, w, mx, my in (("c", "w", "cx", "cy"), ("e", "u", "ex", "ey")) for k, c in _fit(w, mx, my).items()]
    t = ok.join(mean, ["date", "cut"]).groupBy("date", "cut").agg(F.first("n").alias("n"), F.first("cx").alias("cx"), F.first("ex").alias("ex"), *sums)
    bc, rc, sc = _slope("c", "cx")
    be, re_, se = _slope("e", "ex")
    few = F.col("n") < min_n
    keep = lambda c: F.when(~few, c)
    return t.select(
        "date", "cut", keep(bc).alias("beta_cap"), keep(rc).alias("r2_cap"), keep(be).alias("beta_eq"), keep(re_).alias("r2_eq"), "n",
        few.alias("suppressed"), (~few & (sc | se)).alias("singular"),
    ).withColumn("slope_spread", F.col("beta_cap") - F.col("beta_eq"))


def on_spine(fits: DataFrame, dates: DataFrame, cuts: DataFrame) -> DataFrame:
    """A row for every date and cut: no series means n = 0, suppressed."""
    spine = dates.select("date").distinct().crossJoin(F.broadcast(cuts.select("cut", "cut_ord")))
    return (
        spine.join(fits, ["date", "cut"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("suppressed", F.coalesce("suppressed", F.lit(True)))
        .withColumn("singular", F.coalesce("singular", F.lit(False)))
    )


def long_form(fits: DataFrame) -> DataFrame:
    """Both schemes as rows, in one pass: date, cut, scheme, beta, r2, n, suppressed, singular."""
    schemes = [F.struct(F.lit(s).alias("scheme"), F.col(f"beta_{k}").alias("beta"), F.col(f"r2_{k}").alias("r2")) for s, k in (("cap_wtd", "cap"), ("eq_wtd", "eq"))]
    t = fits.select("date", "cut", F.explode(F.array(*schemes)).alias("s"), "n", "suppressed", "singular")
    return t.select("date", "cut", "s.scheme", "s.beta", "s.r2", "n", "suppressed", "singular")


def ols_band(rows: DataFrame, key: tuple[str, ...] = ("date", "cut", "segment"), min_n: int = 3) -> DataFrame:
    """Unweighted line per group with standard errors of slope and intercept; groups with constant x or few rows go."""
    key = list(key)
    m = rows.groupBy(*key).agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"))
    dx, dy = F.col("x") - F.col("mean_x"), F.col("y") - F.col("mean_y")
    t = rows.join(m.filter((F.col("n") >= min_n) & (F.col("x_hi") > F.col("x_lo"))), key).groupBy(*key).agg(
        *[F.first(c).alias(c) for c in ("n", "mean_x", "mean_y", "x_lo", "x_hi")], F.sum(dx * dx).alias("sxx"), F.sum(dx * dy).alias("sxy"), F.sum(dy * dy).alias("syy")
    )
    t = t.withColumn("slope", F.try_divide("sxy", "sxx")).withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_x"))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    s2 = F.try_divide(rest, (F.col("n") - 2).cast("double"))
    t = t.withColumn("se_slope", F.sqrt(F.try_divide(s2, F.col("sxx"))))
    t = t.withColumn("se_intercept", F.col("se_slope") * F.sqrt(F.col("sxx") / F.col("n") + F.col("mean_x") * F.col("mean_x")))
    return t.select(*key, "n", "mean_x", "x_lo", "x_hi", "slope", "intercept", "se_slope", "se_intercept")


def band_points(lines: DataFrame, points: int = 50, z: float = 1.96) -> DataFrame:
    """The 95 % band at evenly spaced x: sqrt(se_intercept**2 + (x - mean_x)**2 * se_slope**2)."""
    t = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    t = t.withColumn("x", F.col("x_lo") + (F.col("x_hi") - F.col("x_lo")) * F.col("i") / (points - 1))
    half = z * F.sqrt(F.pow("se_intercept", F.lit(2.0)) + F.pow(F.col("x") - F.col("mean_x"), F.lit(2.0)) * F.pow("se_slope", F.lit(2.0)))
    y = F.col("intercept") + F.col("slope") * F.col("x")
    return t.withColumn("fit", y).withColumn("upper", y + half).withColumn("lower", y - half)
