"""Explicit schemas of the long tables. Missing values are NULL; NaN becomes NULL at ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRICES = "date date, country string, asset_class string, price double"
UNIVERSE = "country string, segment string, eq_mcap double, fi_mcap double, is_composite boolean"
SERIES = "series_id string, country string, segment string, asset_class string, mcap double"
MEMBERSHIP = "cut string, series_id string"
MACRO = "date date, macro_id string, value double"
COMPOSITES = "date date, ticker string, price double"
BETA = "date date, cut string, scheme string, beta double, r2 double, n long, suppressed boolean, singular boolean"
REGIMES = (
    "date date, segment string, tercile string, percentile_5y double, quintile string, direction string, n long, "
    "thin_cut boolean, bootstrap boolean"
)
CORRELATION = "date date, segment string, avg_pairwise_3m double, pc1_variance_share double"
VALIDATION = "date date, segment string, fred_series string, rolling_corr_60d double"


def nan_to_null(df: DataFrame) -> DataFrame:
    """All NaN of double columns as NULL."""
    fix = {n: F.when(~F.isnan(n), F.col(n)) for n, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fix) if fix else df


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df
