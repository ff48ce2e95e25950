"""Series, the ten overlapping cuts as a bridge table, and pairs of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import series_id

# The cuts, the countries of the regional one, and each cut's composite tickers.
CUTS = ("global", "DM", "EM", "Equity", "FI", "DM_Eq", "EM_Eq", "DM_FI", "EM_FI", "LatAm")
LATAM = ("Brazil", "Mexico", "Chile", "Peru", "Colombia")
COMPOSITE_NAMES = ("DM", "EM", "Europe", "Asia", "World", "LatAm")
COMPOSITE_MAP = {
    "global": ("MXWD", "LEGATRUU"),
    "DM": ("MXWO", "I35402US"),
    "EM": ("MXEF", "EMUSTRUU"),
    "Equity": ("MXWD", None),
    "FI": (None, "LEGATRUU"),
    "DM_Eq": ("MXWO", None),
    "EM_Eq": ("MXEF", None),
    "DM_FI": (None, "I35402US"),
    "EM_FI": (None, "EMUSTRUU"),
    "LatAm": ("MXLA", "H04338US"),
}
#: The filters that the report offers, in its order; Full is everything.
REPORT_CUTS = ("Full", "DM", "EM", "DM_Eq", "EM_Eq", "DM_FI", "EM_FI")


def series_of(universe: DataFrame) -> DataFrame:
    """Two series a country: equity with eq_mcap, fixed income with fi_mcap."""
    both = universe.filter(~F.col("is_composite")).select(
        "country", "segment", F.explode(F.array(*[F.struct(F.lit(k).alias("asset_class"), F.col(c).alias("mcap")) for k, c in (("Eq", "eq_mcap"), ("FI", "fi_mcap"))])).alias("s")
    )
    return both.select(series_id(F.col("country"), F.col("s.asset_class")).alias("series_id"), "country", "segment", "s.asset_class", "s.mcap")


def predicates(latam: tuple[str, ...] = LATAM) -> dict:
    """The condition of each cut on a series row."""
    dm, em = F.col("segment") == "DM", F.col("segment") == "EM"
    eq, fi = F.col("asset_class") == "Eq", F.col("asset_class") == "FI"
    return {
        "global": F.lit(True), "DM": dm, "EM": em, "Equity": eq, "FI": fi,
        "DM_Eq": dm & eq, "EM_Eq": em & eq, "DM_FI": dm & fi, "EM_FI": em & fi, "LatAm": F.col("country").isin(*latam),
    }


def membership(series: DataFrame, latam: tuple[str, ...] = LATAM) -> DataFrame:
    """cut, series_id: a row for each cut that a series belongs to, in one pass over the dimension."""
    names = F.array(*[F.when(cond, F.lit(name)) for name, cond in predicates(latam).items()])
    return series.select(F.explode(F.filter(names, lambda c: c.isNotNull())).alias("cut"), "series_id")


def report_filter(series: DataFrame, name: str) -> DataFrame:
    """The series of a report cut."""
    if name not in REPORT_CUTS:
        raise ValueError(f"Unknown segment: {name}")
    return series if name == "Full" else series.filter(predicates()[name])


def cut_table(spark: SparkSession) -> DataFrame:
    """The ten cuts with their order."""
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in CUTS])).alias("cut_ord", "cut"))
