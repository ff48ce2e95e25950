"""Acceptance gates of a run, each a one-row frame: gate, passed, value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import gap, quarter_end
from .windows import last_rows, rolling_vol


@dataclass(frozen=True)
class Event:
    name: str
    date: str
    buckets: tuple[str, ...] = ("Risk-off",)
    cuts: tuple[str, ...] = ("global",)


# The episodes that a run should recognise, and the thresholds of the gates.
EVENTS = (
    Event("2010_greek_crisis", "2010-05-06"),
    Event("2011_eurozone_us_downgrade", "2011-08-08"),
    Event("2015_china_devaluation", "2015-08-11"),
    Event("2018_q4_selloff", "2018-12-24"),
    Event("2020_COVID", "2020-03-16"),
    Event("2022_rate_shock_jan", "2022-01-24"),
    Event("2022_rate_shock_sep", "2022-09-26"),
    Event("2008_lehman", "2008-10-10"),
)
EVENT_DAYS = 6
G1 = ("VIXCLS", 0.5, 0.8)
G2 = ("BAMLC0A4CBBB", 0.4, 0.8)
G4_GAP, G4_SHARE = 2, 0.2
G5_MOST, G5_WINDOW = 2.0, 63
G6_GAP, G6_MOST, G6_WINDOW = 1, 5.0, 30


def _row(df: DataFrame, gate: str, passed: Column, value: Column) -> DataFrame:
    return df.select(F.lit(gate).alias("gate"), F.coalesce(passed, F.lit(False)).alias("passed"), value.cast("double").alias("value"))


def share_above(rows: DataFrame, value: Column, least: float) -> DataFrame:
    """share of the defined values that reach a level; NULL if none is defined."""
    return rows.agg(F.avg(F.when(value.isNotNull(), (value >= least).cast("double"))).alias("share"))


def coupling(corr: DataFrame, gate: str, macro_id: str, rho: float, share: float, cut: str = "global") -> DataFrame:
    """A missing series fails."""
    t = share_above(corr.filter((F.col("cut") == cut) & (F.col("macro_id") == macro_id)), F.abs("rho"), rho)
    return _row(t, gate, F.col("share") >= share, F.col("share"))


def event_table(spark: SparkSession, events: tuple[Event, ...] = EVENTS) -> DataFrame:
    return spark.createDataFrame([(e.name, e.date, list(e.buckets), list(e.cuts)) for e in events], "event string, day string, buckets array<string>, cuts array<string>").withColumn("day", F.to_date("day"))


def matched_events(regimes: DataFrame, events: DataFrame, days: int = EVENT_DAYS) -> DataFrame:
    """event, matched: whether any of its cuts has an expected label within so many calendar days."""
    near = (
        F.col("date").between(F.date_sub("day", days), F.date_add("day", days))
        & F.array_contains("cuts", F.col("cut"))
        & F.array_contains("buckets", F.col("tercile"))
    )
    t = F.broadcast(events).join(regimes.select("date", "cut", "tercile"), near, "inner").select("event").distinct()
    return events.join(t.withColumn("hit", F.lit(True)), "event", "left").select("event", F.coalesce("hit", F.lit(False)).alias("matched"))


def recognition(regimes: DataFrame, events: DataFrame, days: int = EVENT_DAYS) -> DataFrame:
    t = matched_events(regimes, events, days).agg(F.count_if("matched").alias("hits"), F.count("*").alias("total"))
    return _row(t, "G3_events", F.col("hits") == F.col("total"), F.col("hits"))


def segmentation(regimes: DataFrame, a: str = "DM_Eq", b: str = "EM_Eq") -> DataFrame:
    side = lambda cut, out: regimes.filter(F.col("cut") == cut).select("date", F.col("tercile").alias(out))
    t = share_above(side(a, "a").join(side(b, "b"), "date"), gap(F.col("a"), F.col("b")), G4_GAP)
    return _row(t, "G4_segmentation_lift", F.col("share") >= G4_SHARE, F.col("share"))


def calm_quarters(proxy: DataFrame, window: int = G5_WINDOW) -> DataFrame:
    """quarter: those whose mean rolling volatility is below the median of all. proxy: date, r1 of one series."""
    t = proxy.filter("r1 is not null").withColumn("one", F.lit(1))
    t = t.select("date", rolling_vol("r1", window, ("one",)).alias("vol"))
    q = t.groupBy(quarter_end(F.col("date")).alias("quarter")).agg(F.avg("vol").alias("vol")).filter("vol is not null")
    return q.crossJoin(F.broadcast(q.agg(F.median("vol").alias("mid")))).filter("vol < mid").select("quarter")


def transitions_per_quarter(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy(quarter_end(F.col("date")).alias("quarter"), "segment").agg(F.count("*").alias("transitions"))


def stability(transitions: DataFrame, proxy: DataFrame, cut: str = "global", window: int = G5_WINDOW) -> DataFrame:
    """No transition in any cut, or no calm quarter, passes."""
    n = transitions_per_quarter(transitions).filter(F.col("segment") == cut)
    t = calm_quarters(proxy, window).join(n, "quarter", "left").agg(F.coalesce(F.max(F.coalesce("transitions", F.lit(0))), F.lit(0)).alias("worst"))
    return _row(t, "G5_stability", F.col("worst") <= G5_MOST, F.col("worst"))


def consistency(gaps: DataFrame, cut: str = "DM") -> DataFrame:
    """No composite data passes."""
    t = gaps.filter(F.col("cut") == cut).withColumn("breach", F.coalesce((F.col("gap") > G6_GAP).cast("int"), F.lit(0)))
    t = t.withColumn("sum", F.sum("breach").over(last_rows(("cut",), G6_WINDOW))).agg(F.coalesce(F.max("sum"), F.lit(0)).alias("worst"))
    return _row(t, "G6_internal", F.col("worst") <= G6_MOST, F.col("worst"))


def evaluate(
    regimes: DataFrame, corr: DataFrame, transitions: DataFrame, proxy: DataFrame, gaps: DataFrame, events: DataFrame,
    days: int = EVENT_DAYS, window: int = G5_WINDOW,
) -> DataFrame:
    """One row per gate."""
    out = coupling(corr, "G1_vix", *G1).unionByName(coupling(corr, "G2_bbb", *G2))
    for part in (recognition(regimes, events, days), segmentation(regimes), stability(transitions, proxy, window=window), consistency(gaps)):
        out = out.unionByName(part)
    return out


