"""The engine's inputs drawn from the star schema: nations as countries, order and line prices as two asset classes.

Prices are monthly means of whole cents, so every engine computes the same doubles. Windows are scaled to months.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import correlation as co
from ..operators import cuts as cu
from ..operators import external as ex
from ..operators import windows as wi
from ..operators.classify import classify
from ..plans.engine import cross_sections, kernels
from ..sources.files import shared

WINDOW, HALFLIFE, FAST, FAST_HALFLIFE = 3, 6.0, 1, 3.0
MIN_N, PCT, VALID, LOOKBACK = 10, 24, 12, 5
RHO, CORR, THRESHOLD, CONFIRM = 12, 12, 0.3, 3


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def mean_of(c: str) -> Column:
    return F.sum(cents(c)).cast("double") / (F.lit(100.0) * F.count("*"))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros, and dates as text, so that results compare across engines."""
    kinds = {"double": lambda n: F.round(n, digits) + F.lit(0.0)} | dict.fromkeys(("date", "timestamp", "timestamp_ntz"), lambda n: F.col(n).cast("string"))
    return df.select(*[kinds.get(t, F.col)(n).alias(n) for n, t in df.dtypes])


@dataclass(frozen=True)
class Inputs:
    """Tables over one data folder. What several parts of a query read is written to the shared folder, once a query."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def nations(self) -> DataFrame:
        n = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        seg = F.when(F.col("r_name").isin("EUROPE", "ASIA"), "DM").otherwise("EM")
        return n.select("n_nationkey", F.col("n_name").alias("country"), seg.alias("segment"), (F.col("r_name") == "AMERICA").alias("regional"))

    @cached_property
    def latam(self) -> tuple[str, ...]:
        return tuple(r[0] for r in self.nations.filter("regional").select("country").collect())

    @cached_property
    def facts(self) -> DataFrame:
        """asset_class, country, date, cents, n: a row a month, country and class. Orders and lines are read once, here; what
        is built on them reads this small table from the shared folder."""
        n = F.broadcast(self.nations)
        eq = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        fi = self.table("lineitem").join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        month = lambda c: F.trunc(F.to_date(c), "month").alias("date")
        sums = lambda f, k: f.groupBy("country", "date").agg(F.sum(cents("v")).alias("cents"), F.count("*").alias("n")).select(F.lit(k).alias("asset_class"), "*")
        eq = sums(eq.select("country", month("o_orderdate"), F.col("o_totalprice").alias("v")), "Eq")
        return shared(eq.unionByName(sums(fi.select("country", month("l_shipdate"), F.col("l_extendedprice").alias("v")), "FI")), "facts")

    @cached_property
    def raw_prices(self) -> DataFrame:
        return self.facts.select("date", "country", "asset_class", (F.col("cents").cast("double") / (F.lit(100.0) * F.col("n"))).alias("price"))

    @cached_property
    def prices(self) -> DataFrame:
        from ..sources.panel import shared_countries

        return shared_countries(self.raw_prices)

    @cached_property
    def universe(self) -> DataFrame:
        cap = lambda k, name: (F.sum(F.when(F.col("asset_class") == k, F.col("cents"))) / F.lit(100.0)).alias(name)
        caps = self.facts.groupBy("country").agg(cap("Eq", "eq_mcap"), cap("FI", "fi_mcap"))
        return shared(self.nations.select("country", "segment").join(caps, "country", "left").withColumn("is_composite", F.lit(False)), "universe")

    @cached_property
    def series(self) -> DataFrame:
        return cu.series_of(self.universe)

    @cached_property
    def members(self) -> DataFrame:
        return cu.membership(self.series, self.latam)

    @cached_property
    def returns(self) -> DataFrame:
        return shared(kernels(self.prices, WINDOW, HALFLIFE), "returns")

    @cached_property
    def beta(self) -> DataFrame:
        return shared(cross_sections(self.returns, self.members, self.series, MIN_N), "beta")

    @cached_property
    def tripwire(self) -> DataFrame:
        return cross_sections(kernels(self.prices, FAST, FAST_HALFLIFE), self.members, self.series, MIN_N)

    @cached_property
    def rounded(self) -> DataFrame:
        """Slopes on a grid, so that ranks and labels don't hang on the last bit."""
        return self.beta.withColumn("beta_cap", F.round("beta_cap", 9))

    @cached_property
    def regimes(self) -> DataFrame:
        return shared(classify(self.rounded, window=PCT, lookback=LOOKBACK, min_valid=VALID), "regimes")

    @cached_property
    def both(self) -> DataFrame:
        return wi.dense(self.returns.select("date", "series_id", "r1"), ("series_id",))

    @cached_property
    def pairwise(self) -> DataFrame:
        return shared(co.avg_pairwise(self.both, self.members, CORR), "pairwise")

    @cached_property
    def macro(self) -> DataFrame:
        """Five monthly series; one lacks some months, one is constant."""
        month = F.trunc(F.to_date("l_shipdate"), "month").alias("date")
        t = self.table("lineitem").groupBy(month).agg(mean_of("l_quantity").alias("q"), mean_of("l_discount").alias("d"), mean_of("l_tax").alias("t"), F.count("*").cast("double").alias("n"))
        parts = F.array(*[F.struct(F.lit(i).alias("macro_id"), v.alias("value")) for i, v in (("VIXCLS", F.col("q")), ("BAMLC0A4CBBB", F.col("d")), ("BAMLEMCBPIOAS", F.col("t")), ("BAMLH0A0HYM2", F.col("n")), ("T10Y2Y", F.lit(20.0)))])
        rows = shared(t.select("date", F.explode(parts).alias("m")).select("date", "m.macro_id", "m.value"), "macro")
        return rows.filter(~((F.col("macro_id") == "BAMLC0A4CBBB") & (F.month("date") % 5 == 0)))

    @cached_property
    def rho(self) -> DataFrame:
        return shared(ex.external_corr(self.regimes, self.macro, RHO), "rho")

    @cached_property
    def composites(self) -> DataFrame:
        """One price a segment and class as composite tickers; the regional ones are absent."""
        names = {("DM", "Eq"): "MXWO", ("EM", "Eq"): "MXEF", ("DM", "FI"): "I35402US", ("EM", "FI"): "EMUSTRUU"}
        f = self.facts.join(F.broadcast(self.nations.select("country", "segment")), "country")
        pick = lambda k: F.when(F.col("segment") == "DM", names["DM", k]).otherwise(names["EM", k])
        ticker = F.when(F.col("asset_class") == "Eq", pick("Eq")).otherwise(pick("FI")).alias("ticker")
        return f.groupBy("date", ticker).agg((F.sum("cents").cast("double") / (F.lit(100.0) * F.sum("n"))).alias("price"))

    @cached_property
    def gaps(self) -> DataFrame:
        return ex.internal_consistency(self.regimes, self.composites, WINDOW)

    @cached_property
    def flags(self) -> DataFrame:
        return ex.below_threshold(self.rho, THRESHOLD)

    @cached_property
    def transitions(self) -> DataFrame:
        return al.transitions(self.regimes)

    @cached_property
    def daily(self) -> DataFrame:
        """A long history: six series of daily mean line prices (date, series_id, price), as they come."""
        day = F.to_date("l_shipdate").alias("date")
        return self.table("lineitem").groupBy(day, F.concat("l_returnflag", "l_linestatus").alias("series_id")).agg(mean_of("l_extendedprice").alias("price"))
