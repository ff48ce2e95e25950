"""The pipeline as one lazy graph: kernels, cross-sections, regimes, correlation, validation, tripwire, alerts."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import EngineConfig, to_dict
from ..functions.labels import series_id
from ..operators import alerts as al
from ..operators import blocks
from ..operators import correlation as co
from ..operators import crosssection as cs
from ..operators import cuts as cu
from ..operators import external as ex
from ..operators import validate as va
from ..operators import windows as wi
from ..operators.classify import classify
from ..sources import panel as src
from ..sources import runs
from ..sources.fingerprints import series_digest


@dataclass
class Run:
    """Lazy results of a run."""

    config: EngineConfig
    returns: DataFrame
    beta: DataFrame
    regimes: DataFrame
    correlation: DataFrame
    rho: DataFrame
    flags: DataFrame
    gaps: DataFrame
    tripwire: DataFrame
    transitions: DataFrame
    alerts: DataFrame
    series: DataFrame
    warnings: list[str] = field(default_factory=list)

    def frames(self) -> dict[str, DataFrame]:
        """What the run folder holds."""
        seg = lambda df: df.withColumnRenamed("cut", "segment")
        alerts = self.alerts
        for x in schemas_missing(alerts):
            alerts = alerts.withColumn(x[0], F.lit(None).cast(x[1]))
        return {
            "beta_series": seg(cs.long_form(self.beta)),
            "regimes": seg(self.regimes.withColumnRenamed("percentile", "percentile_5y")),
            "correlation": seg(self.correlation).withColumnsRenamed({"avg_pairwise": "avg_pairwise_3m", "pc1_share": "pc1_variance_share"}),
            "external_validation": seg(self.rho).withColumnsRenamed({"macro_id": "fred_series", "rho": "rolling_corr_60d"}),
            "alerts": alerts,
            "tripwire": seg(cs.long_form(self.tripwire)),
        }


def schemas_missing(alerts: DataFrame) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in runs.ARTIFACTS["alerts"][0].split(", ") if x.split()[0] not in alerts.columns]


def kernels(prices: DataFrame, window: int, halflife: float, size: int = blocks.BLOCK) -> DataFrame:
    """date, series_id, asset_class, price, r1, ret, vol on each asset class's own dense calendar.

    A calendar of more than `size` dates is worked on in blocks, so that no task holds a whole series."""
    rows = prices.select("date", "asset_class", series_id(F.col("country"), F.col("asset_class")).alias("series_id"), "price")
    t = wi.dense(rows, ("asset_class", "series_id"), within=("asset_class",))
    if not blocks.is_long(prices.select("asset_class", "date").distinct(), ("asset_class",), size):
        t = t.withColumns({"r1": wi.log_return("price", 1), "ret": wi.log_return("price", window)})
        return wi.ewma_vol(t, "r1", halflife, "vol")
    t = blocks.halo(blocks.numbered(t, ("series_id",), "date"), window, size)
    own = ("series_id", "_block")
    t = t.withColumns({"r1": wi.log_return("price", 1, own), "ret": wi.log_return("price", window, own)}).filter("_own").drop("_own", "_block")
    return wi.ewma_vol(t, "r1", halflife, "vol", size=size, long=True)


def cross_sections(returns: DataFrame, members: DataFrame, series: DataFrame, min_n: int) -> DataFrame:
    """Slopes on the spine of the equity calendar and all cuts."""
    dates = returns.filter(F.col("asset_class") == "Eq").select("date").distinct()
    fits = cs.fit(cs.panel(returns, members, series), min_n)
    return cs.on_spine(fits, dates, cu.cut_table(returns.sparkSession))


def build(prices: DataFrame, universe: DataFrame, macro: DataFrame, cfg: EngineConfig, composites: DataFrame | None = None, latam: tuple[str, ...] = cu.LATAM) -> Run:
    """The whole graph. Returns, slopes, regimes and correlations are cached, as several branches use them."""
    spark = prices.sparkSession
    series = cu.series_of(universe)
    members = cu.membership(series, latam)
    returns = kernels(prices, cfg.return_window_days, cfg.ewma_halflife_days).cache()
    beta = cross_sections(returns, members, series, cfg.min_n_per_cut).cache()
    regimes = classify(
        beta, cfg.bucket_scheme, cfg.percentile_rows, cfg.direction_lookback_days, cfg.bootstrap_min_days
    ).cache()
    # both calendars side by side: a date that one asset class lacks is a missing return
    both = wi.dense(returns.select("date", "series_id", "r1"), ("series_id",))
    spine = both.select("date").distinct().crossJoin(F.broadcast(cu.cut_table(spark)))
    correlation = co.correlation_panel(both, members, spine, cfg.return_window_days).cache()
    rho = ex.external_corr(regimes, macro, cfg.external_corr_window_days).cache()
    flags = ex.below_threshold(rho, cfg.external_corr_alert_threshold)
    comp = composites if composites is not None else spark.createDataFrame([], schemas.COMPOSITES)
    gaps = ex.internal_consistency(regimes, comp, cfg.return_window_days)
    fast = kernels(prices, cfg.tripwire_window_days, cfg.tripwire_ewma_halflife_days)
    tripwire = cross_sections(fast, members, series, cfg.min_n_per_cut)
    return Run(
        cfg, returns, beta, regimes, correlation, rho, flags, gaps, tripwire, al.transitions(regimes),
        al.all_alerts(regimes, correlation, flags), series,
    )


def run(spark: SparkSession, cfg: EngineConfig, client: src.MacroClient, run_date: str, as_of_data_date: str, force: bool = False, composites: DataFrame | None = None) -> tuple[Run, Path | str]:
    """Load, check, build and write a run."""
    universe = src.load_universe(spark, cfg.data_path)
    va.check_universe(universe)
    prices = src.load_prices(spark, cfg.data_path).cache()
    warnings = va.check_prices(prices)
    lo, hi = prices.filter("asset_class = 'Eq'").agg(F.min("date"), F.max("date")).first()
    macro = src.load_macro(client, lo, hi)
    result = build(prices, universe, macro, cfg, composites)
    result.warnings = warnings
    hashes = {f"macro_{r[0]}": r[1] for r in series_digest(macro).collect()}  # a row per series
    snapshot = {
        "run_date": run_date,
        "as_of_data_date": as_of_data_date,
        "methodology_version": cfg.methodology_version,
        "config_resolved": to_dict(cfg),
        "data_fingerprint": src.fingerprint(spark, cfg.data_path) | hashes,
        "code_version": src.code_version(),
        "warnings": warnings,
    }
    return result, runs.write_run(result.frames(), snapshot, cfg.output_dir, run_date, force)
