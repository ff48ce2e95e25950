"""A query per operator, each with its SQL where SQL can say it. Names begin with the operator's id."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BucketScheme
from ..functions import labels as fn
from ..operators import alerts as al
from ..operators import correlation as co
from ..operators import crosssection as cs
from ..operators import cuts as cu
from ..operators import gates as ga
from ..operators import validate as va
from ..operators import windows as wi
from ..operators.classify import classify
from ..plans import backtest as bt
from ..plans.engine import Run
from ..report import bundle as rb
from ..sources import fingerprints as fp
from ..sources import panel as src
from ..sources import runs
from ..sources.files import joined, shared_dir
from . import base
from .base import Inputs, tidy
from .sql import ASYM, ORDINAL, PC1, QUINTILE, TERCILE, q, r

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


#: Date columns of the queries whose dates aren't in one column `date`; they compare as text.
DATES = dict.fromkeys(
    (
        "s1_universe_split s6_macro_ids s7_series_hash s7_series_tree p1_universe_check p2_calendar_gaps p3_missing_counts p4_price_checks p7_membership p8_report_filter w14_breach_window "
        "j1_series_dimension j7_event_window j8_weight_alignment j11_series_with_prices u1_union_all u2_difference u3_intersection "
        "a7_stability_metrics a8_share_above a9_any_match a10_axis_range f9_safe_math f11_series_id c4_alerts c5_external_panel g1_vix_gate "
        "g2_bbb_gate g3_event_gate g4_segmentation_gate g5_stability_gate g6_consistency_gate g7_all_gates o4_extremes"
    ).split(),
    (),
) | {
    "w18_runs": ("start", "end"),
    "r5_regime_bands": ("start", "end"),
    "x_hourly_events": ("start",),
    "j9_calm_alignment": ("quarter",),
    "a6_calm_quarters": ("quarter",),
    "a7_transitions_per_quarter": ("quarter",),
    "f12_quarters": ("date", "quarter_end"),
}


def query(name: str, sql: str | None = None):
    """Registers a function of Inputs."""

    def add(f: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, d: tidy(f(Inputs(spark, d)))
        if sql is not None:
            text = ", ".join(f'"{c}"::VARCHAR AS "{c}"' for c in DATES.get(name, ("date",)))
            ORACLE_SQL[name] = f"SELECT * REPLACE ({text}) FROM ({sql}) z" if text else sql
        return f

    return add


# ---- sources and sinks

query("s1_universe_split", q(f"SELECT country, segment, {r('eq_mcap')} AS eq_mcap, {r('fi_mcap')} AS fi_mcap, country IN ('BRAZIL', 'CHINA') AS is_composite FROM universe"))(
    lambda x: x.universe.withColumn("is_composite", F.col("country").isin("BRAZIL", "CHINA"))
)
query("s2_shared_prices", q(f"SELECT date, country, asset_class, {r('price')} AS price FROM prices"))(lambda x: x.prices.select("date", "country", "asset_class", "price"))
query("s4_macro_pull", q(f"SELECT date, macro_id, {r('value')} AS value FROM macro WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"))(
    lambda x: src.load_macro(src.TableClient(x.macro), "1996-01-01", "1999-12-31")
)
query("s6_macro_ids", q(f"SELECT DISTINCT macro_id FROM macro WHERE macro_id IN {src.MACRO_IDS}"))(lambda x: x.macro.filter(F.col("macro_id").isin(*src.MACRO_IDS)).select("macro_id").distinct())
query("s7_series_hash", q("SELECT macro_id, sha256(string_agg(h, ',' ORDER BY h)) AS hash FROM (SELECT macro_id, md5(date::VARCHAR || '|' || value::VARCHAR) AS h FROM macro) t GROUP BY macro_id"))(lambda x: src.series_hash(x.macro))
_FOLD = "SELECT macro_id, {label} AS label, sha256(string_agg(label || ':' || digest, ',' ORDER BY label)) AS digest FROM {t} GROUP BY ALL"
_TREE = (
    ", d AS (SELECT macro_id, date::VARCHAR AS label, sha256(string_agg(v || ':' || n, ',' ORDER BY v || ':' || n)) AS digest FROM "
    "(SELECT macro_id, date, coalesce(value::VARCHAR, '-') AS v, count(*)::VARCHAR AS n FROM macro GROUP BY ALL) z GROUP BY macro_id, date)"
    + "".join(f", {t} AS ({_FOLD.format(label=f'substr(label, 1, {n})', t=of)})" for t, of, n in (("m", "d", 7), ("y", "m", 4), ("e", "y", 3), ("w", "e", 0)))
    + " " + " UNION ALL ".join(f"SELECT macro_id, label, digest FROM {t}" for t in "dmyew")
)
query("s7_series_tree", q(_TREE))(lambda x: fp.series_nodes(x.macro))
_LONG = "SELECT date, cut, 'cap_wtd' AS scheme, {b} AS beta, {r2} AS r2, n, suppressed, singular FROM {t} UNION ALL SELECT date, cut, 'eq_wtd', {be}, {re}, n, suppressed, singular FROM {t}"
_long = lambda t: q(_LONG.format(t=t, b=r("beta_cap"), r2=r("r2_cap"), be=r("beta_eq"), re=r("r2_eq")))
query("s13_beta_writer_rows", _long("beta"))(lambda x: cs.long_form(x.beta))
query("s12_stacked_cuts", q(f"SELECT date, cut AS segment, 'eq_wtd' AS scheme, {r('beta_eq')} AS beta, n FROM beta UNION ALL SELECT date, cut, 'cap_wtd', {r('beta_cap')}, n FROM beta"))(
    lambda x: cs.long_form(x.beta).select("date", F.col("cut").alias("segment"), "scheme", "beta", "n")
)
query("s19_tripwire_rows", f"SELECT date, cut AS segment, scheme, beta, r2, n, suppressed, singular FROM ({_long('trip')}) t")(lambda x: cs.long_form(x.tripwire).withColumnRenamed("cut", "segment"))
query("s14_melt", q(f"SELECT date, cut AS segment, {r('beta_cap')} AS beta FROM beta"))(
    lambda x: src.melt(x.beta.groupBy("date").pivot("cut", list(cu.CUTS)).agg(F.first("beta_cap")), "beta")
)
query("s15_regime_rows", q(f"SELECT date, cut AS segment, tercile, {r('percentile')} AS percentile_5y, quintile, direction, n, thin_cut, bootstrap FROM reg"))(
    lambda x: x.regimes.withColumnsRenamed({"cut": "segment", "percentile": "percentile_5y"})
)
query("s16_correlation_rows", q(f"SELECT d.date, c.cut, {r('avg_pairwise')} AS avg_pairwise FROM alldates d CROSS JOIN cuts c LEFT JOIN pairwise p ON p.date = d.date AND p.cut = c.cut"))(
    lambda x: x.both.select("date").distinct().crossJoin(cu.cut_table(x.spark)).join(x.pairwise, ["date", "cut"], "left").select("date", "cut", "avg_pairwise")
)
query("s17_validation_rows", q(f"SELECT date, cut AS segment, macro_id AS fred_series, {r('rho')} AS rolling_corr_60d FROM rho"))(
    lambda x: x.rho.withColumnsRenamed({"cut": "segment", "macro_id": "fred_series", "rho": "rolling_corr_60d"})
)
_ALERTS = f"""SELECT date, segment, from_bucket, to_bucket, 'bucket_transition' AS kind, NULL::VARCHAR AS vol_slope_bucket, NULL::DOUBLE AS avg_pairwise, NULL::VARCHAR AS fred_series FROM trans
UNION ALL SELECT g.date, g.cut, NULL, NULL, 'disagreement', 'Risk-on', {r('avg_pairwise')}, NULL FROM reg g JOIN pairwise p ON g.date = p.date AND g.cut = p.cut WHERE tercile = 'Risk-on' AND avg_pairwise > 0.6::DOUBLE
UNION ALL SELECT date, cut, NULL, NULL, 'validation_degradation', NULL, NULL, macro_id FROM rho WHERE abs(rho) < 0.3::DOUBLE"""
query("s18_alert_rows", q(_ALERTS))(lambda x: al.all_alerts(x.regimes, x.pairwise, x.flags))



def _place(x: Inputs, name: str) -> str:
    return joined(shared_dir(x.spark), "crosscut", f"{name}-{uuid.uuid4().hex}")


def _run(x: Inputs) -> Run:
    """The whole run of the catalog's inputs."""
    spine = x.both.select("date").distinct().crossJoin(cu.cut_table(x.spark))
    share = co.first_component_share(x.both, x.members, base.CORR)
    correlation = spine.select("date", "cut").join(x.pairwise, ["date", "cut"], "left").join(share, ["date", "cut"], "left")
    alerts = al.all_alerts(x.regimes, x.pairwise, x.flags)
    return Run(None, x.returns, x.beta, x.regimes, correlation, x.rho, x.flags, x.gaps, x.tripwire, x.transitions, alerts, x.series)


def _run_sink(x: Inputs) -> DataFrame:
    """All artifacts written as a version under its manifest, and the slopes read back from there."""
    folder = runs.write_run(_run(x).frames(), {}, _place(x, "runs"), "run", flat=False)
    return runs.read_artifact(x.spark, folder, "beta_series")


def _alerts_file(x: Inputs) -> DataFrame:
    """The alerts as one sorted file, read back by its header with damage as an error."""
    folder, (schema, order) = _place(x, "alerts"), runs.ARTIFACTS["alerts"]
    runs.write_csv(al.all_alerts(x.regimes, x.pairwise, x.flags), f"{folder}/alerts.csv", schema, order)
    return runs.read_artifact(x.spark, folder, "alerts")


def _history_file(x: Inputs) -> DataFrame:
    """The backtest's table of correlations, written and read back."""
    path, schema = f"{_place(x, 'backtest')}/validation_corr_history.csv", "date date, segment string, fred_series string, rho double"
    rows = x.rho.withColumnsRenamed({"cut": "segment", "macro_id": "fred_series"}).filter("rho is not null")
    runs.write_csv(rows, path, schema, ("date", "_cut", "fred_series"))
    names = runs.columns_of(schema)
    return runs.read_rows(x.spark, [path], names, schema, ",".join(names))


query("s10_run_sink", f"SELECT date, cut AS segment, scheme, beta, r2, n, suppressed, singular FROM ({_long('beta')}) t")(_run_sink)
query("s11_alerts_file", q(_ALERTS))(_alerts_file)
query("s22_history_file", q(f"SELECT date, cut AS segment, macro_id AS fred_series, {r('rho')} AS rho FROM rho WHERE rho IS NOT NULL"))(_history_file)

# ---- filters and checks

query("p1_universe_check", q("SELECT country FROM universe WHERE segment = 'DM' OR eq_mcap <= 0 OR fi_mcap <= 0"))(
    lambda x: va.bad_universe(x.universe.withColumn("segment", F.when(F.col("segment") == "DM", "XX").otherwise("EM"))).select("country")
)
query(
    "p2_calendar_gaps",
    """WITH d AS (SELECT DISTINCT l_returnflag || l_linestatus AS asset_class, l_shipdate::DATE AS date FROM lineitem WHERE l_returnflag <> 'R' OR day(l_shipdate) NOT BETWEEN 10 AND 15),
e AS (SELECT asset_class, min(date) AS lo, max(date) AS hi FROM d GROUP BY 1),
b AS (SELECT asset_class, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY asset_class ORDER BY date) AS i FROM b WHERE isodow(date) < 6),
l AS (SELECT *, i - row_number() OVER (PARTITION BY asset_class ORDER BY date) AS g FROM n WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.asset_class = n.asset_class AND d.date = n.date)),
c AS (SELECT asset_class, g, count(*) AS k FROM l GROUP BY 1, 2)
SELECT e.asset_class, coalesce(max(k), 0)::BIGINT AS longest FROM e LEFT JOIN c USING (asset_class) GROUP BY 1""",
)(lambda x: va.longest_gaps(x.daily.withColumnRenamed("series_id", "asset_class").filter(~F.col("asset_class").startswith("R") | ~F.dayofmonth("date").between(10, 15))))
query("p3_missing_counts", q("SELECT asset_class, series_id, count(*) AS missing FROM dense WHERE price IS NULL GROUP BY ALL"))(
    lambda x: va.missing_counts(x.returns, ("asset_class", "series_id"))
)
query(
    "p4_price_checks",
    q(""", e AS (SELECT asset_class, min(date) AS lo, max(date) AS hi FROM dense GROUP BY 1),
b AS (SELECT asset_class, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY asset_class ORDER BY date) AS i FROM b WHERE isodow(date) < 6),
l AS (SELECT *, i - row_number() OVER (PARTITION BY asset_class ORDER BY date) AS g FROM n WHERE NOT EXISTS (SELECT 1 FROM dense d WHERE d.asset_class = n.asset_class AND d.date = n.date)),
k AS (SELECT asset_class, g, count(*) AS k FROM l GROUP BY 1, 2)
SELECT e.asset_class, (SELECT coalesce(max(k), 0)::BIGINT FROM k WHERE k.asset_class = e.asset_class) AS longest,
  (SELECT count(*) FROM dense d WHERE d.asset_class = e.asset_class AND price IS NULL) AS missing FROM e"""),
)(lambda x: va.price_checks(x.returns))
query("p6_cell_lookup", q(f"SELECT d.date, s.series_id, {r('t.vol')} AS vol, {r('t.ret')} AS ret FROM alldates d CROSS JOIN series s LEFT JOIN rets t ON t.date = d.date AND t.series_id = s.series_id"))(
    lambda x: (
        x.returns.select("date").distinct().crossJoin(x.series.select("series_id")).join(x.returns.select("date", "series_id", "vol", "ret"), ["date", "series_id"], "left")
    )
)
query("p5_finite_pairs", q(f"SELECT date, cut, count(*) AS n, {r('sum(x)')} AS sx FROM beta_1 GROUP BY ALL"))(
    lambda x: cs.panel(x.returns, x.members, x.series).groupBy("date", "cut").agg(F.count("*").alias("n"), F.sum("x").alias("sx"))
)
query("p7_membership", q("SELECT cut, series_id FROM mem"))(lambda x: x.members)
query("p8_report_filter", q("SELECT 'Full' AS cut, series_id, segment FROM series UNION ALL SELECT cut, s.series_id, segment FROM mem JOIN series s USING (series_id) WHERE cut IN ('DM', 'EM', 'DM_Eq', 'EM_Eq', 'DM_FI', 'EM_FI')"))(
    lambda x: rb.report_members(x.series)
)
query("p9_trailing_slice", q(f"SELECT date, series_id, {r('ret')} AS ret FROM rets WHERE date IN (SELECT date FROM alldates ORDER BY date DESC LIMIT 10)"))(
    lambda x: rb.last_dates(x.returns, 10).select("date", "series_id", "ret")
)
query("p10_macro_range", q(f"SELECT date, {r('value')} AS value FROM macro WHERE macro_id = 'VIXCLS' AND date BETWEEN DATE '1997-03-01' AND DATE '1998-03-01'"))(
    lambda x: src.TableClient(x.macro).fetch("VIXCLS", "1997-03-01", "1998-03-01").select("date", "value")
)

# ---- window kernels

query("w1_log_return", q(f"SELECT date, series_id, {r('ret')} AS ret FROM rets"))(lambda x: x.returns.select("date", "series_id", "ret"))
query("w2_daily_return", q(f"SELECT date, series_id, {r('r1')} AS r1 FROM rets"))(lambda x: x.returns.select("date", "series_id", "r1"))
query("w3_ewma_vol", q(f"SELECT date, series_id, {r('vol')} AS vol FROM rets"))(lambda x: x.returns.select("date", "series_id", "vol"))
query("w3_ewma_vol_grouped", q(f"SELECT date, series_id, {r('vol')} AS vol FROM rets"))(
    lambda x: wi.ewma_vol_grouped(x.returns.select("date", "series_id", "r1"), "r1", base.HALFLIFE, "vol").select("date", "series_id", "vol")
)
query("w4_rolling_percentile", q(f"SELECT date, cut, {r('p')} AS percentile FROM pct2"))(
    lambda x: wi.rolling_percentile(x.rounded.select("date", "cut", "beta_cap"), "beta_cap", base.PCT, "percentile").drop("beta_cap")
)
query("w4_rolling_percentile_strict", q(f"SELECT date, cut, {r('CASE WHEN beta_cap IS NOT NULL THEN p END')} AS percentile FROM pct2"))(
    lambda x: wi.rolling_percentile(x.rounded.select("date", "cut", "beta_cap"), "beta_cap", base.PCT, "percentile", strict=True).drop("beta_cap")
)
query("w5_direction", q("SELECT date, cut, direction FROM dir"))(lambda x: x.rounded.select("date", "cut", wi.direction("beta_cap", base.LOOKBACK).alias("direction")))
query("w6_expanding_count", q("SELECT date, cut, valid_all AS valid FROM pct2"))(lambda x: x.rounded.select("date", "cut", wi.expanding_count("beta_cap").alias("valid")))
query("w7_rolling_corr", q(f"SELECT date, cut, macro_id, {r('rho')} AS rho FROM rho"))(lambda x: x.rho)
_KEY = ("cut", "macro_id")
query("w8_forward_fill", q("SELECT date, macro_id, round(value, 6) AS value, round(last_value(value IGNORE NULLS) OVER (PARTITION BY macro_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS filled FROM (SELECT d.date, i.macro_id, m.value FROM alldates d CROSS JOIN (SELECT DISTINCT macro_id FROM macro) i LEFT JOIN macro m ON m.date = d.date AND m.macro_id = i.macro_id) t"))(
    lambda x: (
        x.both.select("date").distinct().crossJoin(x.macro.select("macro_id").distinct()).join(x.macro, ["date", "macro_id"], "left")
        .select("date", "macro_id", "value", wi.forward_fill("value", 2, ("macro_id",)).alias("filled"))
    )
)
query("w9_mean_pairwise", q(f"SELECT date, cut, {r('avg_pairwise')} AS avg_pairwise FROM pairwise"))(lambda x: x.pairwise)
query("w10_first_component", q(PC1 + f"SELECT date, cut, {r('pc1_share')} AS pc1_share FROM pc1"))(lambda x: co.first_component_share(x.both, x.members, base.CORR))
_PROXY = "proxy AS (SELECT date, sum(coalesce(w, 0) * coalesce(r1, 0)) / (SELECT sum(coalesce(mcap, 0)) FROM series WHERE series_id IN (SELECT series_id FROM rets)) AS proxy FROM (SELECT t.date, t.r1, s.mcap AS w FROM rets t LEFT JOIN series s USING (series_id)) z GROUP BY date)"
_BETA = f""", {_PROXY}, bv AS (SELECT t.date, t.series_id, CASE WHEN count(r1) OVER w = 12 AND count(proxy) OVER w = 12 AND var_samp(proxy) OVER w > 0 THEN covar_samp(r1, proxy) OVER w / var_samp(proxy) OVER w END AS beta
FROM rets t JOIN proxy USING (date) WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


def _proxied(x: Inputs) -> DataFrame:
    weights = x.series.select("series_id", F.col("mcap").alias("weight"))
    return x.returns.join(wi.weighted_proxy(x.returns, weights), "date", "left")


query("w11_rolling_beta", q(_BETA + f"SELECT date, series_id, {r('beta')} AS beta FROM bv"))(
    lambda x: _proxied(x).select("date", "series_id", wi.rolling_beta("r1", "proxy", base.CORR).alias("beta"))
)
query("w12_weighted_proxy", q(f", {_PROXY} SELECT date, {r('proxy')} AS proxy FROM proxy"))(
    lambda x: wi.weighted_proxy(x.returns, x.series.select("series_id", F.col("mcap").alias("weight")))
)
query("w13_rolling_vol", q(f"SELECT date, series_id, {r('CASE WHEN count(r1) OVER w = 12 THEN stddev_samp(r1) OVER w * sqrt(252.0::DOUBLE) END')} AS vol FROM rets WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"))(
    lambda x: x.returns.select("date", "series_id", wi.rolling_vol("r1", base.CORR, ("series_id",)).alias("vol"))
)
query("w14_breach_window", q("SELECT cut, max(s)::BIGINT AS worst FROM (SELECT cut, sum((gap > 1)::INT) OVER (PARTITION BY cut ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS s FROM gaps) t GROUP BY cut"))(
    lambda x: x.gaps.select("cut", F.sum((F.col("gap") > 1).cast("int")).over(wi.last_rows(("cut",), 30)).alias("s")).groupBy("cut").agg(F.max("s").alias("worst"))
)
query("w15_percent_rank", q(f"SELECT ticker, date, {r('CASE WHEN ret IS NOT NULL THEN (rank() OVER (PARTITION BY ticker ORDER BY ret NULLS LAST) + (count(ret) OVER (PARTITION BY ticker, ret) - 1) / 2.0::DOUBLE) / count(ret) OVER (PARTITION BY ticker) END')} AS p FROM (SELECT ticker, date, round(ret, 1) AS ret FROM comp1) t"))(
    lambda x: wi.percent_ranks(_composite_returns(x).withColumn("ret", F.round("ret", 1)), "ret", ("ticker",), "p").select("ticker", "date", "p")
)
query("w16_previous_label", q("SELECT date, segment, from_bucket, to_bucket FROM prev"))(
    lambda x: x.regimes.select("date", F.col("cut").alias("segment"), F.lag("tercile").over(Window.partitionBy("cut").orderBy("date")).alias("from_bucket"), F.col("tercile").alias("to_bucket"))
)
_HELD = "coalesce(last_value(CASE WHEN place >= 3 THEN tercile END IGNORE NULLS) OVER (PARTITION BY cut ORDER BY date ROWS UNBOUNDED PRECEDING), first_value(tercile) OVER (PARTITION BY cut ORDER BY date))"
query("w17_hysteresis", q(f"SELECT date, cut, {_HELD} AS confirmed FROM isl"))(lambda x: wi.hysteresis(x.regimes.select("date", "cut", "tercile"), "tercile", 3, ("cut",)).select("date", "cut", "confirmed"))
query("w18_runs", q('SELECT cut, tercile, min(date) AS start, max(date) AS "end", count(*) AS rows FROM isl GROUP BY cut, run, tercile'))(
    lambda x: wi.run_lengths(x.regimes.select("date", "cut", "tercile"), "tercile", ("cut",)).drop("run")
)


def _composite_returns(x: Inputs) -> DataFrame:
    from ..operators.external import composite_returns

    return composite_returns(x.composites, base.WINDOW)


# ---- joins and set operations

query("j1_series_dimension", q(f"SELECT m.cut, s.series_id, s.country, s.asset_class, {r('mcap')} AS mcap FROM mem m JOIN series s USING (series_id)"))(
    lambda x: x.members.join(x.series, "series_id").select("cut", "series_id", "country", "asset_class", "mcap")
)
query("j2_date_cut_spine", q("SELECT date, cut, n FROM beta"))(lambda x: x.beta.select("date", "cut", "n"))
query("j3_both_calendars", q(f"SELECT date, series_id, {r('r1')} AS r1 FROM bothr"))(lambda x: x.both)
query("j4_union_calendar", q(f"SELECT date, cut, macro_id, {r('percentile')} AS percentile, {r('value')} AS value FROM ext0"))(
    lambda x: x.regimes.select("date", "cut", "percentile").crossJoin(x.macro.select("macro_id").distinct()).join(x.macro.crossJoin(x.regimes.select("cut").distinct()), ["date", "cut", "macro_id"], "full_outer")
)
query("j5_regime_merge", q(f"SELECT g.date, g.cut, tercile, {r('avg_pairwise')} AS avg_pairwise FROM reg g LEFT JOIN pairwise p ON p.date = g.date AND p.cut = g.cut"))(
    lambda x: x.regimes.select("date", "cut", "tercile").join(x.pairwise, ["date", "cut"], "left")
)
query("j6_composite_blend", q(f"SELECT date, cut, {r('ret')} AS ret FROM comp2"))(lambda x: _blended(x))
_EVENTS = (ga.Event("early", "1996-05-10"), ga.Event("middle", "1998-08-20", ("Risk-off", "Risk-on"), ("DM", "FI")), ga.Event("late", "2000-12-28", ("Risk-on",), ("LatAm", "global")))
_EV = "ev AS (SELECT * FROM (VALUES ('early', DATE '1996-05-10', ['Risk-off'], ['global']), ('middle', DATE '1998-08-20', ['Risk-off', 'Risk-on'], ['DM', 'FI']), ('late', DATE '2000-12-28', ['Risk-on'], ['LatAm', 'global'])) v(event, day, buckets, in_cuts))"
_HIT = "(SELECT event, bool_or(coalesce(list_contains(buckets, tercile) AND list_contains(in_cuts, cut), false)) AS matched FROM ev LEFT JOIN reg ON date BETWEEN day - 45 AND day + 45 GROUP BY event)"
query("j7_event_window", q(f", {_EV} SELECT event, matched FROM {_HIT} t"))(lambda x: ga.matched_events(x.regimes, ga.event_table(x.spark, _EVENTS), 45))
query("j8_weight_alignment", q(f"SELECT DISTINCT t.series_id, {r('coalesce(CASE WHEN asset_class_s = 1 THEN mcap END, 0)')} AS weight FROM rets t LEFT JOIN (SELECT series_id, mcap, (asset_class = 'Eq')::INT AS asset_class_s FROM series) s USING (series_id)"))(
    lambda x: x.returns.select("series_id").distinct().join(x.series.filter("asset_class = 'Eq'"), "series_id", "left").select("series_id", F.coalesce("mcap", F.lit(0.0)).alias("weight"))
)
_CALM = """, px AS (SELECT date, r1 FROM rets WHERE series_id = (SELECT min(series_id) FROM rets WHERE asset_class = 'Eq') AND r1 IS NOT NULL),
pv AS (SELECT date, CASE WHEN count(r1) OVER w = 6 THEN stddev_samp(r1) OVER w * sqrt(252.0::DOUBLE) END AS vol FROM px WINDOW w AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
pq AS (SELECT (date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS quarter, avg(vol) AS vol FROM pv GROUP BY 1 HAVING avg(vol) IS NOT NULL),
calm AS (SELECT quarter FROM pq WHERE vol < (SELECT median(vol) FROM pq)),
tq AS (SELECT (date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS quarter, segment, count(*) AS transitions FROM trans GROUP BY ALL) """


def _proxy(x: Inputs) -> DataFrame:
    eq = x.returns.filter(F.col("asset_class") == "Eq")
    return eq.join(F.broadcast(eq.agg(F.min("series_id").alias("series_id"))), "series_id", "left_semi").select("date", "r1")


query("j9_calm_alignment", q(_CALM + "SELECT quarter, coalesce(transitions, 0) AS transitions FROM calm LEFT JOIN (SELECT * FROM tq WHERE segment = 'global') t USING (quarter)"))(
    lambda x: ga.calm_quarters(_proxy(x), 6).join(ga.transitions_per_quarter(x.transitions).filter("segment = 'global'"), "quarter", "left").select("quarter", F.coalesce("transitions", F.lit(0)).alias("transitions"))
)
query("j10_composite_gap", q("SELECT date, cut, gap FROM gaps"))(lambda x: x.gaps)
query("j11_series_with_prices", q("SELECT series_id, country, segment, asset_class FROM series WHERE series_id IN (SELECT series_id FROM rets)"))(
    lambda x: x.series.join(x.returns.select("series_id"), "series_id", "left_semi").select("series_id", "country", "segment", "asset_class")
)
query("u1_union_all", q("SELECT cut, count(*) AS n FROM (SELECT cut FROM beta UNION ALL SELECT cut FROM reg) t GROUP BY cut"))(
    lambda x: x.beta.select("cut").unionByName(x.regimes.select("cut")).groupBy("cut").agg(F.count("*").alias("n"))
)
query("u2_difference", q("SELECT series_id FROM series EXCEPT SELECT series_id FROM mem WHERE cut = 'DM_Eq'"))(
    lambda x: x.series.select("series_id").join(x.members.filter("cut = 'DM_Eq'"), "series_id", "left_anti").distinct()
)
query("u3_intersection", q("SELECT country FROM raw_prices WHERE asset_class = 'Eq' INTERSECT SELECT country FROM raw_prices WHERE asset_class = 'FI'"))(
    lambda x: x.raw_prices.filter("asset_class = 'Eq'").select("country").intersect(x.raw_prices.filter("asset_class = 'FI'").select("country"))
)


def _blended(x: Inputs) -> DataFrame:
    from ..operators.external import blend

    return blend(_composite_returns(x))


# ---- aggregations

_FIT = ", ".join(f"{r(c)} AS {c}" for c in ("beta_cap", "r2_cap", "beta_eq", "r2_eq"))
query("a1_weighted_fit", q(f"SELECT date, cut, {r('beta_cap')} AS beta, {r('r2_cap')} AS r2 FROM beta WHERE n > 0"))(
    lambda x: x.beta.filter("n > 0").select("date", "cut", F.col("beta_cap").alias("beta"), F.col("r2_cap").alias("r2"))
)
query("a2_slope_only", q(f"SELECT date, cut, {r('CASE WHEN var_pop(x) > 1e-12::DOUBLE * avg(x) * avg(x) AND count(*) >= 10 THEN regr_slope(y, x) END')} AS beta FROM beta_1 WHERE date IN (SELECT date FROM rets WHERE asset_class = 'Eq') GROUP BY date, cut HAVING count(*) >= 10"))(
    lambda x: x.beta.filter("not suppressed").select("date", "cut", F.col("beta_eq").alias("beta"))
)
query("a3_cross_section", q(f"SELECT date, cut, {_FIT}, {r('beta_cap - beta_eq')} AS slope_spread, n, suppressed, singular FROM beta"))(lambda x: x.beta.drop("cut_ord"))
query("a4_per_date_cut", q("SELECT date, sum(n)::BIGINT AS n, count(CASE WHEN suppressed THEN 1 END) AS suppressed FROM beta GROUP BY date"))(
    lambda x: x.beta.groupBy("date").agg(F.sum("n").alias("n"), F.count_if("suppressed").alias("suppressed"))
)
query("a5_panel_assembly", q(f"SELECT date, cut, {r('x')} AS x, {r('y')} AS y, {r('w')} AS w FROM beta_1"))(
    lambda x: cs.panel(x.returns, x.members, x.series)
)
query("a6_calm_quarters", q(_CALM + "SELECT quarter FROM calm"))(lambda x: ga.calm_quarters(_proxy(x), 6))
query("a7_transitions_per_quarter", q(_CALM + "SELECT quarter, segment, transitions FROM tq"))(lambda x: ga.transitions_per_quarter(x.transitions))
query("a7_stability_metrics", q("SELECT year(date) || 'Q' || quarter(date) AS quarter, segment, count(*) AS transitions FROM trans GROUP BY ALL"))(lambda x: bt.stability_metrics(x.transitions))
query("a8_share_above", q(f"SELECT {r('avg((abs(rho) >= 0.3::DOUBLE)::INT)')} AS share FROM rho WHERE rho IS NOT NULL"))(lambda x: ga.share_above(x.rho, F.abs("rho"), 0.3))
query("a9_any_match", q(f", {_EV} SELECT bool_or(matched) AS any_matched, bool_and(matched) AS all_matched FROM {_HIT} t"))(
    lambda x: ga.matched_events(x.regimes, ga.event_table(x.spark, _EVENTS), 45).agg(F.bool_or("matched").alias("any_matched"), F.bool_and("matched").alias("all_matched"))
)
query("a10_axis_range", q(f"""SELECT cut, {r('lo - 0.05::DOUBLE * CASE WHEN hi > lo THEN hi - lo ELSE 1 END')} AS lo, {r('hi + 0.05::DOUBLE * CASE WHEN hi > lo THEN hi - lo ELSE 1 END')} AS hi FROM
(SELECT cut, min(vol) AS lo, max(vol) AS hi FROM (SELECT 'Full' AS cut, vol FROM rets UNION ALL SELECT cut, vol FROM rets JOIN mem USING (series_id) WHERE cut IN ('DM', 'EM', 'DM_Eq', 'EM_Eq', 'DM_FI', 'EM_FI')) t GROUP BY cut) z"""))(
    lambda x: rb.axis_ranges(x.returns, rb.report_members(x.series), "vol")
)
_OLS = """, pt AS (SELECT t.date, s.segment AS cut, t.vol AS x, t.ret AS y FROM rets t JOIN series s USING (series_id) WHERE vol IS NOT NULL AND ret IS NOT NULL),
om AS (SELECT date, cut, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y, min(x) AS x_lo, max(x) AS x_hi FROM pt GROUP BY ALL HAVING count(*) >= 3 AND max(x) > min(x)),
os AS (SELECT date, cut, any_value(n) AS n, any_value(mean_x) AS mean_x, any_value(mean_y) AS mean_y, any_value(x_lo) AS x_lo, any_value(x_hi) AS x_hi, sum((x - mean_x) * (x - mean_x)) AS sxx, sum((x - mean_x) * (y - mean_y)) AS sxy, sum((y - mean_y) * (y - mean_y)) AS syy FROM pt JOIN om USING (date, cut) GROUP BY ALL),
ol AS (SELECT *, sxy / sxx AS slope, mean_y - sxy / sxx * mean_x AS intercept, sqrt(greatest(syy - sxy / sxx * sxy, 0) / (n - 2) / sxx) AS se_slope FROM os),
ob AS (SELECT *, se_slope * sqrt(sxx / n + mean_x * mean_x) AS se_intercept FROM ol) """


def _lines(x: Inputs) -> DataFrame:
    rows = x.returns.filter("vol is not null and ret is not null").join(x.series.select("series_id", F.col("segment").alias("cut")), "series_id")
    return cs.ols_band(rows.select("date", "cut", F.col("vol").alias("x"), F.col("ret").alias("y")), ("date", "cut"))


query("a11_ols_errors", q(_OLS + f"SELECT date, cut, n, {r('mean_x')} AS mean_x, {r('x_lo')} AS x_lo, {r('x_hi')} AS x_hi, {r('slope')} AS slope, {r('intercept')} AS intercept, {r('se_slope')} AS se_slope, {r('se_intercept')} AS se_intercept FROM ob"))(_lines)
query("a12_band_points", q(_OLS + f", bp AS (SELECT date, cut, i, x_lo + (x_hi - x_lo) * i / 49 AS x, slope, intercept, se_slope, se_intercept, mean_x FROM ob CROSS JOIN (SELECT unnest(range(50)) AS i)) SELECT date, cut, i::INTEGER AS i, {r('x', 5)} AS x, {r('intercept + slope * x + 1.96::DOUBLE * sqrt(se_intercept * se_intercept + (x - mean_x) * (x - mean_x) * se_slope * se_slope)', 5)} AS upper, {r('intercept + slope * x - 1.96::DOUBLE * sqrt(se_intercept * se_intercept + (x - mean_x) * (x - mean_x) * se_slope * se_slope)', 5)} AS lower FROM bp"))(
    lambda x: tidy(cs.band_points(_lines(x)).select("date", "cut", "i", "x", "upper", "lower"), 5)
)

# ---- labels

_labels = lambda x, f: x.regimes.select("date", "cut", f(F.col("percentile")).alias("label"))
query("f1_tercile", q(f"SELECT date, cut, {TERCILE.format('percentile')} AS label FROM reg"))(lambda x: _labels(x, fn.tercile))
query("f2_quintile", q(f"SELECT date, cut, {QUINTILE.format('percentile')} AS label FROM reg"))(lambda x: _labels(x, fn.quintile))
query("f3_asymmetric", q(f"SELECT date, cut, {ASYM.format('percentile')} AS label FROM reg"))(lambda x: _labels(x, fn.asymmetric))
query("f4_scheme_dispatch", q(f"SELECT date, cut, {ASYM.format('percentile')} AS tercile, quintile FROM reg"))(
    lambda x: classify(x.rounded, BucketScheme.ASYM_20_60_20, base.PCT, base.LOOKBACK, base.VALID).select("date", "cut", "tercile", "quintile")
)
query("f5_classify", q(f"SELECT date, cut, {r('percentile')} AS percentile, tercile, quintile, direction, n, thin_cut, bootstrap FROM reg"))(lambda x: x.regimes)
query("f6_composite_tercile", q(f"SELECT date, cut, {TERCILE.format('p')} AS label FROM comp3"))(
    lambda x: _blended(x).select("date", "cut", fn.tercile(wi.percent_rank("ret", ("cut",))).alias("label"))
)
query("f7_ordinal", q(f"SELECT date, cut, {ORDINAL.format('tercile')} AS ord FROM reg"))(lambda x: x.regimes.select("date", "cut", fn.ordinal(F.col("tercile")).alias("ord")))
query("f8_label_gap", q(f"SELECT a.date, abs({ORDINAL.format('a.tercile')} - {ORDINAL.format('b.tercile')}) AS gap FROM reg a JOIN reg b ON a.date = b.date AND a.cut = 'Equity' AND b.cut = 'FI'"))(
    lambda x: x.regimes.filter("cut = 'Equity'").select("date", F.col("tercile").alias("a")).join(x.regimes.filter("cut = 'FI'").select("date", F.col("tercile").alias("b")), "date").select("date", fn.gap(F.col("a"), F.col("b")).alias("gap"))
)
query("f9_safe_math", q(f"SELECT country, {r('CASE WHEN eq_mcap / nullif(fi_mcap, 0) > 0 THEN ln(eq_mcap / nullif(fi_mcap, 0)) END')} AS ratio FROM universe"))(
    lambda x: x.universe.select("country", fn.safe_log_ratio(F.col("eq_mcap"), F.col("fi_mcap")).alias("ratio"))
)
query("f10_not_infinite", q(f"SELECT date, country, asset_class, {r('price / nullif(month(date) % 4, 0)')} AS share FROM prices"))(
    lambda x: x.prices.select("date", "country", "asset_class", fn.finite_ratio(F.col("price"), F.month("date") % 4).alias("share"))
)
query("f11_series_id", q("SELECT DISTINCT country, asset_class, country || '_' || asset_class AS series_id FROM prices"))(
    lambda x: x.prices.select("country", "asset_class", fn.series_id(F.col("country"), F.col("asset_class")).alias("series_id")).distinct()
)
query("f12_quarters", q("SELECT date, year(date) || 'Q' || quarter(date) AS label, (date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS quarter_end FROM alldates"))(
    lambda x: x.both.select("date").distinct().select("date", fn.quarter_label(F.col("date")).alias("label"), fn.quarter_end(F.col("date")).alias("quarter_end"))
)

# ---- alerts, validation, gates

query("c1_transitions", q("SELECT date, segment, from_bucket, to_bucket FROM trans"))(lambda x: x.transitions)
query("c2_disagreement", q(f"SELECT g.date, g.cut AS segment, 'Risk-on' AS vol_slope_bucket, {r('avg_pairwise')} AS avg_pairwise FROM reg g JOIN pairwise p ON g.date = p.date AND g.cut = p.cut WHERE tercile = 'Risk-on' AND avg_pairwise > 0.05::DOUBLE"))(
    lambda x: al.disagreement(x.regimes, x.pairwise, 0.05)
)
query("c3_degradation", q("SELECT date, cut AS segment, macro_id AS fred_series FROM rho WHERE abs(rho) < 0.3::DOUBLE"))(lambda x: al.degradation(x.flags))
query("c4_alerts", q(f"SELECT kind, segment, count(*) AS n FROM ({_ALERTS}) t GROUP BY ALL"))(lambda x: al.all_alerts(x.regimes, x.pairwise, x.flags).groupBy("kind", "segment").agg(F.count("*").alias("n")))
query("c5_external_panel", q(f"SELECT macro_id, cut, count(rho) AS n, {r('avg(rho)')} AS mean FROM rho GROUP BY ALL"))(lambda x: x.rho.groupBy("macro_id", "cut").agg(F.count("rho").alias("n"), F.avg("rho").alias("mean")))
query("c6_below_threshold", q(f"SELECT date, cut, macro_id, {r('rho')} AS rho, coalesce(abs(rho) < 0.3::DOUBLE, false) AS below_threshold FROM rho"))(lambda x: x.flags)
query("c7_internal_consistency", q("SELECT date, cut, gap FROM gaps"))(lambda x: x.gaps)
query("c8_correlation_panel", q(PC1 + f"SELECT date, cut, {r('avg_pairwise')} AS avg_pairwise, {r('pc1_share')} AS pc1_share FROM pc1 LEFT JOIN pairwise USING (date, cut)"))(lambda x: co.correlation_panel(x.both, x.members, x.both.select("date").distinct().crossJoin(cu.cut_table(x.spark)), base.CORR))
query("c9_tripwire", _long("trip"))(lambda x: cs.long_form(x.tripwire))
_gate = lambda macro, rho: q(f"SELECT '{{g}}' AS gate, coalesce(avg(f) >= 0.8::DOUBLE, false) AS passed, {r('avg(f)')} AS value FROM (SELECT (abs(rho) >= {rho}::DOUBLE)::INT AS f FROM rho WHERE cut = 'global' AND macro_id = '{macro}' AND rho IS NOT NULL) t")
query("g1_vix_gate", _gate("VIXCLS", 0.5).replace("{g}", "G1_vix"))(lambda x: ga.coupling(x.rho, "G1_vix", *ga.G1))
query("g2_bbb_gate", _gate("BAMLC0A4CBBB", 0.4).replace("{g}", "G2_bbb"))(lambda x: ga.coupling(x.rho, "G2_bbb", *ga.G2))
_G3 = f"SELECT 'G3_events' AS gate, count(CASE WHEN matched THEN 1 END) = count(*) AS passed, count(CASE WHEN matched THEN 1 END)::DOUBLE AS value FROM {_HIT} t"
query("g3_event_gate", q(f", {_EV} {_G3}"))(lambda x: ga.recognition(x.regimes, ga.event_table(x.spark, _EVENTS), 45))
_G4 = f"SELECT 'G4_segmentation_lift' AS gate, coalesce(avg(f) >= 0.2::DOUBLE, false) AS passed, {r('avg(f)')} AS value FROM (SELECT (abs({ORDINAL.format('a.tercile')} - {ORDINAL.format('b.tercile')}) >= 2)::INT AS f FROM reg a JOIN reg b ON a.date = b.date AND a.cut = 'DM_Eq' AND b.cut = 'EM_Eq') t"
query("g4_segmentation_gate", q(_G4))(lambda x: ga.segmentation(x.regimes))
_G5 = "SELECT 'G5_stability' AS gate, coalesce(max(coalesce(transitions, 0)), 0) <= 2 AS passed, coalesce(max(coalesce(transitions, 0)), 0)::DOUBLE AS value FROM calm LEFT JOIN (SELECT * FROM tq WHERE segment = 'global') t USING (quarter)"
query("g5_stability_gate", q(_CALM + _G5))(lambda x: ga.stability(x.transitions, _proxy(x), window=6))
_G6 = "SELECT 'G6_internal' AS gate, coalesce(max(s), 0) <= 5 AS passed, coalesce(max(s), 0)::DOUBLE AS value FROM (SELECT sum(coalesce((gap > 1)::INT, 0)) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS s FROM gaps WHERE cut = 'DM') t"
query("g6_consistency_gate", q(_G6))(lambda x: ga.consistency(x.gaps))
_G12 = (_gate("VIXCLS", 0.5).replace("{g}", "G1_vix"), _gate("BAMLC0A4CBBB", 0.4).replace("{g}", "G2_bbb"))
_ALL = " UNION ALL ".join(f"SELECT * FROM ({g.removeprefix(q(''))}) z{i}" for i, g in enumerate((*_G12, _G3, _G4, _G5, _G6)))
query("g7_all_gates", q(f", {_EV} {_CALM} {_ALL}"))(
    lambda x: ga.evaluate(x.regimes, x.rho, x.transitions, _proxy(x), x.gaps, ga.event_table(x.spark, _EVENTS), days=45, window=6)
)

# ---- order, top-k, pivot, report

query("o1_sorted", q(f"SELECT date, cut, {r('beta_cap')} AS beta FROM beta ORDER BY date, cut"))(
    lambda x: x.beta.select("date", "cut", F.col("beta_cap").alias("beta")).orderBy("date", "cut")
)
query("o2_pivot", q("SELECT date, " + ", ".join(f"round(max(CASE WHEN cut = '{c}' THEN beta_cap END), 6) + 0.0 AS \"{c}\"" for c in cu.CUTS) + " FROM beta GROUP BY date"))(
    lambda x: rb.slope_table(cs.long_form(x.beta), key="cut")
)
query("o3_last_dates", q("SELECT DISTINCT date FROM rets ORDER BY date DESC LIMIT 12"))(lambda x: rb.last_dates(x.returns, 12).select("date").distinct())
query("o4_extremes", q(f"SELECT cut, {r('min(beta_cap)')} AS lo, {r('max(beta_cap)')} AS hi FROM beta GROUP BY cut"))(lambda x: x.beta.groupBy("cut").agg(F.min("beta_cap").alias("lo"), F.max("beta_cap").alias("hi")))
query("r5_regime_bands", q(f'SELECT cut, confirmed, min(date) AS start, max(date) AS "end", count(*) AS rows FROM (SELECT *, sum(new2) OVER (PARTITION BY cut ORDER BY date ROWS UNBOUNDED PRECEDING) AS run2 FROM (SELECT *, CASE WHEN confirmed IS NOT DISTINCT FROM lag(confirmed) OVER (PARTITION BY cut ORDER BY date) THEN 0 ELSE 1 END AS new2 FROM (SELECT date, cut, {_HELD} AS confirmed FROM isl) h) k) z GROUP BY cut, run2, confirmed'))(
    lambda x: rb.confirmed_runs(x.regimes, 3, "cut").drop("run")
)
query("x_hourly_events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(
    lambda x: x.table("events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
)


@query(
    "flagship_slopes",
    q(f"SELECT date, cut, {r('beta_cap')} AS beta_cap, {r('r2_cap')} AS r2_cap, n, tercile, direction FROM beta JOIN (SELECT date, cut, tercile, direction FROM reg) g USING (date, cut)"),
)
def flagship(x: Inputs) -> DataFrame:
    """Prices to regimes in one plan."""
    t = x.beta.join(x.regimes.select("date", "cut", "tercile", "direction"), ["date", "cut"])
    return t.select("date", "cut", "beta_cap", "r2_cap", "n", "tercile", "direction")
