"""The same inputs and stages as SQL, one chain of common table expressions that each oracle query ends."""

from __future__ import annotations


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def _ewma(name: str, source: str, halflife: float, out: str) -> str:
    """CTEs name_1 to name: the gap-aware, demeaned and bias-corrected EWMA volatility of r1."""
    a = f"(1.0::DOUBLE - exp(-ln(2.0::DOUBLE) / {halflife}::DOUBLE))"
    run = "OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"""
{name}_1 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM {source}),
{name}_2 AS (SELECT *, max(CASE WHEN r1 IS NOT NULL THEN i END) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
   first_value(r1 IGNORE NULLS) {run} AS c FROM {name}_1),
{name}_3 AS (SELECT *, CASE WHEN r1 IS NULL THEN NULL WHEN p IS NULL THEN 1.0::DOUBLE ELSE {a} / (pow(1.0::DOUBLE - {a}, i - p) + {a}) END AS al FROM {name}_2),
{name}_4 AS (SELECT *, coalesce(sum(CASE WHEN al < 1 THEN ln(1 - al) END) {run}, 0) AS l FROM {name}_3),
{name}_5 AS (SELECT *, al * exp(-l) AS wt, r1 - c AS z FROM {name}_4),
{name}_6 AS (SELECT *, sum(wt) {run} AS s, sum(wt * wt) {run} AS s2, sum(wt * z) {run} AS m, sum(wt * z * z) {run} AS q FROM {name}_5),
{name} AS (SELECT * EXCLUDE (i, p, c, al, l, wt, z, s, s2, m, q),
   CASE WHEN s * s > s2 THEN sqrt(greatest(0, q / s - (m / s) * (m / s)) * s * s / (s * s - s2)) * sqrt(252.0::DOUBLE) END AS {out} FROM {name}_6)"""


def _fit(name: str, returns: str, min_n: int) -> str:
    """CTEs to name: both slopes per date and cut on the equity calendar."""
    return f"""
{name}_1 AS (SELECT t.date, m.cut, t.vol AS x, t.ret AS y, s.mcap AS w FROM {returns} t JOIN mem m USING (series_id) JOIN series s USING (series_id) WHERE t.vol IS NOT NULL AND t.ret IS NOT NULL),
{name}_2 AS (SELECT date, cut, count(*) AS n, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, avg(x) AS ex, avg(y) AS ey FROM {name}_1 GROUP BY ALL),
{name}_3 AS (SELECT date, cut, any_value(n) AS n, any_value(cx) AS cx, any_value(ex) AS ex,
   sum(w * (x - cx) * (x - cx)) / sum(w) AS cxx, sum(w * (x - cx) * (y - cy)) / sum(w) AS cxy, sum(w * (y - cy) * (y - cy)) / sum(w) AS cyy,
   avg((x - ex) * (x - ex)) AS exx, avg((x - ex) * (y - ey)) AS exy, avg((y - ey) * (y - ey)) AS eyy FROM {name}_1 JOIN {name}_2 USING (date, cut) GROUP BY ALL),
{name}_4 AS (SELECT *, n < {min_n} AS few, cxx <= 1e-12::DOUBLE * cx * cx AS sc, exx <= 1e-12::DOUBLE * ex * ex AS se FROM {name}_3),
{name} AS (SELECT d.date, c.cut, c.cut_ord,
   CASE WHEN NOT few AND NOT sc THEN cxy / cxx END AS beta_cap, CASE WHEN NOT few AND NOT sc AND cyy > 0 THEN cxy * cxy / (cxx * cyy) END AS r2_cap,
   CASE WHEN NOT few AND NOT se THEN exy / exx END AS beta_eq, CASE WHEN NOT few AND NOT se AND eyy > 0 THEN exy * exy / (exx * eyy) END AS r2_eq,
   coalesce(n, 0)::BIGINT AS n, coalesce(few, true) AS suppressed, coalesce(NOT few AND (sc OR se), false) AS singular
   FROM (SELECT DISTINCT date FROM {returns} WHERE asset_class = 'Eq') d CROSS JOIN cuts c LEFT JOIN {name}_4 USING (date, cut))"""


TERCILE = "CASE WHEN {0} IS NULL THEN 'Unknown' WHEN {0} <= 1.0::DOUBLE / 3.0::DOUBLE THEN 'Risk-off' WHEN {0} >= 2.0::DOUBLE / 3.0::DOUBLE THEN 'Risk-on' ELSE 'Transitional' END"
ASYM = "CASE WHEN {0} IS NULL THEN 'Unknown' WHEN {0} <= 0.2::DOUBLE THEN 'Risk-off' WHEN {0} >= 0.8::DOUBLE THEN 'Risk-on' ELSE 'Transitional' END"
QUINTILE = "CASE WHEN {0} IS NULL THEN 'Unknown' WHEN {0} <= 0.2::DOUBLE THEN 'Q1' WHEN {0} <= 0.4::DOUBLE THEN 'Q2' WHEN {0} <= 0.6::DOUBLE THEN 'Q3' WHEN {0} <= 0.8::DOUBLE THEN 'Q4' ELSE 'Q5' END"
ORDINAL = "CASE {0} WHEN 'Risk-off' THEN 1.0::DOUBLE WHEN 'Transitional' THEN 2.0::DOUBLE WHEN 'Unknown' THEN 2.0::DOUBLE WHEN 'Risk-on' THEN 3.0::DOUBLE END"
MEAN = "sum(round({0} * 100)::BIGINT)::DOUBLE / (100.0::DOUBLE * count(*))"

CHAIN = f"""WITH
nat AS (SELECT n_nationkey, n_name AS country, CASE WHEN r_name IN ('EUROPE', 'ASIA') THEN 'DM' ELSE 'EM' END AS segment, r_name = 'AMERICA' AS regional FROM nation JOIN region ON n_regionkey = r_regionkey),
eqf AS (SELECT country, segment, date_trunc('month', o_orderdate)::DATE AS date, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nat ON c_nationkey = n_nationkey),
fif AS (SELECT country, segment, date_trunc('month', l_shipdate)::DATE AS date, l_extendedprice AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nat ON s_nationkey = n_nationkey),
raw_prices AS (SELECT date, country, 'Eq' AS asset_class, {MEAN.format('v')} AS price FROM eqf GROUP BY ALL UNION ALL SELECT date, country, 'FI', {MEAN.format('v')} FROM fif GROUP BY ALL),
prices AS (SELECT * FROM raw_prices WHERE country IN (SELECT country FROM raw_prices WHERE asset_class = 'Eq' INTERSECT SELECT country FROM raw_prices WHERE asset_class = 'FI')),
universe AS (SELECT nat.country, nat.segment, nat.regional, e.m AS eq_mcap, f.m AS fi_mcap FROM nat
   LEFT JOIN (SELECT country, sum(round(v * 100)::BIGINT)::DOUBLE / 100.0::DOUBLE AS m FROM eqf GROUP BY ALL) e USING (country)
   LEFT JOIN (SELECT country, sum(round(v * 100)::BIGINT)::DOUBLE / 100.0::DOUBLE AS m FROM fif GROUP BY ALL) f USING (country)),
series AS (SELECT country || '_Eq' AS series_id, country, segment, 'Eq' AS asset_class, eq_mcap AS mcap, regional FROM universe UNION ALL SELECT country || '_FI', country, segment, 'FI', fi_mcap, regional FROM universe),
mem AS (SELECT 'global' AS cut, series_id FROM series UNION ALL SELECT segment, series_id FROM series
   UNION ALL SELECT CASE asset_class WHEN 'Eq' THEN 'Equity' ELSE 'FI' END, series_id FROM series
   UNION ALL SELECT segment || '_' || asset_class, series_id FROM series UNION ALL SELECT 'LatAm', series_id FROM series WHERE regional),
cuts AS (SELECT unnest(['global', 'DM', 'EM', 'Equity', 'FI', 'DM_Eq', 'EM_Eq', 'DM_FI', 'EM_FI', 'LatAm']) AS cut, unnest(range(10)) AS cut_ord),
named AS (SELECT *, country || '_' || asset_class AS series_id FROM prices),
dense AS (SELECT s.asset_class, s.series_id, d.date, p.price FROM (SELECT DISTINCT asset_class, series_id FROM named) s JOIN (SELECT DISTINCT asset_class, date FROM named) d USING (asset_class)
   LEFT JOIN named p ON p.series_id = s.series_id AND p.date = d.date),
ret0 AS (SELECT *, CASE WHEN price / lag(price, 1) OVER w > 0 THEN ln(price / lag(price, 1) OVER w) END AS r1, CASE WHEN price / lag(price, 3) OVER w > 0 THEN ln(price / lag(price, 3) OVER w) END AS ret
   FROM dense WINDOW w AS (PARTITION BY series_id ORDER BY date)),
{_ewma('rets', 'ret0', 6, 'vol')},
{_fit('beta', 'rets', 10)},
fast0 AS (SELECT * REPLACE (r1 AS ret) FROM ret0),
{_ewma('fast', 'fast0', 3, 'vol')},
{_fit('trip', 'fast', 10)},
rounded AS (SELECT * REPLACE (round(beta_cap, 9) AS beta_cap), row_number() OVER (PARTITION BY cut ORDER BY date) AS i FROM beta),
pct AS (SELECT a.date, a.cut, a.beta_cap, a.n, count(b.i) AS rows_in, count(b.beta_cap) AS valid_in, count(CASE WHEN b.beta_cap <= a.beta_cap THEN 1 END) AS below,
   count(a.beta_cap) FILTER (WHERE false) AS unused FROM rounded a JOIN rounded b ON a.cut = b.cut AND b.i BETWEEN a.i - 23 AND a.i GROUP BY a.date, a.cut, a.beta_cap, a.n),
pct2 AS (SELECT *, CASE WHEN valid_in > 0 THEN (below - 1)::DOUBLE / greatest(rows_in - 1, 1) END AS p, count(beta_cap) OVER (PARTITION BY cut ORDER BY date ROWS UNBOUNDED PRECEDING) AS valid_all FROM pct),
dir AS (SELECT date, cut, beta_cap, CASE WHEN count(beta_cap) OVER w = 5 THEN CASE WHEN stddev_pop(beta_cap) OVER w = 0 OR abs(regr_slope(beta_cap, i) OVER w) < 0.1::DOUBLE * stddev_pop(beta_cap) OVER w THEN 'stable'
   WHEN regr_slope(beta_cap, i) OVER w > 0 THEN 'rising' ELSE 'falling' END END AS direction FROM rounded WINDOW w AS (PARTITION BY cut ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
reg0 AS (SELECT date, cut, CASE WHEN valid_all >= 12 THEN p END AS percentile, n, valid_all < 24 AS bootstrap FROM pct2),
reg AS (SELECT reg0.*, {TERCILE.format('percentile')} AS tercile, {QUINTILE.format('percentile')} AS quintile, direction, cut = 'LatAm' AS thin_cut FROM reg0 JOIN dir USING (date, cut)),
alldates AS (SELECT DISTINCT date FROM rets),
bothr AS (SELECT s.series_id, d.date, t.r1 FROM (SELECT DISTINCT series_id FROM rets) s CROSS JOIN alldates d LEFT JOIN rets t ON t.series_id = s.series_id AND t.date = d.date),
pairs AS (SELECT DISTINCT m.cut, m.series_id AS a, o.series_id AS b FROM mem m JOIN mem o ON m.cut = o.cut AND m.series_id < o.series_id),
pr AS (SELECT x.date, x.series_id AS a, y.series_id AS b, CASE WHEN y.r1 IS NOT NULL THEN x.r1 END AS ra, CASE WHEN x.r1 IS NOT NULL THEN y.r1 END AS rb FROM bothr x JOIN bothr y ON x.date = y.date JOIN (SELECT DISTINCT a, b FROM pairs) p ON p.a = x.series_id AND p.b = y.series_id),
prr AS (SELECT date, a, b, CASE WHEN count(ra) OVER w = 12 AND stddev_samp(ra) OVER w * stddev_samp(rb) OVER w > 1e-300::DOUBLE THEN covar_samp(ra, rb) OVER w / (stddev_samp(ra) OVER w * stddev_samp(rb) OVER w) END AS rho
   FROM pr WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
pairwise AS (SELECT date, cut, avg(rho) AS avg_pairwise FROM prr JOIN pairs USING (a, b) WHERE rho IS NOT NULL GROUP BY ALL),
mac0 AS (SELECT date_trunc('month', l_shipdate)::DATE AS date, {MEAN.format('l_quantity')} AS q, {MEAN.format('l_discount')} AS d, {MEAN.format('l_tax')} AS t, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
macro AS (SELECT date, 'VIXCLS' AS macro_id, q AS value FROM mac0 UNION ALL SELECT date, 'BAMLC0A4CBBB', d FROM mac0 WHERE month(date) % 5 <> 0 UNION ALL SELECT date, 'BAMLEMCBPIOAS', t FROM mac0
   UNION ALL SELECT date, 'BAMLH0A0HYM2', n FROM mac0 UNION ALL SELECT date, 'T10Y2Y', 20.0::DOUBLE FROM mac0),
ext0 AS (SELECT date, cut, macro_id, percentile, value FROM (SELECT date, cut, percentile, macro_id FROM reg CROSS JOIN (SELECT DISTINCT macro_id FROM macro)) x FULL JOIN (SELECT date, macro_id, value, cut FROM macro CROSS JOIN (SELECT cut FROM cuts)) y USING (date, cut, macro_id)),
ext1 AS (SELECT *, last_value(percentile IGNORE NULLS) OVER w AS pf, last_value(value IGNORE NULLS) OVER w AS vf FROM ext0 WINDOW w AS (PARTITION BY cut, macro_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
ext2 AS (SELECT *, CASE WHEN vf IS NOT NULL THEN pf END AS px, CASE WHEN pf IS NOT NULL THEN vf END AS vx FROM ext1),
rho AS (SELECT date, cut, macro_id, CASE WHEN count(px) OVER w = 12 AND stddev_samp(px) OVER w * stddev_samp(vx) OVER w > 1e-300::DOUBLE THEN covar_samp(px, vx) OVER w / (stddev_samp(px) OVER w * stddev_samp(vx) OVER w) END AS rho
   FROM ext2 WINDOW w AS (PARTITION BY cut, macro_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
comp0 AS (SELECT date, CASE segment WHEN 'DM' THEN 'MXWO' ELSE 'MXEF' END AS ticker, {MEAN.format('v')} AS price FROM eqf GROUP BY ALL UNION ALL SELECT date, CASE segment WHEN 'DM' THEN 'I35402US' ELSE 'EMUSTRUU' END, {MEAN.format('v')} FROM fif GROUP BY ALL),
comp1 AS (SELECT date, ticker, CASE WHEN price / lag(price, 3) OVER w > 0 THEN ln(price / lag(price, 3) OVER w) END AS ret FROM comp0 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
legs AS (SELECT * FROM (VALUES ('DM', 'MXWO'), ('DM', 'I35402US'), ('EM', 'MXEF'), ('EM', 'EMUSTRUU'), ('DM_Eq', 'MXWO'), ('EM_Eq', 'MXEF'), ('DM_FI', 'I35402US'), ('EM_FI', 'EMUSTRUU')) v(cut, ticker)),
comp2 AS (SELECT date, cut, avg(ret) AS ret FROM comp1 JOIN legs USING (ticker) GROUP BY ALL),
comp3 AS (SELECT date, cut, ret, CASE WHEN ret IS NOT NULL THEN (rank() OVER (PARTITION BY cut ORDER BY ret NULLS LAST) + (count(ret) OVER (PARTITION BY cut, ret) - 1) / 2.0::DOUBLE) / count(ret) OVER (PARTITION BY cut) END AS p FROM comp2),
gaps AS (SELECT date, cut, abs({ORDINAL.format('e.tercile')} - {ORDINAL.format('c.ct')}) AS gap FROM reg e FULL JOIN (SELECT date, cut, {TERCILE.format('p')} AS ct FROM comp3) c USING (date, cut) WHERE cut IN (SELECT cut FROM legs)),
prev AS (SELECT date, cut AS segment, lag(tercile) OVER (PARTITION BY cut ORDER BY date) AS from_bucket, tercile AS to_bucket FROM reg),
trans AS (SELECT * FROM prev WHERE from_bucket IS NOT NULL AND from_bucket <> to_bucket),
daily AS (SELECT l_shipdate::DATE AS date, l_returnflag || l_linestatus AS series_id, {MEAN.format('l_extendedprice')} AS price FROM lineitem GROUP BY ALL),
isl0 AS (SELECT date, cut, tercile, CASE WHEN tercile IS NOT DISTINCT FROM lag(tercile) OVER (PARTITION BY cut ORDER BY date) THEN 0 ELSE 1 END AS new FROM reg),
isl1 AS (SELECT *, sum(new) OVER (PARTITION BY cut ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM isl0),
isl AS (SELECT *, row_number() OVER (PARTITION BY cut, run ORDER BY date) AS place FROM isl1)
"""


def _squared(n: int) -> str:
    """CTEs that square each window's matrix and scale it to trace 1."""
    m = f"SELECT a.e, a.cut, a.p, b.q, sum(a.v * b.v) AS v FROM pg{n - 1} a JOIN pg{n - 1} b ON a.e = b.e AND a.cut = b.cut AND a.q = b.p GROUP BY ALL"
    return f"pg{n} AS MATERIALIZED (SELECT e, cut, p, q, v / sum(CASE WHEN p = q THEN v END) OVER (PARTITION BY e, cut) AS v FROM ({m}) t)"


#: The first component's share: a power of the rows' products, by repeated squaring, times the products themselves.
PC1 = f""", di AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) AS i FROM alldates),
wm AS MATERIALIZED (SELECT m.cut, b.series_id, d.i, b.r1 FROM bothr b JOIN di d USING (date) JOIN mem m USING (series_id)),
we AS MATERIALIZED (SELECT d.i AS e, w.cut, w.series_id, w.i - d.i AS p, w.r1 FROM di d JOIN wm w ON w.i BETWEEN d.i - 11 AND d.i WHERE d.i >= 12),
wc AS MATERIALIZED (SELECT e, cut, series_id, count(r1) AS k, avg(r1) AS m FROM we GROUP BY ALL),
wok AS (SELECT e, cut FROM wc WHERE k > 0 GROUP BY ALL HAVING min(k) = 12 AND count(*) >= 2),
wz AS MATERIALIZED (SELECT e, cut, series_id, p, r1 - m AS z FROM we JOIN wc USING (e, cut, series_id) JOIN wok USING (e, cut) WHERE k = 12),
pgr AS (SELECT a.e, a.cut, a.p, b.p AS q, sum(a.z * b.z) AS v FROM wz a JOIN wz b USING (e, cut, series_id) GROUP BY ALL),
pg0 AS MATERIALIZED (SELECT e, cut, p, q, v / t AS v FROM (SELECT *, sum(CASE WHEN p = q THEN v END) OVER (PARTITION BY e, cut) AS t FROM pgr) t WHERE t > 0),
{", ".join(_squared(n) for n in range(1, 13))},
ps AS (SELECT a.e, a.cut, sum(a.v * b.v) AS pc1_share FROM pg12 a JOIN pg0 b ON a.e = b.e AND a.cut = b.cut AND a.q = b.p AND a.p = b.q GROUP BY ALL),
pc1 AS (SELECT date, c.cut, pc1_share FROM di CROSS JOIN cuts c LEFT JOIN ps ON ps.e = di.i AND ps.cut = c.cut) """


def q(select: str) -> str:
    return CHAIN + select
