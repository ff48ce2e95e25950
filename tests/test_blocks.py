"""Kernels over blocks of a history: the same results at any size of the blocks."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosscut.operators import blocks
from crosscut.operators import windows as wi
from crosscut.operators.classify import classify

from .conftest import panel
from .test_kernels import smooth

DAY = dt.date(2020, 1, 1)
SIZES = [1, 13]


def history(spark, seed=1):
    """Three keys of different lengths, one of them NULL, and one of a row; values with ties and gaps."""
    rng = random.Random(seed)
    rows = []
    for key, n in (("a", 130), ("b", 61), (None, 9), ("c", 1)):
        for i in range(n):
            rows.append((key, DAY + dt.timedelta(i), rng.choice([None, *(round(rng.uniform(0, 1), 1) for _ in range(6))]), rng.choice("xyzzz") if rng.random() < 0.9 else None, i))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, date date, v double, label string, n long").repartition(3).cache()


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def got(df, name):
    return {(r["k"], r["date"]): r[name] for r in df.collect()}


def test_places_within_keys(spark):
    rows, df = history(spark)
    t = blocks.numbered(df, ("k",), "date")
    assert got(t, "_i") == {(k, r[1]): i for k, own in by_key(rows).items() for i, r in enumerate(own)} and t.count() == len(rows)


@pytest.mark.parametrize("rows", [1, 2, 5, 40, 500])
def test_counts_of_windows(rows):
    rng = np.random.default_rng(rows)
    for n in (0, 1, 2, 3, 64, 257):
        x = rng.integers(0, 6, n).astype(float)
        x[rng.random(n) < 0.2] = np.nan
        want = [0 if np.isnan(v) else int((x[max(i - rows + 1, 0) : i + 1] <= v).sum()) for i, v in enumerate(x)]
        assert wi.counts_at_most(x, rows).tolist() == want


def slow_rank(values, rows, strict):
    out = []
    for i, v in enumerate(values):
        w = values[max(i - rows + 1, 0) : i + 1]
        if all(x is None for x in w) or (strict and v is None):
            out.append(None)
        else:
            out.append(((0 if v is None else sum(x is not None and x <= v for x in w)) - 1) / max(len(w) - 1, 1))
    return out


@pytest.mark.parametrize("size", SIZES)
def test_ranks(spark, size):
    rows, df = history(spark)
    for strict in (False, True):
        t = wi.rolling_percentile(df, "v", 20, "p", ("k",), strict=strict, size=size)
        assert t.columns == [*df.columns, "p"] and t.select("n").dtypes == [("n", "bigint")]
        assert got(t, "p") == {(k, r[1]): p for k, own in by_key(rows).items() for r, p in zip(own, slow_rank([r[2] for r in own], 20, strict), strict=True)}


@pytest.mark.parametrize("size", SIZES)
def test_runs_and_hysteresis(spark, size):
    rows, df = history(spark)
    labels = {k: [(r[1], r[3]) for r in own if r[3]] for k, own in by_key(rows).items()}
    want_runs, want_held = {}, {}
    for k, own in labels.items():
        run, place, before = 0, 0, None
        for (day, x), held in zip(own, smooth([x for _, x in own], 3) if own else [], strict=True):
            run, place = (run, place + 1) if x == before else (run + 1, 1)
            before = x
            want_runs[k, day], want_held[k, day] = (run, place), held
    t = wi.runs(df, "label", ("k",), size=size)
    assert t.columns == [*df.columns, "run", "place"]
    assert {x: (r, got(t, "place")[x]) for x, r in got(t, "run").items()} == want_runs
    held = wi.hysteresis(df, "label", 3, ("k",), size=size)
    assert held.columns == [*df.columns, "confirmed"] and got(held, "confirmed") == want_held


@pytest.mark.parametrize("size", SIZES)
def test_running_count(spark, size):
    rows, df = history(spark)
    want = {(k, r[1]): sum(x[2] is not None for x in own[: i + 1]) for k, own in by_key(rows).items() for i, r in enumerate(own)}
    assert got(blocks.running_count(df, "v", "c", ("k",), "date", size), "c") == want


@pytest.mark.parametrize("halflife", [0.1, 3.0])
def test_ewma_volatility_in_blocks(spark, halflife):
    """Blocks are 200 half-lives: 20 and 600 rows."""
    rows, df = history(spark)
    t = wi.ewma_vol(df, "v", halflife, "vol", ("k",), size=10)
    assert t.columns == [*df.columns, "vol"]
    found = got(t, "vol")
    for k, own in by_key(rows).items():
        x = pd.Series([np.nan if r[2] is None else r[2] for r in own], dtype=float)
        want = x.ewm(halflife=halflife, adjust=False).std().to_numpy() * np.sqrt(252)
        have = np.array([found[k, r[1]] for r in own], float)
        assert (np.isnan(have) == np.isnan(want)).all()
        np.testing.assert_allclose(have, want, rtol=1e-6, atol=1e-6)  # variances near 0 cancel


def test_regimes_in_blocks(spark):
    rows, df = history(spark)
    beta = df.filter("k is not null").select("date", F.col("k").alias("cut"), F.col("v").alias("beta_cap"), "n")
    args = {"window": 20, "lookback": 4, "min_valid": 6}
    whole = sorted(map(tuple, classify(beta, **args).collect()), key=repr)
    assert len({r[3] for r in whole}) > 3
    for size in (5, 40):
        assert sorted(map(tuple, classify(beta, **args, size=size).collect()), key=repr) == whole


def test_one_history_is_many_tasks(spark):
    """A long history of one cut is ranked in many groups, each with the window before it."""
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").alias("date"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("v"))
    t = wi.rolling_percentile(df, "v", 1260, "p", ("k",), size=1000)
    x = df.orderBy("date").toPandas()["v"].to_numpy()
    p = t.orderBy("date").toPandas()["p"].to_numpy()
    for i in range(0, 20_000, 777):
        w = x[max(i - 1259, 0) : i + 1]
        assert p[i] == ((w <= x[i]).sum() - 1) / max(len(w) - 1, 1)
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "collect_list" not in plan


def test_price_kernels_in_blocks(spark):
    from crosscut.plans.engine import kernels

    rows, _ = panel(n_dates=45)
    prices = spark.createDataFrame(rows[::2], "date date, country string, asset_class string, price double").cache()
    names = ["date", "series_id", "asset_class", "price", "r1", "ret", "vol"]
    whole = {tuple(r[:4]): r[4:] for r in map(tuple, kernels(prices, 5, 3.0).select(*names).collect())}
    parts = kernels(prices, 5, 3.0, size=8).select(*names).collect()
    assert len(parts) == len(whole)
    for r in map(tuple, parts):
        assert r[4:6] == whole[r[:4]][:2] and r[6] == (None if whole[r[:4]][2] is None else pytest.approx(whole[r[:4]][2], rel=1e-9))
