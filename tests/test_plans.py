"""Whole runs on a small panel: files, determinism, backtest, report, command line, readers, streaming."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest

from crosscut import cli, config, schemas
from crosscut.plans import engine
from crosscut.sources import panel as src
from crosscut.sources import runs

from .conftest import panel, workbook

HEAD = ["Country", "Segment", "Equity_Mkt_Cap_Val", "Fixed_Income_Mkt_Cap_Val", "Other"]


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    rows, universe = panel()
    path = tmp_path_factory.mktemp("book") / "data.xlsx"
    names = [u[0] for u in universe]
    sheets = {"Panel": [HEAD, *[[c, s, e, f, "x"] for c, s, e, f, _ in universe], ["World", "DM", 1.0, 1.0, "x"]]}
    for kind, sheet in src.SHEETS.items():
        at = {(d, c): p for d, c, k, p in rows if k == kind}
        days = sorted({d for d, _ in at})
        sheets[sheet] = [["t"] * (len(names) + 1), ["", *names], *[[d, *[at.get((d, c)) for c in names]] for d in days]]
    workbook(path, sheets)
    return path


def settings(book, out):
    return config.EngineConfig(book, out, 10, 5, 3, 4, 1, min_n_per_cut=3, bootstrap_min_days=10, external_corr_window_days=8)


def macro(spark):
    rng = np.random.default_rng(9)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(80)]
    return spark.createDataFrame([(d, i, float(rng.normal())) for d in days for i in src.MACRO_IDS[:4]], schemas.MACRO)


def test_reads_the_workbook(spark, book):
    u = src.load_universe(spark, book)
    assert u.count() == 13 and u.filter("is_composite").first().country == "World"
    p = src.load_prices(spark, book)
    assert p.select("country").distinct().count() == 12 and p.columns == ["country", "date", "asset_class", "price"]
    with pytest.raises(ValueError, match="Segment"):
        src.universe_frame(spark.createDataFrame([("a",)], "Country string"))


def test_run_backtest_and_report(spark, book, tmp_path):
    cfg = settings(book, tmp_path)
    client = src.TableClient(macro(spark))
    result, folder = engine.run(spark, cfg, client, "2020-04-01", "2020-03-31")
    assert {p.name for p in folder.iterdir() if p.name[0] != "."} == {f"{n}.csv" for n in runs.ARTIFACTS} | {"snapshot.json", "versions"}
    assert set(json.loads((folder / "snapshot.json").read_text())) == {"run_date", "as_of_data_date", "methodology_version", "config_resolved", "data_fingerprint", "code_version", "warnings"}
    with pytest.raises(FileExistsError):
        runs.write_run({}, {}, tmp_path, "2020-04-01")
    back = runs.read_run(spark, folder)
    assert back["beta_series"].count() == 2 * 10 * 60 and back["beta_series"].filter("beta is not null").count() > 500
    assert back["regimes"].filter("tercile <> 'Unknown'").count() > 100
    spark.catalog.clearCache()
    _, again = engine.run(spark, cfg, client, "again", "2020-03-31")
    for name in runs.ARTIFACTS:
        assert (again / f"{name}.csv").read_bytes() == (folder / f"{name}.csv").read_bytes(), name

    (tmp_path / "c.yaml").write_text(json.dumps(config.to_dict(cfg)))
    macro(spark).write.parquet(str(tmp_path / "macro.parquet"))
    args = ["backtest", "--config", str(tmp_path / "c.yaml"), "--macro", str(tmp_path / "macro.parquet"), "--start", "2020-01-01", "--end", "2020-03-31"]
    assert cli.main([*args, "--assert-gates"], spark) == 1
    report = json.loads((tmp_path / "acceptance_report.json").read_text())
    assert len(report["gates"]) == 6 and not report["all_passed"]
    assert (tmp_path / "stability_metrics.csv").read_text().startswith("quarter,segment,transitions")

    assert cli.main(["report", "--run-dir", str(folder), "--window", "5"], spark) == 0
    page = (folder / "report.html").read_text()
    assert page.startswith("<!DOCTYPE html>") and page.count("Plotly.newPlot") == 3 and 50_000 < len(page) < 5_000_000
    with pytest.raises(runs.RunInputError):
        runs.read_snapshot(tmp_path / "nothing")


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("data_path: a\noutput_dir: b\nbucket_scheme: QUINTILE\nmin_n_per_cut: 4\n")
    cfg = config.load_config(tmp_path / "c.yaml", {"min_n_per_cut": 7})
    assert cfg.min_n_per_cut == 7 and cfg.bucket_scheme is config.BucketScheme.QUINTILE and config.to_dict(cfg)["bucket_scheme"] == "QUINTILE"
    with pytest.raises(ValueError, match="bogus"):
        config.load_config(tmp_path / "c.yaml", {"bogus": 1})


def test_client_tries_again():
    class Broken:
        calls = 0

        def fetch(self, *a):
            self.calls += 1
            raise OSError("down")

    waits, inner = [], Broken()
    with pytest.raises(OSError):
        src.RetryingClient(inner, sleep=waits.append).fetch("x", None, None)
    assert inner.calls == 3 and waits == [2.0, 2.0]


def test_streaming_volatility_follows_the_batch_form(spark, tmp_path):
    from crosscut.streaming.incremental import streaming_vol

    rng = np.random.default_rng(3)
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 30)))
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(30)]
    schema = "series_id string, date date, price double"
    for k in range(3):
        rows = [("a", d, float(p)) for d, p in zip(days[10 * k : 10 * k + 10], price[10 * k : 10 * k + 10], strict=True)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_vol(stream, 10).writeStream.format("memory").queryName("vols").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("vols").orderBy("date").toPandas()
    want = pd.Series(np.log(price[1:] / price[:-1])).ewm(halflife=10, adjust=False).std() * math.sqrt(252)
    np.testing.assert_allclose(got["vol"].to_numpy(float)[2:], want.to_numpy()[1:], rtol=1e-8)


def test_entry_point(spark):
    import __spark_entry__ as e

    found, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 90
