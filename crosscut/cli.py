"""Command line: run, backtest, report."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import schemas
from .config import load_config
from .plans.backtest import run_backtest
from .plans.engine import run
from .report.html import build_report
from .sources.files import Files, joined
from .sources.live import LiveClient
from .sources.panel import TableClient, read_table
from .sources.runs import read_snapshot


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="crosscut", description="Market regimes from panels of prices.")
    sub = top.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help="run the engine and write a run folder")
    b = sub.add_parser("backtest", help="run and score the acceptance gates")
    for p in (r, b):
        p.add_argument("--config", required=True, type=Path)
        p.add_argument("--macro", help="table with date, macro_id, value; without it the series come from the service, with the configuration's key")
    r.add_argument("--date", required=True)
    r.add_argument("--as-of-data-date", required=True)
    r.add_argument("--ewma-halflife", type=int)
    r.add_argument("--out")
    r.add_argument("--force", action="store_true")
    b.add_argument("--start", required=True)
    b.add_argument("--end", required=True)
    b.add_argument("--assert-gates", action="store_true")
    p = sub.add_parser("report", help="build the page of a run")
    p.add_argument("--run-dir", required=True)
    p.add_argument("--data", help="default: the snapshot's data_path")
    p.add_argument("--out", help="default: report.html in the run folder")
    p.add_argument("--window", type=int, default=252)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("crosscut").getOrCreate()
    if args.command == "report":
        data = args.data or read_snapshot(args.run_dir).get("config_resolved", {}).get("data_path")
        if not data or not Files(spark, data).exists():
            print("the source data can't be found; give --data", file=sys.stderr)
            return 2
        print(build_report(spark, args.run_dir, data, args.out or joined(args.run_dir, "report.html"), args.window))
        return 0
    given = {"ewma_halflife_days": getattr(args, "ewma_halflife", None), "output_dir": getattr(args, "out", None)}
    cfg = load_config(args.config, {k: v for k, v in given.items() if v is not None})
    if not args.macro and not cfg.fred_api_key:
        print("give --macro, or fred_api_key in the configuration", file=sys.stderr)
        return 2
    client = TableClient(read_table(spark, args.macro, schemas.MACRO)) if args.macro else LiveClient(spark, cfg.fred_api_key)
    if args.command == "run":
        print(run(spark, cfg, client, args.date, args.as_of_data_date, args.force)[1])
        return 0
    report = run_backtest(spark, cfg, client, args.start, args.end)
    print("all gates passed" if report["all_passed"] else "some gates failed")
    return int(args.assert_gates and not report["all_passed"])


if __name__ == "__main__":
    sys.exit(main())
