"""One self-contained page with three figures."""

from __future__ import annotations

import json
from html import escape
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources.runs import write_text
from .bundle import load_bundle
from .figures import all_figures

# The places of the figures and their headings.
DIVS = {"fig_scatter_vol": "Risk vs Return", "fig_scatter_beta": "Beta vs Return", "fig_beta_ts": "Segment β with regime bands"}
SCRIPT = "https://cdn.plot.ly/plotly-2.35.2.min.js"


def assemble(figures: list[dict], run_date: str, version: str) -> str:
    if len(figures) != len(DIVS):
        raise ValueError(f"{len(DIVS)} figures are needed, not {len(figures)}")
    parts = []
    for fig, (div, title) in zip(figures, DIVS.items(), strict=True):
        body = json.dumps(fig, ensure_ascii=False, sort_keys=True).replace("</", "<\\/")
        draw = f'(f => Plotly.newPlot("{div}", f.data, f.layout, {{displaylogo: false}}).then(g => f.frames && Plotly.addFrames(g, f.frames)))({body})'
        parts.append(f'<section><h2>{title}</h2><div id="{div}"></div><script>{draw}</script></section>')
    head = f"Run date {escape(run_date)}, methodology v{escape(version)}"
    style = "body{font-family:system-ui,sans-serif;max-width:1280px;margin:auto;background:#fafafa}section{background:#fff;border:1px solid #e6e6e6;padding:16px;margin:24px 0}"
    return (
        f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>Market regimes, {escape(run_date)}</title><style>{style}</style>'
        f'<script src="{SCRIPT}"></script></head><body><header><h1>Market regimes</h1><p>{head}</p></header>{"".join(parts)}</body></html>\n'
    )


def build_report(spark: SparkSession, run_dir: str | Path, data_path: str | Path, out: str | Path, window: int = 252) -> str | Path:
    """Writes the page to a path or a URI, in place of an older one, and returns it."""
    bundle = load_bundle(spark, run_dir, data_path, window)
    write_text(out, assemble(all_figures(bundle), bundle.run_date, bundle.methodology_version))
    return out
