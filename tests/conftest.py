import datetime as dt
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def panel(n_dates=60, gap=0.05, seed=1):
    """Distinct price paths for 12 countries and two classes, some cells missing: rows and the universe."""
    rng = np.random.default_rng(seed)
    names = ["Brazil", "Mexico", "Chile", *[f"C{i}" for i in range(9)]]
    days = [d for d in (dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(2 * n_dates)) if d.weekday() < 5][:n_dates]
    rows = []
    for k in ("Eq", "FI"):
        for j, c in enumerate(names):
            path = 100 * np.exp(np.cumsum(rng.normal(0, 0.005 * (1 + j % 5), n_dates)))
            rows += [(d, c, k, float(p)) for d, p in zip(days, path, strict=True) if rng.random() > gap or d in days[:2]]
    universe = [(c, "DM" if c.startswith("C") else "EM", 10.0 + j, 5.0 + j, False) for j, c in enumerate(names)]
    return rows, universe


def workbook(path, sheets):
    """A minimal workbook with inline strings."""

    def cell(v):
        if v is None:
            return "<c/>"
        if isinstance(v, dt.date):
            v = float((v - dt.date(1899, 12, 30)).days)
        return f"<c><v>{v}</v></c>" if isinstance(v, int | float) else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</R>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
