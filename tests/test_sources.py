"""Sources over HTTP and of workbooks, and digests, against plain versions over the given tables."""

import datetime as dt
import hashlib
import json
import random
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from crosscut.catalog.base import Inputs
from crosscut.sources import fingerprints, live, panel, workbook

from .conftest import workbook as write_workbook

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def macro(spark):
    return Inputs(spark, SF).macro.cache()


@pytest.fixture
def server(macro):
    """Serves the macro series of the given tables; `asked` has the queries, `broken` how many answers fail first."""
    series = {}
    for r in macro.collect():
        series.setdefault(r.macro_id, {})[r.date] = r.value

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            query = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            self.server.asked.append(query)
            if self.server.broken > 0:
                self.server.broken -= 1
                return self.answer(503, {})
            if query["series_id"] not in series:
                return self.answer(400, {"error_message": "The series does not exist."})
            lo, hi = query.get("observation_start", "0000"), query.get("observation_end", "9999")
            rows = [{"date": str(d), "value": "." if v is None else repr(v)} for d, v in sorted(series[query["series_id"]].items()) if lo <= str(d) <= hi]
            return self.answer(200, {"observations": rows})

        def answer(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.asked, s.broken = [], 0
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def client(spark, server, **more):
    return live.LiveClient(spark, "key", f"http://127.0.0.1:{server.server_port}/observations", pause=0.01, **more)


def as_set(df):
    return set(map(tuple, df.select("date", "macro_id", "value").collect()))


def test_live_series_in_one_scan(spark, server, macro):
    lo, hi = dt.date(1996, 1, 1), dt.date(1999, 12, 31)
    got = panel.load_macro(client(spark, server), lo, hi, (*panel.MACRO_IDS, "NONE"))
    assert as_set(got) == as_set(macro.filter(F.col("date").between(lo, hi))) and got.count() > 100
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RelationV2") == 1
    assert {q["series_id"] for q in server.asked} == {*panel.MACRO_IDS, "NONE"}
    assert {(q["observation_start"], q["observation_end"], q["api_key"]) for q in server.asked} == {("1996-01-01", "1999-12-31", "key")}


def test_filters_reach_the_server(spark, server, macro):
    table = client(spark, server).table(panel.MACRO_IDS)
    rows = table.filter((F.col("macro_id") == "VIXCLS") & (F.col("date") > dt.date(1997, 1, 1)) & (F.col("date") < dt.date(1997, 6, 1)) & (F.col("value") > 0))
    assert as_set(rows) == as_set(macro.filter("macro_id = 'VIXCLS' and date > '1997-01-01' and date < '1997-06-01' and value > 0"))
    assert {(q["series_id"], q["observation_start"], q["observation_end"]) for q in server.asked} == {("VIXCLS", "1997-01-02", "1997-05-31")}
    assert table.filter((F.col("date") > dt.date(2000, 1, 1)) & (F.col("date") < dt.date(1999, 1, 1))).count() == 0
    with pytest.raises(Exception, match="name the series"):
        client(spark, server).table().count()


def test_answers_are_tried_again(spark, server, macro):
    server.broken = 2
    got = client(spark, server).fetch("VIXCLS", "1996-01-01", "1996-12-31").collect()
    assert len(got) == 12 and len(server.asked) == 3
    server.broken = 99
    with pytest.raises(Exception, match="no answer after 2 tries") as e:
        client(spark, server, tries=2).fetch("VIXCLS", "1996-01-01", "1996-12-31").collect()
    assert "api_key=key" not in str(e.value)


def test_price_sheet_of_the_given_tables(spark, tmp_path):
    """A workbook written from the panel gives the panel back, at any size of the partitions."""
    x = Inputs(spark, SF)
    rows = x.raw_prices.collect()
    sheets = {}
    for kind, sheet in panel.SHEETS.items():
        cells = {(r.date, r.country): r.price for r in rows if r.asset_class == kind}
        names, days = sorted({c for _, c in cells}), sorted({d for d, _ in cells})
        sheets[sheet] = [["t"] * (len(names) + 1), ["", *names], *[[d, *[cells.get((d, c)) for c in names]] for d in days]]
    path = tmp_path / "book.xlsx"
    write_workbook(path, sheets)
    want = {(r.date, r.country, r.asset_class): r.price for r in rows}
    got = panel.load_prices(spark, path)
    assert {(r.date, r.country, r.asset_class): r.price for r in got.filter("price is not null").collect()} == {(r.date, r.country, r.asset_class): r.price for r in x.prices.collect()}
    for each in (1, 7, 50):
        t = panel.price_sheet(spark, path, "Equity_LC", "Eq", each)
        assert {(r.date, r.country): r.price for r in t.filter("price is not null").collect()} == {k[:2]: v for k, v in want.items() if k[2] == "Eq"}
        assert t.rdd.getNumPartitions() == -(-(len(sheets["Equity_LC"]) - 2) // each)
    some = panel.price_sheet(spark, path, "Equity_LC", "Eq").filter(F.col("country").isin("NATION_11", "NATION_14")).select("country").distinct()
    assert {r[0] for r in some.collect()} == {"NATION_11", "NATION_14"}
    options = {"path": str(path), "sheet": "Equity_LC", "asset_class": "Eq"}
    assert spark.read.format(workbook.FORMAT).options(**options).schema("price double, date date").load().columns == ["price", "date"]


@pytest.mark.parametrize("piece", [70, 97, 1000, 1 << 18])
def test_sheets_in_pieces(tmp_path, monkeypatch, piece):
    """Shared texts, prefixes of names, cells without places, empty rows and cells; tags cut off by the end of a piece."""
    monkeypatch.setattr(workbook, "PIECE", piece)
    n, ns = 40, "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rng = random.Random(3)
    want = [{0: "t"}, {1: "ÄB & C", 3: "rowing"}]
    body = '<x:row><x:c t="s"><x:v>0</x:v></x:c></x:row><x:row r="2"><x:c r="B2" t="s"><x:v>1</x:v></x:c><x:c r="D2" t="inlineStr"><x:is><x:t>rowing</x:t></x:is></x:c></x:row>'
    for i in range(n):
        want.append({} if i % 7 == 3 else {0: float(i), 3: rng.random()} if i % 2 else {0: "2020-01-02", 1: 1.5})
        cells = "".join(f'<x:c r="{"ABCD"[j]}{i + 3}"{"" if isinstance(v, float) else " t=" + chr(34) + "str" + chr(34)}><x:v>{v}</x:v></x:c>' for j, v in want[-1].items())
        body += f'<x:row r="{i + 3}">{cells}<x:c r="E1"/></x:row>' if cells else f'<x:row r="{i + 3}"/>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="P" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="/xl/worksheets/s1.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>t</t></si><si><r><t>ÄB </t></r><r><t>{escape("& C")}</t></r></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<?xml version="1.0"?><x:worksheet xmlns:x="{ns}"><x:dimension ref="A1"/><x:sheetFormatPr defaultRowHeight="15"/><x:sheetData>{body}</x:sheetData></x:worksheet>')
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        sheet = workbook.Sheet(z, "P")
        assert sheet.count() == n + 2 and list(sheet.rows(0, 1000)) == want
        for low in (0, 1, 2, 17, n + 1, n + 2, n + 9):
            for high in (low, low + 1, low + 5):
                assert list(sheet.rows(low, high)) == want[low:high], (low, high)
        with pytest.raises(ValueError, match="no sheet"):
            workbook.Sheet(z, "Q")


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_series_tree(spark, macro):
    nodes = {(r.macro_id, r.label): r.digest for r in fingerprints.series_nodes(macro.repartition(7)).collect()}
    again = {(r.macro_id, r.label): r.digest for r in fingerprints.series_nodes(macro.orderBy(F.desc("date")).coalesce(1)).collect()}
    assert nodes == again
    more = macro.unionByName(spark.createDataFrame([(dt.date(2002, 5, 6), "VIXCLS", 1.0)], macro.schema))
    new = {(r.macro_id, r.label): r.digest for r in fingerprints.series_nodes(more).collect()}
    assert {k for k, v in new.items() if nodes.get(k) != v} == {("VIXCLS", x) for x in ("2002-05-06", "2002-05", "2002", "200", "")}
    odd = spark.createDataFrame([(None, "a", 1.0), (None, "a", 1.0), (dt.date(2020, 1, 2), "a", None), (dt.date(2020, 1, 2), "a", 2.0)], macro.schema)
    got = {r.label: r.digest for r in fingerprints.series_nodes(odd).collect()}
    day = h("-:1,2.0:1")
    root = h(f"-:{h('-:' + h('-:' + h('-:' + h('1.0:2'))))},202:" + h("2020:" + h("2020-01:" + h("2020-01-02:" + day))))
    assert got["2020-01-02"] == day and got[""] == root and fingerprints.series_digest(odd).collect()[0].hash == root
    assert fingerprints.series_nodes(odd.limit(0)).count() == 0


def plain_fingerprint(root, size):
    """The tree's digest by reading all files here."""
    buckets = {}
    for p in sorted(x for x in ([root] if root.is_file() else root.rglob("*")) if x.is_file() and not any(y[0] in "._" for y in x.relative_to(root).parts)):
        name, data = "" if p == root else str(p.relative_to(root)), p.read_bytes()
        ranges = [data[i : i + size] for i in range(0, len(data), size)] or [b""]
        digest = h("".join(hashlib.sha256(r).hexdigest() for r in ranges))
        buckets.setdefault(h(name)[:3], []).append(f"{name}:{len(data)}:{digest}")
    return h(",".join(f"{b}:{h(','.join(sorted(v)))}" for b, v in sorted(buckets.items())))


@pytest.mark.parametrize("size", [1000, fingerprints.RANGE])
def test_fingerprint_of_a_folder(spark, tmp_path, size):
    spark.read.parquet(f"{SF}/orders.parquet").repartition(3).write.partitionBy("o_orderstatus").parquet(str(tmp_path / "t"))
    found = fingerprints.input_fingerprint(spark, str(tmp_path / "t"), size)
    assert found["sha256"] == plain_fingerprint(tmp_path / "t", size) and found["files"] >= 3
    file = next((tmp_path / "t").rglob("*.parquet"))
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(data)
    (file.parent / f".{file.name}.crc").unlink()  # else the local file system finds the damage itself
    changed = fingerprints.input_fingerprint(spark, str(tmp_path / "t"), size)
    assert changed["sha256"] == plain_fingerprint(tmp_path / "t", size) != found["sha256"] and changed["bytes"] == found["bytes"]
    one = fingerprints.input_fingerprint(spark, str(file), size)
    assert one["sha256"] == plain_fingerprint(file, size) and one["files"] == 1
    assert "sha256" in panel.fingerprint(spark, tmp_path / "t") and "mtime" in panel.fingerprint(spark, file)
