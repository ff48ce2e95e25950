"""The run sink and its readers: commits, crashes, damage, runs of other writers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crosscut.sources import runs
from crosscut.sources.files import Files

DAY = dt.date(2020, 1, 1)
CUT = ("global", "DM", "EM")
KINDS = {"date": "date", "string": "string", "double": "double", "long": "long", "boolean": "boolean"}


def frames(spark, n=40, shift=0.0):
    rows = [(DAY + dt.timedelta(i), c, s, i + shift + 0.1234567890123456, None if i % 7 == 0 else 0.5, i, False, True) for i in range(n) for c in CUT for s in ("cap_wtd", "eq_wtd")]
    random.Random(1).shuffle(rows)
    beta = spark.createDataFrame(rows, runs.ARTIFACTS["beta_series"][0]).repartition(5)
    out = {k: spark.createDataFrame([], schema) for k, (schema, _) in runs.ARTIFACTS.items()}
    return out | {"beta_series": beta, "tripwire": beta.filter("scheme = 'eq_wtd'")}


def content(spark, folder, name="beta_series"):
    return sorted(map(tuple, runs.read_artifact(spark, folder, name).collect()), key=repr)


def expected(fs, name="beta_series"):
    names = runs.columns_of(runs.ARTIFACTS[name][0])
    return sorted((tuple(round(x, runs.DIGITS) if isinstance(x, float) else x for x in (r[n] for n in names)) for r in fs[name].collect()), key=repr)


@pytest.mark.parametrize("one_part", [0, runs.ONE_PART])
def test_files_and_versions_hold_the_rows_in_order(spark, tmp_path, monkeypatch, one_part):
    monkeypatch.setattr(runs, "ONE_PART", one_part)
    fs = frames(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a small artifact has several parts
    try:
        folder = runs.write_run(fs, {"run_date": "d"}, tmp_path, "d")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name in ("beta_series", "tripwire", "alerts"):
        assert content(spark, folder, name) == expected(fs, name)
    version = runs.RunStore(spark, folder).current()
    assert (len(version["artifacts"]["beta_series"]["parts"]) > 1) == (one_part == 0) and version["artifacts"]["beta_series"]["rows"] == 240
    head, *lines = (folder / "beta_series.csv").read_text().splitlines()
    assert head == "date,segment,scheme,beta,r2,n,suppressed,singular" and len(lines) == 240
    place = [(x[2], CUT.index(x[1]), x[0]) for x in (line.split(",") for line in lines)]
    assert place == sorted(place)
    assert (folder / "alerts.csv").read_text().count("\n") == 1
    assert runs.read_snapshot(folder) == {"run_date": "d"} and not list(folder.glob("versions/*/*.staging"))


def test_a_failed_writer_leaves_the_last_run(spark, tmp_path):
    fs = frames(spark)
    folder = runs.write_run(fs, {"v": 1}, tmp_path, "d")
    with pytest.raises(FileExistsError):
        runs.write_run(fs, {"v": 2}, tmp_path, "d")
    before = {p: p.read_bytes() for p in folder.glob("*.csv")}
    broken = fs | {"external_validation": fs["beta_series"].select("date", "segment", F.lit("x").alias("fred_series"), F.raise_error(F.lit("killed")).cast("double").alias("rolling_corr_60d"))}
    with pytest.raises(Exception, match="killed"):
        runs.write_run(broken, {"v": 2}, tmp_path, "d", force=True)
    assert content(spark, folder) == expected(fs) and runs.read_snapshot(folder) == {"v": 1}
    assert {p: p.read_bytes() for p in folder.glob("*.csv")} == before and len([p for p in (folder / "versions").iterdir() if p.is_dir()]) == 1


def test_writers_that_die_before_or_in_the_manifest(spark, tmp_path):
    fs, newer = frames(spark), frames(spark, shift=5)
    folder = runs.write_run(fs, {"v": 1}, tmp_path, "d")

    (folder / "versions" / "2.json").write_text('{"number": 2, "whole": tr')
    (folder / "versions" / "2-dead" / "beta_series").mkdir(parents=True)
    assert runs.read_snapshot(folder) == {"v": 1} and content(spark, folder) == expected(fs)
    runs.write_run(newer, {"v": 3}, tmp_path, "d", force=True)
    store = runs.RunStore(spark, folder)
    assert store.numbers() == [1, 2, 3] and store.current()["number"] == 3 and content(spark, folder) == expected(newer)
    assert store.vacuum(keep=1, age=3600) == []
    gone = store.vacuum(keep=1, age=-1)
    assert len(gone) == 2 and "2-dead" in gone and content(spark, folder) == expected(newer) and store.numbers() == [2, 3]


def test_force_never_leaves_a_moment_without_a_run(spark, tmp_path, monkeypatch):
    fs, newer, seen = frames(spark), frames(spark, shift=5), []
    folder = runs.write_run(fs, {"v": 1}, tmp_path, "d")
    for name in ("create", "join", "replace", "delete", "move"):
        real = getattr(Files, name)

        def watched(self, *a, real=real):
            seen.append((runs.RunStore(spark, folder).current()["snapshot"]["v"], (folder / "beta_series.csv").exists()))
            return real(self, *a)

        monkeypatch.setattr(Files, name, watched)
    runs.write_run(newer, {"v": 2}, tmp_path, "d", force=True)
    assert {x[0] for x in seen} == {1, 2} and all(x[1] for x in seen)


def test_two_writers(spark, tmp_path, monkeypatch):
    fs, real = frames(spark, 3), Files.create

    def late(self, name, text):
        if name == "versions/1.json":
            real(self, name, '{"number": 1, "place": "versions/other", "artifacts": {}, "snapshot": {"v": "other"}, "whole": true}')
        return real(self, name, text)

    monkeypatch.setattr(Files, "create", late)
    with pytest.raises(FileExistsError):
        runs.write_run(fs, {"v": 1}, tmp_path, "a")
    runs.write_run(fs, {"v": 1}, tmp_path, "b", force=True)
    assert runs.read_snapshot(tmp_path / "a") == {"v": "other"} and runs.RunStore(spark, tmp_path / "b").current()["number"] == 2


def test_lost_and_cut_off_parts_are_errors(spark, tmp_path):
    folder = runs.write_run(frames(spark), {}, tmp_path, "d")
    part = next(p for p in folder.glob("versions/1-*/beta_series/part-*") if p.stat().st_size)
    whole = part.read_bytes()
    part.write_bytes(whole[:-3])
    with pytest.raises(runs.RunInputError, match="bytes"):
        runs.read_artifact(spark, folder, "beta_series")
    part.unlink()
    with pytest.raises(runs.RunInputError, match="None"):
        runs.read_artifact(spark, folder, "beta_series")


HEAD = "date,segment,percentile_5y,tercile,quintile,direction,n,thin_cut,bootstrap"
GOOD = "2020-01-0{},DM,0.5,Risk-on,Q3,,12.0,True,False"


@pytest.mark.parametrize(
    ("line", "why"),
    [
        ("2020-01-04,DM,0.5,Risk-on,Q3,,12", "9 columns"),
        ("2020-01-04,DM,0.5,Risk-on,Q3,,12,True,False,", "9 columns"),
        ("2020-01-04,DM,half,Risk-on,Q3,,12,True,False", "percentile_5y is no double: half"),
        ("2020-13-04,DM,0.5,Risk-on,Q3,,12,True,False", "date is no date: 2020-13-04"),
        ("2020-01-04,DM,0.5,Risk-on,Q3,,12.5,True,False", "n is no long: 12.5"),
        ("2020-01-04,DM,0.5,Risk-on,Q3,,12,True,Fal", "bootstrap is no boolean: Fal"),
    ],
)
def test_damaged_lines_of_plain_files(spark, tmp_path, line, why):
    (tmp_path / "regimes.csv").write_text("\n".join([HEAD, *[GOOD.format(i) for i in (1, 2, 3)], line, GOOD.format(5)]) + "\n")
    with pytest.raises(runs.RunInputError, match="line 5: .*" + why.replace(".", r"\.")):
        runs.read_artifact(spark, tmp_path, "regimes")
    kept = runs.read_artifact(spark, tmp_path, "regimes", strict=False, quarantine=str(tmp_path / "bad")).orderBy("date").collect()
    assert [r.date.day for r in kept] == [1, 2, 3, 5] and {(r.n, r.percentile_5y, r.thin_cut, r.bootstrap, r.direction) for r in kept} == {(12, 0.5, True, False, None)}
    bad = spark.read.parquet(str(tmp_path / "bad")).first()
    assert (bad.line, bad.text) == (5, line) and why in bad.why and bad.file.endswith("regimes.csv")


def test_line_numbers_of_files_read_in_splits(spark, tmp_path):
    """Line breaks count, whatever the splits."""
    lines = [HEAD] + [GOOD.format(1 + i % 9) for i in range(400)]
    for i in (37, 250, 399):
        lines[i] = lines[i].replace("0.5", "x")
    (tmp_path / "regimes.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        runs.read_artifact(spark, tmp_path, "regimes", strict=False, quarantine=str(tmp_path / "bad")).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [38, 251, 400]


def test_plain_files_of_other_writers(spark, tmp_path):
    """Columns by their names; those that are absent are NULL, an empty file has no rows."""
    (tmp_path / "alerts.csv").write_text("date,kind,segment\n2020-01-02,disagreement,DM\n")
    r = runs.read_artifact(spark, tmp_path, "alerts").first()
    assert (r.date, r.kind, r.segment, r.avg_pairwise, r.fred_series) == (dt.date(2020, 1, 2), "disagreement", "DM", None, None)
    (tmp_path / "alerts.csv").write_text("")
    assert runs.read_artifact(spark, tmp_path, "alerts").count() == 0
    (tmp_path / "alerts.csv").write_text("kind,segment\na,b\n")
    with pytest.raises(runs.RunInputError, match="date"):
        runs.read_artifact(spark, tmp_path, "alerts")
    with pytest.raises(runs.RunInputError, match="correlation"):
        runs.read_artifact(spark, tmp_path, "correlation")
    (tmp_path / "snapshot.json").write_text("{")
    with pytest.raises(runs.RunInputError):
        runs.read_snapshot(tmp_path)


def test_a_failed_csv_leaves_the_old_file(spark, tmp_path):
    schema, path = "date date, v double", tmp_path / "t.csv"
    runs.write_csv(spark.createDataFrame([(DAY, 1.0)], schema), path, schema, ("date",))
    old = path.read_text()
    assert old == "date,v\n2020-01-01,1.0\n"
    with pytest.raises(Exception, match="killed"):
        runs.write_csv(spark.createDataFrame([(DAY, 1.0)], schema).withColumn("v", F.raise_error(F.lit("killed")).cast("double")), path, schema, ("date",))
    assert path.read_text() == old and {p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")} == {"t.csv"}
