"""Runs of the engine: versions of CSV artifacts and a snapshot, committed by a manifest, and readers that report damage.

A run folder `<folder>/<run_date>` holds

* `versions/<n>-<uuid>/<artifact>/part-*`: an artifact's rows, sorted over its parts;
* `versions/<n>.json`: the manifest of version n with the snapshot, and the rows and bytes of every part. It is claimed
  last and never changed, so a writer that dies before it leaves the run as it was, and `force` only adds a version;
* `<artifact>.csv`, `snapshot.json`: the last version as plain files, each put in place by one rename. Readers that know of
  manifests don't use them; a folder that has nothing else is read from them.

All files are written by Spark's executors and listed through Hadoop's file system, so the folder may be any store that
all of them see. A failed listing is an error and never an empty artifact.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from pathlib import Path
from time import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .files import Files, joined

# The artifacts with their columns, and the order of rows in each.
ARTIFACTS = {
    "beta_series": (schemas.BETA.replace("cut string", "segment string"), ("scheme", "_cut", "date")),
    "regimes": (schemas.REGIMES, ("_cut", "date")),
    "correlation": (schemas.CORRELATION, ("_cut", "date")),
    "external_validation": (schemas.VALIDATION, ("date", "_cut", "fred_series")),
    "alerts": ("date date, segment string, from_bucket string, to_bucket string, vol_slope_bucket string, avg_pairwise double, fred_series string, kind string", ("kind", "_cut", "date", "fred_series")),
    "tripwire": (schemas.BETA.replace("cut string", "segment string"), ("scheme", "_cut", "date")),
}
DIGITS = 12
#: Artifacts of so many rows at most are one part; larger ones are dealt into ranges.
ONE_PART = 50_000


class RunInputError(ValueError):
    """A run folder lacks an artifact, or what is there can't be read."""


def columns_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


# ---- writing


@dataclass(frozen=True)
class Part:
    name: str
    bytes: int


def write_parts(files: Files, place: str, df: DataFrame, schema: str, order: tuple[str, ...]) -> tuple[list[Part], int]:
    """Writes rows as sorted CSV parts without a header; their names in order with their bytes, and the number of rows.

    The rows are computed once, into a staging table: the range sort reads its input twice, to sample and to deal out.
    Doubles are rounded, and rows with equal order columns are sorted by the others, so that reruns give the same bytes.
    """
    from ..operators.cuts import CUTS

    spark, names = df.sparkSession, columns_of(schema)
    cut = F.array_position(F.array(*[F.lit(c) for c in CUTS]), F.col("segment")) if "segment" in df.columns else F.lit(0)
    kinds = dict(df.dtypes)
    rounded = [F.round(F.col(n), DIGITS).alias(n) if kinds[n] == "double" else F.col(n) for n in names]
    staging, seen = f"{place}.staging", Observation()
    df.withColumn("_cut", cut).select("_cut", *rounded).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(files.at(staging))
    by = [*order, *[n for n in names if n not in order]]
    n = seen.get["rows"]
    rows = spark.read.parquet(files.at(staging))
    rows = rows.repartition(1) if n <= ONE_PART else rows.repartitionByRange(*by)
    rows.sortWithinPartitions(*by).select(*names).write.option("header", "false").option("nullValue", "").csv(files.at(place))
    parts = [Part(n, size) for n, size, _, folder in files.listed(place) if n.startswith("part-") and not folder]
    if n and not any(p.bytes for p in parts):
        raise OSError(f"{n} rows were written to {files.at(place)}, but the driver finds none: is the folder shared?")
    files.delete(staging)
    return parts, n


def write_csv(df: DataFrame, path: str | Path, schema: str, order: tuple[str, ...]) -> None:
    """One sorted file with a header, also for no rows; what was there stays until the new file is whole."""
    folder, _, name = str(path).rpartition("/")
    files, place = Files(df.sparkSession, folder or "."), f".{name}-{uuid.uuid4().hex}"
    try:
        parts, _ = write_parts(files, place, df, schema, order)
        files.join(_header(schema), [f"{place}/{p.name}" for p in parts], name)
    finally:
        files.delete(place)
        files.delete(f"{place}.staging")


def _header(schema: str) -> str:
    return ",".join(columns_of(schema)) + "\n"


def write_text(path: str | Path, text: str) -> None:
    """A small file, replaced by one rename."""
    folder, _, name = str(path).rpartition("/")
    Files(_session(), folder or ".").replace(name, text)


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class RunStore:
    """The versions of one run."""

    def __init__(self, spark: SparkSession, folder: str | Path) -> None:
        self.spark, self.files = spark, Files(spark, folder)

    def numbers(self) -> list[int]:
        """Claimed numbers, also those whose writer died while it wrote the manifest."""
        return sorted(int(n[:-5]) for n, *_ in self.files.listed("versions") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int) -> dict | None:
        """A version's manifest; None if it isn't whole."""
        try:
            found = json.loads(self.files.read(f"versions/{number}.json"))
        except ValueError:
            return None
        return found if isinstance(found, dict) and found.get("whole") else None

    def current(self) -> dict | None:
        """The last whole version."""
        for n in reversed(self.numbers()):
            if found := self.manifest(n):
                return found
        return None

    def write(self, frames: dict[str, DataFrame], snapshot: dict, exclusive: bool) -> dict:
        """A new version. exclusive: it is an error if another writer has claimed one meanwhile."""
        number = max(self.numbers(), default=0) + 1
        place = f"versions/{number}-{uuid.uuid4().hex}"
        try:
            artifacts = {}
            for name, (schema, order) in ARTIFACTS.items():
                parts, rows = write_parts(self.files, f"{place}/{name}", frames[name], schema, order)
                artifacts[name] = {"rows": rows, "parts": [[p.name, p.bytes] for p in parts]}
            while True:
                found = {"number": number, "place": place, "artifacts": artifacts, "snapshot": snapshot, "whole": True}
                text = json.dumps(found, indent=1, default=str)
                try:
                    self.files.create(f"versions/{number}.json", text)
                    return json.loads(text)
                except FileExistsError:
                    if exclusive and self.current():
                        raise
                    number += 1
        except BaseException:
            self.files.delete(place)
            raise

    def publish(self, version: dict) -> None:
        """The version as plain files; the snapshot comes last."""
        for name, found in version["artifacts"].items():
            parts = [f"{version['place']}/{name}/{p}" for p, _ in found["parts"]]
            self.files.join(_header(ARTIFACTS[name][0]), parts, f"{name}.csv")
        self.files.replace("snapshot.json", json.dumps(version["snapshot"], indent=2))

    def vacuum(self, keep: int = 2, age: float = 86400.0) -> list[str]:
        """Deletes folders of versions beyond the last `keep`, and of writers that died, once they are `age` seconds old."""
        whole = [m for n in self.numbers() if (m := self.manifest(n))]
        numbers = {m["place"].split("/")[1]: m["number"] for m in whole}
        used = {m["place"].split("/")[1] for m in whole[-keep:]}
        gone = [n for n, _, changed, folder in self.files.listed("versions") if folder and n not in used and time() - changed >= age]
        for n in gone:
            if n in numbers:  # its manifest goes first: no reader finds a version without its parts
                self.files.delete(f"versions/{numbers[n]}.json")
            self.files.delete(f"versions/{n}")
        return gone


def write_parquet(frames: dict[str, DataFrame], folder: str) -> None:
    """The same artifacts as tables partitioned by cut."""
    for name, df in frames.items():
        key = "segment" if "segment" in df.columns else "cut" if "cut" in df.columns else None
        writer = df.write.mode("overwrite")
        (writer.partitionBy(key) if key else writer).parquet(f"{folder}/{name}")


def write_run(frames: dict[str, DataFrame], snapshot: dict, folder: str | Path, run_date: str, force: bool = False, flat: bool = True) -> str | Path:
    """Writes a run and returns its folder. flat: also as one file an artifact, which the driver streams; not for large runs."""
    store = RunStore(_session(), joined(folder, run_date))
    if not force and (store.current() or store.files.exists("snapshot.json")):
        raise FileExistsError(f"{store.files.root} exists; force overwrites it")
    version = store.write(frames, snapshot, not force)
    if flat:
        store.publish(version)
    return store.files.root if "://" in str(folder) else Path(folder) / run_date


# ---- reading


def _typed(raw: Column, kind: str) -> Column:
    """The value of a cell; NULL if it is none of that type. Whole doubles are integers too."""
    if kind == "long":
        x = raw.try_cast("double")
        return F.coalesce(raw.try_cast("long"), F.when(x == F.floor(x), x.try_cast("long")))
    return raw if kind == "string" else raw.try_cast(kind)


def read_lines(spark: SparkSession, paths: list[str], header: list[str], schema: str, skip: str | None = None) -> DataFrame:
    """The columns of the schema from CSV lines, with _file, _at, _id (the line's place) and _why: what is wrong with it.

    header: the files' columns in their order; those of the schema that are absent are NULL, others are not read. skip: the
    header's line. Cells are typed one by one, so that damage names its column.
    """
    meta = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id")]
    lines = spark.read.text(paths).select("value", *meta)
    text = ", ".join(f"c{i} string" for i in range(len(header)))
    lines = lines.withColumn("_row", F.from_csv("value", f"{text}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    kinds = dict(x.split() for x in schema.split(", "))
    cells = {n: F.when(F.col(f"_row.c{header.index(n)}") != "", F.col(f"_row.c{header.index(n)}")) if n in header else F.lit(None).cast("string") for n in kinds}
    wrong = [F.when(cells[n].isNotNull() & _typed(cells[n], k).isNull(), F.concat(F.lit(f"{n} is no {k}: "), cells[n])) for n, k in kinds.items() if k != "string"]
    why = F.coalesce(F.when(F.col("_row._bad").isNotNull(), F.lit(f"there are not {len(header)} columns")), *wrong)
    keep = F.lit(True) if skip is None else F.col("value") != skip
    return lines.filter(keep & (F.trim("value") != "")).select(*[_typed(cells[n], k).alias(n) for n, k in kinds.items()], "value", "_file", "_at", "_id", why.alias("_why"))


def damage(spark: SparkSession, lines: DataFrame, paths: list[str]) -> DataFrame:
    """file, line, why, text of the lines that can't be read.

    A line's number is its place in its split, and the lines of the splits before: a count by split, and a sum over splits."""
    from pyspark.sql import Window

    meta = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id")]
    splits = spark.read.text(paths).select(*meta).groupBy("_file", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    over = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0)))
    bad = lines.filter("_why is not null").join(splits, ["_file", "_at"])
    return bad.select(F.col("_file").alias("file"), (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), F.col("_why").alias("why"), F.col("value").alias("text"))


def read_rows(spark: SparkSession, paths: list[str], header: list[str], schema: str, skip: str | None = None, strict: bool = True, quarantine: str | None = None) -> DataFrame:
    """Rows of CSV files. strict: a line that can't be read is an error, which names its file, line and column. Otherwise
    such lines are left out, and written to the table `quarantine` if one is named."""
    lines = read_lines(spark, paths, header, schema, skip)
    if strict:
        for r in damage(spark, lines, paths).orderBy("file", "line").limit(1).collect():
            raise RunInputError(f"{r['file']}, line {r['line']}: {r['why']}")
    elif quarantine:
        damage(spark, lines, paths).write.mode("append").parquet(quarantine)
    return lines.filter("_why is null").select(*columns_of(schema))


def read_snapshot(folder: str | Path) -> dict:
    store = RunStore(_session(), folder)
    if found := store.current():
        return found["snapshot"]
    if not store.files.exists("snapshot.json"):
        raise RunInputError(f"no snapshot.json in {folder}")
    try:
        return json.loads(store.files.read("snapshot.json"))
    except ValueError as e:
        raise RunInputError(f"no readable snapshot.json in {folder}") from e


def read_artifact(spark: SparkSession, folder: str | Path, name: str, strict: bool = True, quarantine: str | None = None) -> DataFrame:
    """An artifact's rows: of the last whole version, or else of the plain file, whose header says which columns it has.

    A missing artifact, a part that is absent or has other bytes than its manifest says, a file without a date column and
    (strict) a line that can't be read are errors. A plain file without any byte has no rows.
    """
    store, schema = RunStore(spark, folder), ARTIFACTS[name][0]
    if version := store.current():
        if name not in version["artifacts"]:
            raise RunInputError(f"version {version['number']} in {folder} has no {name}")
        place = f"{version['place']}/{name}"
        there = {n: size for n, size, *_ in store.files.listed(place)}
        parts = version["artifacts"][name]["parts"]
        for part, size in parts:
            if there.get(part) != size:
                raise RunInputError(f"{place}/{part} has {there.get(part)} bytes, not {size}")
        paths = [store.files.at(f"{place}/{p}") for p, size in parts if size]
        return read_rows(spark, paths, columns_of(schema), schema, None, strict, quarantine) if paths else spark.createDataFrame([], schema)
    file = f"{name}.csv"
    if not store.files.exists(file):
        raise RunInputError(f"no {file} in {folder}")
    head = store.files.first_line(file)
    if not head:
        return spark.createDataFrame([], schema)
    header = [c.strip().strip('"') for c in head.lstrip("﻿").split(",")]
    if "date" not in header or len(set(header)) < len(header):
        raise RunInputError(f"{file} in {folder} has no date column, or a column twice: {head[:200]}")
    return read_rows(spark, [store.files.at(file)], header, schema, head, strict, quarantine)


def read_run(spark: SparkSession, folder: str | Path, strict: bool = True) -> dict:
    """snapshot and all artifacts."""
    return {"snapshot": read_snapshot(folder)} | {name: read_artifact(spark, folder, name, strict) for name in ARTIFACTS}
