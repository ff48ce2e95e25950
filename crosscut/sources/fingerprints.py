"""Digests of series and of inputs as hash trees, so that no value holds a whole series and a change rehashes one path."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files, shared

#: Files are hashed in ranges of so many bytes.
RANGE = 64 << 20
#: Levels of a series' tree by the length of their label: month, year, decade, all.
LEVELS = (7, 4, 3, 0)


def _folded(rows: DataFrame, keys: list[str], label: str, digest: str) -> DataFrame:
    """keys, digest: SHA-256 of label:digest of the rows of each, in the order of the labels."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", label, digest)))
    return rows.groupBy(*keys).agg(F.sha2(F.concat_ws(",", parts), 256).alias("digest"))


def series_nodes(rows: DataFrame, key: str = "macro_id", date: str = "date", value: str = "value") -> DataFrame:
    """key, label, digest of each node: days (2020-01-31), months (2020-01), years, decades (202) and the root ("").

    A day's node is the SHA-256 of its values as text with their numbers of rows; a node above that of its children's
    labels and digests, in order. A missing date or value is "-". An appended day changes the nodes on its path only.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    counted = rows.groupBy(key, text(date).alias("label"), text(value).alias("v")).agg(F.count("*").cast("string").alias("n"))
    levels = [shared(_folded(counted, [key, "label"], "v", "n"), "days")]
    for size in LEVELS:
        low = levels[-1].withColumnRenamed("label", "child")
        levels.append(_folded(low.withColumn("label", F.substring("child", 1, size)), [key, "label"], "child", "digest"))
    return reduce(DataFrame.unionByName, levels).select(key, "label", "digest")


def series_digest(rows: DataFrame, key: str = "macro_id", date: str = "date", value: str = "value") -> DataFrame:
    """key, hash: the roots of the series' trees."""
    return series_nodes(rows, key, date, value).filter(F.col("label") == "").select(key, F.col("digest").alias("hash"))


def _read_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .workbook import opened

    for batch in batches:
        digests = []
        for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size")), strict=True):
            with opened(path) as f:
                f.seek(at)
                digests.append(hashlib.sha256(f.read(size)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("at"), pa.array(digests, pa.string())], ["path", "at", "range"])


def file_digests(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """path, length, digest of all files of an input, subfolders included.

    A file's digest is the SHA-256 of those of its ranges, as hex text in order. Files of one range are read by Spark's
    binary source; larger ones by range, each in a task of its own.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.filter(F.col("length") <= size).select("path", "length", F.sha2(F.sha2("content", 256), 256).alias("digest"))
    large = files.select("path", "length").filter(F.col("length") > size)
    if not large.limit(1).count():
        return small
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("at")
    ranges = large.select("path", "length", at).repartition("path", "at")
    name = F.regexp_replace("path", "^file:(//)?", "")  # a local file by its path
    read = ranges.select(name.alias("path"), "at", F.least(F.lit(size), F.col("length") - F.col("at")).alias("size")).mapInArrow(_read_range, "path string, at long, range string")
    each = read.groupBy("path").agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "range"))), lambda x: x["range"])), 256).alias("digest"))
    return small.unionByName(large.withColumn("name", name).join(each.withColumnRenamed("path", "name"), "name").select("path", "length", "digest"))


def bucket(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 3)


def input_fingerprint(spark: SparkSession, path: str, size: int = RANGE) -> dict:
    """path, sha256, files, bytes of a file or a folder.

    Names relative to the folder, with length and digest, are folded in order within 4,096 buckets by the names' hashes,
    and the buckets in theirs; so one file or byte more, less or other gives another digest, wherever the folder stands.
    """
    store = Files(spark, path)
    root = store.qualified()
    rows = shared(file_digests(spark, store.root, size), "digests")
    bare = lambda c: F.regexp_replace(c, "^[^:/]+:/+", "/")
    prefix = F.length(bare(F.lit(root))) + 2
    name = F.when(bare(F.col("path")) == bare(F.lit(root)), F.lit("")).otherwise(F.substr(bare(F.col("path")), prefix))
    rows = rows.select(name.alias("name"), "length", F.concat_ws(":", F.col("length").cast("string"), "digest").alias("part"))
    buckets = _folded(rows.withColumn("bucket", bucket(F.col("name"))), ["bucket"], "name", "part")
    top = buckets.agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "digest")))), 256)).first()[0]
    found = rows.agg(F.count("*"), F.sum("length")).first()
    return {"path": store.root, "sha256": top, "files": found[0], "bytes": found[1] or 0}
