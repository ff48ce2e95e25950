"""Sharding by size-tiered compaction, with DataFrame operations only.

A store is a folder of immutable shards (Parquet files below `data/`) and versioned manifests (below `manifest/`).

* `append` writes arrivals as they come, without a shuffle: each task's rows become small shards of at most
  `rows_per_shard` rows.
* `compact` looks at the manifest only. Shards under `target` bytes fall into tiers by powers of `GROWTH`. In each tier
  with at least `FAN_IN` shards, shards are packed in order of their number into merges of about `target` bytes and at
  most `MAX_FAN_IN` shards; a merge needs two. Each merge becomes one new shard; rounds repeat until no tier has enough
  shards. If `final`, one more round packs what is left over, whatever its tier.
* `commit` writes manifest n + 1 to a folder of its own and then creates the small file `<n + 1>.json`, which names it.
  The file system creates a file that must not exist yet for one writer only, so of two writers one must start again, and
  readers see one version or the next, never a mixture; a number whose file is still empty isn't a version yet.
* `vacuum` removes shards and manifests that the newest version doesn't need, if they are older than a stated age: what a
  writer is about to commit is younger. Shards that a lost writer leaves behind go that way, too.

The manifest has for each shard its number, version, rows, bytes (of the file), smallest and largest id and path.

Defined results: null texts and ids are stored as they are; repeated rows stay as often as they come; an empty table
gives a manifest without shards, which reads as an empty table of the same columns; all columns are stored whatever their names, but for the
reserved `__crosscut_shard` and `_metadata`. A claim that stays empty for `STALE` seconds has lost its writer; others step over it.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

TARGET, ROWS_PER_SHARD = 64 << 20, 1000
FAN_IN, MAX_FAN_IN, GROWTH = 4, 256, 4
SPARE = 8
#: A manifest that is still empty after so many seconds has lost its writer.
STALE = 600.0
SHARD = "__crosscut_shard"
MANIFEST = "shard long, version long, rows long, bytes long, min_id long, max_id long, file string"
#: Merges of so many shards at most are broadcast by name; beyond it Spark joins by shuffle.
BROADCAST_SHARDS = 50_000


class Conflict(RuntimeError):
    """Another writer committed the same version first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id") -> None:
        self.spark, self.path, self.id_col = spark, path.rstrip("/"), id_col

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _empty(self) -> DataFrame:
        kinds = [x.split() for x in MANIFEST.split(", ")]
        return self.spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in kinds])

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        found = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(p)]
        return sorted(int(name[:-5]) for name, size in found if name.endswith(".json") and name[:-5].isdigit() and size)

    def version(self) -> int:
        """The number of the newest manifest, 0 if there is none."""
        return max(self._versions(), default=0)

    def next_version(self) -> int:
        """The number of the next commit. A claim without content is that of a writer at work, or of one that died between
        creating and writing it: after STALE seconds writers step over it. Creation is exclusive on HDFS; object stores
        without exclusive creation need one writer at a time."""
        fs, p = self._fs(f"{self.path}/manifest")
        found = [(s.getPath().getName(), s) for s in fs.listStatus(p)] if fs.exists(p) else []
        claims = {int(name[:-5]): s for name, s in found if name.endswith(".json") and name[:-5].isdigit()}
        last = max(claims, default=0)
        if last and not claims[last].getLen() and time.time() - claims[last].getModificationTime() / 1000 < STALE:
            raise Conflict(f"version {last} is being written")
        return last + 1

    def _entry(self, version: int) -> dict:
        """folder: where a version's manifest is; schema: of the stored rows."""
        fs, p = self._fs(f"{self.path}/manifest/{version:010d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """A row per shard."""
        v = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{self._entry(v)['folder']}") if v else self._empty()

    def commit(self, shards: DataFrame, version: int, schema: StructType | None = None) -> None:
        """schema: of the stored rows, that of the version before by default."""
        known = json.loads(schema.json()) if schema is not None else self._entry(self.version())["schema"]
        folder = f"rows-{version:010d}-{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(f"{self.path}/manifest/{folder}")
        fs, p = self._fs(f"{self.path}/manifest/{version:010d}.json")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            fs.delete(self._fs(f"{self.path}/manifest/{folder}")[1], True)
            raise Conflict(f"version {version} exists") from e
        out.write(bytearray(json.dumps({"folder": folder, "schema": known}).encode()))
        out.close()

    def _folder(self, version: int) -> str:
        """A new folder for shards; a lost writer's folder of the same version is never reused."""
        return f"{self.path}/data/{version:010d}-{uuid.uuid4().hex}"

    def _entries(self, folder: str, version: int, last: int) -> DataFrame:
        """Manifest rows of the shards just written below a folder, numbered by path after `last`."""
        fs, p = self._fs(folder)
        found = fs.globStatus(self._fs(f"{folder}/{{part-*,*/part-*}}")[1])
        if not found:
            return self._empty()
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(folder)
        files = rows.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(
            F.count("*").alias("rows"), F.min(F.col(self.id_col).cast("long")).alias("min_id"), F.max(F.col(self.id_col).cast("long")).alias("max_id")
        )
        number = F.row_number().over(Window.orderBy("file")) + last  # a row per file
        return files.select(number.cast("long").alias("shard"), F.lit(version).cast("long").alias("version"), "rows", "bytes", "min_id", "max_id", "file")

    @staticmethod
    def _last(shards: DataFrame) -> int:
        return shards.agg(F.max("shard")).first()[0] or 0

    def append(self, docs: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> int:
        """Stores arrivals as new small shards; returns the version."""
        if reserved := {SHARD, "_metadata"} & set(docs.columns):
            raise ValueError(f"{min(reserved)} is reserved")
        before, new = self.version(), self.next_version()
        shards, folder = self.manifest(before), self._folder(new)
        docs.write.option("maxRecordsPerFile", rows_per_shard).option("compression", "zstd").parquet(folder)
        self.commit(shards.unionByName(self._entries(folder, new, self._last(shards))), new, docs.schema)
        return new

    @staticmethod
    def plan(shards: DataFrame, target: int = TARGET, final: bool = False) -> DataFrame:
        """shard and into (the smallest shard of its merge) for each shard to be merged.

        The windows run over the manifest, a row per shard.
        """
        small = shards.filter(F.col("bytes") < target)
        tier = F.floor(F.log(float(GROWTH), F.greatest("bytes", F.lit(1)).cast("double")) + 1e-9).cast("int")
        small = small.withColumn("tier", F.lit(0) if final else tier)
        by = Window.partitionBy("tier")
        order = by.orderBy("shard")
        small = small.withColumn("many", F.count("*").over(by)).filter(F.col("many") >= (2 if final else FAN_IN))
        before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # shards of a tier differ by less than GROWTH, so cutting their running sum every target bytes packs well
        small = small.withColumn("by_size", F.floor(before / target)).withColumn("place", F.row_number().over(order) - 1)
        pack = Window.partitionBy("tier", "by_size")
        small = small.withColumn("by_count", F.floor((F.col("place") - F.min("place").over(pack)) / MAX_FAN_IN))
        merge = Window.partitionBy("tier", "by_size", "by_count")
        small = small.withColumn("into", F.min("shard").over(merge)).withColumn("size", F.count("*").over(merge))
        return small.filter(F.col("size") > 1).select("shard", "into", "file")

    def _rows(self, files: DataFrame) -> DataFrame:
        """The rows of some shards (shard, file), with the number of their shard."""
        names = [r[0] for r in files.select("file").collect()]  # names of files, as a scan lists them anyway
        rows = self.spark.read.parquet(*names)
        columns = rows.columns
        path, file = (f"__{x}_{uuid.uuid4().hex}" for x in ("path", "file"))  # names that no stored column has
        named = files.select(F.col("file").alias(file), F.col("shard").alias(SHARD))
        named = F.broadcast(named) if len(names) <= BROADCAST_SHARDS else named
        return rows.withColumn(path, F.col("_metadata.file_path")).join(named, F.col(path) == F.col(file)).select(*columns, SHARD)

    def compact(self, target: int = TARGET, final: bool = True) -> int:
        """Merges until no tier has enough shards; each round is one commit. Returns the version."""
        leftovers = False
        while True:
            v, new = self.version(), self.next_version()
            shards = self.manifest(v)
            merges = self.plan(shards, target, leftovers)
            n = merges.select("into").distinct().count()
            if not n:
                if leftovers or not final:
                    return v
                leftovers = True
                continue
            folder = self._folder(new)
            rows = self._rows(merges.select(F.col("into").alias("shard"), "file"))
            # a merge is one partition and one file; spare partitions keep two merges from meeting in one
            rows.repartition(SPARE * n, SHARD).write.partitionBy(SHARD).option("compression", "zstd").parquet(folder)
            rest = shards.join(merges.select("shard"), "shard", "left_anti").select(*shards.columns)
            self.commit(rest.unionByName(self._entries(folder, new, self._last(shards))), new)
            if leftovers:
                return new

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the number of the shard that each is in."""
        v = self.version() if version is None else version
        if not v:
            raise ValueError("nothing was ever stored here")
        shards = self.manifest(v)
        if not shards.take(1):
            schema = StructType.fromJson(self._entry(v)["schema"])
            return self.spark.createDataFrame([], StructType([*schema.fields]).add(SHARD, LongType()))
        return self._rows(shards)

    def vacuum(self, hours: float = 24.0) -> None:
        """Removes the shards that the newest manifest doesn't name, and older manifests, if they are older than so many
        hours: longer than any append or compaction takes."""
        v, before = self.version(), int((time.time() - 3600 * hours) * 1000)
        if not v:
            return
        path = lambda name: self._fs(name)[1].toUri().getPath()
        named = {path(r[0]) for r in self.manifest(v).select("file").collect()}
        fs, p = self._fs(f"{self.path}/data")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            files = fs.listFiles(s.getPath(), True)
            stale, kept = [], False
            while files.hasNext():
                f = files.next()
                if f.getPath().toUri().getPath() in named or f.getModificationTime() > before:
                    kept = True
                elif f.getPath().getName().startswith("part-"):
                    stale.append(f.getPath())
            if not kept and s.getModificationTime() <= before:
                fs.delete(s.getPath(), True)
            for f in stale if kept else []:
                fs.delete(f, False)
        fs, p = self._fs(f"{self.path}/manifest")
        own = {f"{v:010d}.json", self._entry(v)["folder"]}
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name not in own and s.getModificationTime() <= before:
                fs.delete(s.getPath(), True)
