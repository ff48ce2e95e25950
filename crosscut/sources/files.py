"""Files in whatever store Spark reads and writes, through Hadoop's file system: what the driver lists is what executors wrote."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def joined(folder: str | Path, *names: str) -> str:
    """A path below a folder; URIs keep their two slashes."""
    return "/".join([str(folder).rstrip("/"), *names])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see (spark.checkpoint.dir); on local masters a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="crosscut-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared folder: computed once, however often a plan reads them, and kept if executors go."""
    spark = df.sparkSession
    path = joined(shared_dir(spark), "crosscut", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Files:
    """A folder, with names relative to it. Bytes of large files stay in the JVM."""

    def __init__(self, spark: SparkSession, root: str | Path) -> None:
        self.root = str(root).rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def at(self, name: str = "") -> str:
        return joined(self.root, name) if name else self.root

    def _of(self, name: str):
        return self._path(self.at(name))

    def qualified(self) -> str:
        """The root with its store, as Spark names files below it."""
        return self._fs.makeQualified(self._of("")).toString()

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._of(name))

    def listed(self, name: str = "") -> list[tuple[str, int, float, bool]]:
        """Name, bytes, time of change in seconds and whether it's a folder, by name; a folder that isn't there has none."""
        if not self.exists(name):
            return []
        found = self._fs.listStatus(self._of(name))
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime() / 1000, s.isDirectory()) for s in found)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._of(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def first_line(self, name: str) -> str:
        stream = self._fs.open(self._of(name))
        try:
            reader = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(stream, "UTF-8"))
            return reader.readLine() or ""
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes a file that must not be there yet; FileExistsError if it is. Of two writers HDFS lets one through; stores
        without exclusive creation don't promise that."""
        self._fs.mkdirs(self._of(name).getParent())
        try:
            stream = self._fs.create(self._of(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception.getMessage()):
                raise FileExistsError(self.at(name)) from e
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, source: str, target: str) -> None:
        """One rename, over a target that is there."""
        options = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        self._jvm.java.lang.reflect.Array.set(over, 0, options.OVERWRITE)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(self._of(source)), self._fs.makeQualified(self._of(target)), over)

    def replace(self, name: str, text: str) -> None:
        """Readers see the old text or the new one."""
        tmp = self._beside(name)
        self.create(tmp, text)
        self.move(tmp, name)

    def join(self, head: str, parts: list[str], target: str) -> None:
        """One file of a first text and the parts, in order, streamed inside the JVM and put in place by one rename."""
        tmp = self._beside(target)
        self._fs.mkdirs(self._of(tmp).getParent())
        out = self._fs.create(self._of(tmp), False)
        try:
            out.write(bytearray(head.encode()))
            for part in parts:
                stream = self._fs.open(self._of(part))
                try:
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, self._conf, False)
                finally:
                    stream.close()
        finally:
            out.close()
        self.move(tmp, target)

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._of(name), True)

    @staticmethod
    def _beside(name: str) -> str:
        folder, _, last = name.rpartition("/")
        return f"{folder}/.{last}-{uuid.uuid4().hex}".lstrip("/")
