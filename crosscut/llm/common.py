"""Helpers shared by the corpus operators: scratch space, Arrow text buffers, hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: space and U+0009 to U+000D.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (spark.checkpoint.dir); a temporary one where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="crosscut-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/crosscut/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df with their lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: a checkpoint of columns, for wide rows."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def flat(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    if arr.null_count:  # a null may own bytes
        size = np.diff(offs) * np.asarray(arr.is_valid())
        if size.sum() != offs[-1] - offs[0]:
            return flat(arr.fill_null("" if "string" in str(arr.type) else b""))
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes in a column, one row at least; the rows stay whole."""
    _, offs = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


#: Bytes of one batch between the JVM and Python at most; Spark's default is 64 MB, on both sides of each running task.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of the session, if they aren't bounded as much."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(name)) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(name, str(BATCH_BYTES))


def _bytes(text: str) -> int:
    units = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    digits = text.rstrip("bkmgBKMG")
    return int(digits) * units[text[len(digits) :].lower()]


def give_back() -> None:
    """Hands memory that was freed back to the system: a worker that waits for its next task shouldn't hold what the last took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a mapInArrow, which gives memory back at its end."""

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return to_the_end


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and xor-shift twice."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


GOLD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(log: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.full(1 << log, np.uint64(GOLD)))
    return up, np.cumprod(np.full(1 << log, np.uint64(pow(GOLD, -1, 1 << 64))))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n powers (from the first on) of an odd number and of its inverse, modulo 2**64."""
    log = max(18, n.bit_length())
    return _powers(log) if log < 24 else _powers.__wrapped__(log)  # those of very long texts aren't kept


#: Ids of documents to drop are broadcast up to so many (8 bytes each); beyond it the documents are shuffled by id.
BROADCAST_IDS = 1_000_000


def anti(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not among the dropped ones; all columns stay."""
    ids = cut(dropped.select(F.col(id_col)))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, id_col, "left_anti").select(*docs.columns)
