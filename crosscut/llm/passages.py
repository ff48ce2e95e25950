"""Repeated passages of any place and line layout: substring dedup on overlapping content-defined paragraphs.

Next to the paragraphs that a text's lines make, each run of `K` words is a paragraph too if the content picks it: its
hash is the smallest of all runs of K words in some window of `SPAN` words. Words are compared as the shingles' words are
(lower-cased, line ends are white space). Equal windows pick equal runs, so two texts that share `SPAN` words share a
picked run wherever it stands. Picked runs with equal words are one class, of which the first (by document, then place)
stays. A run that is repeated by chance of 40 equal words counts, too; none of fewer.

1. The hashes of picked runs are counted over the corpus, about one for 6 words, and a bitmap of those that occur twice
   (at most 2**`HIGH` bits, 64 MB) is broadcast. It only saves work: where it is too small, more runs pass it.
2. Runs that pass are grouped by their 64-bit hash; a run held by many documents is aggregated before it is shuffled. The
   words behind equal hashes aren't compared: of 3e12 runs (about 100 TB) some 2e5 would be false repeats.
3. Adjacent runs that repeat adjacent runs of one document are joined to one row.

What is reported consists of whole picked runs, so either end of a shared passage may go unreported for up to
SPAN - K = 11 words; words outside of a shared passage are never reported.

Defined results: a null id sorts before all others; rows that repeat an id are separate documents; texts of fewer than
`SPAN` words have no passage; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import paragraphs
from .common import by_bytes, cut, filled, flat, lean, mix64, powers, saved
from .shingles import _IS_SPACE, starts, words

SPAN, K = 51, 40
SLICE = 1 << 20
#: Bits of the bitmap for each hash, and the logarithms of its least and largest number of bits.
SPARE, LOW, HIGH = 16, 16, 29
CHUNK = 16
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS = "h long, id long, uid long, tk long, start int, size int, para int"


def _grams(w: np.ndarray, stop: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each word on; NONE where the text ends before."""
    n = len(w)
    out = np.full(n, NONE)
    if n >= k:
        up, down = powers(n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * up[:n])))
        out[: n - k + 1] = mix64((total[k:] - total[:-k]) * down[: n - k + 1])
        out[np.arange(n) + k > stop] = NONE
    return out


def _slide(x: np.ndarray, width: int, op: np.ufunc, pad: np.uint64) -> np.ndarray:
    """op over the width values from each place on."""
    n = len(x)
    x, have = np.concatenate((x, np.full(width, pad))), 1
    while have < width:
        step = min(have, width - have)
        x[:-step] = op(x[:-step], x[step:])
        have += step
    return x[:n]


def picked(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words at which picked runs begin, and the runs' hashes. at: the n + 1 offsets of the texts' words."""
    stop = np.repeat(at[1:], np.diff(at))
    x, width = _grams(w, stop, K), SPAN - K + 1
    low = np.where(np.arange(len(w)) + SPAN <= stop, _slide(x, width, np.minimum, NONE), np.uint64(0))
    best = _slide(low[::-1], width, np.maximum, np.uint64(0))[::-1]
    s = np.flatnonzero((best == x) & (x != NONE))
    return s, x[s]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in by_bytes(whole, "body", SLICE):
            h, n = np.unique(picked(*words(*flat(b.column("body"))))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["h", "n"])


def _chunks(log: int):
    """Bitmaps of 2**CHUNK bits for the hashes' first log bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            bit = b.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - log)
            for c in np.unique(bit >> np.uint64(CHUNK)).tolist():
                own = bit[(bit >> np.uint64(CHUNK)) == c] & np.uint64((1 << CHUNK) - 1)
                maps.setdefault(c, np.zeros(1 << CHUNK, bool))[own] = True
        if maps:
            packed = [np.packbits(m, bitorder="little").tobytes() for m in maps.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int64()), pa.array(packed, pa.binary())], ["c", "bits"])

    return run


def _bitmap(rows: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each hash that occurs twice, and the logarithm of their number."""
    many = cut(rows.mapInArrow(_count, "h long, n tinyint").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))
    log = min(max((many.count() * SPARE).bit_length(), LOW), HIGH)
    chunk = F.shiftrightunsigned("h", 64 - log + CHUNK) if log > CHUNK else F.lit(0)
    parts = many.repartition(chunk).mapInArrow(_chunks(log), "c long, bits binary").toArrow()
    out = np.zeros(1 << (log - 3), np.uint8)
    for c, bits in zip(parts["c"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        out[c << (CHUNK - 3) : (c + 1) << (CHUNK - 3)] |= np.frombuffer(bits, np.uint8)
    return out, log


def _lines(data: np.ndarray, offs: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The number of the non-empty line that each place is in, among those of its text."""
    feed = (data == 10) | (data == 13)
    head = ~feed
    head[1:] &= feed[:-1]
    edge = offs[:-1][offs[:-1] < len(data)]
    head[edge] = ~feed[edge]
    line = np.concatenate(([0], np.cumsum(head)))
    return line[at + 1] - 1 - line[offs[:-1]][text]


def _windows(bitmap, log: int):
    """Picked runs whose hash is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for whole in batches:
            for b in by_bytes(whole, "body", SLICE):
                data, offs = flat(b.column("body"))
                w, at = words(data, offs)
                s, h = picked(w, at)
                bit = h >> np.uint64(64 - log)
                found = ((bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                s, h = s[found], h[found]
                if not len(s):
                    continue
                text = np.searchsorted(at, s, "right") - 1
                first = starts(data, offs)
                begin, last = first[s], first[s + K - 1]
                space = np.append(np.flatnonzero(_IS_SPACE[data]), len(data))
                end = np.minimum(space[np.searchsorted(space, last)], offs[text + 1])
                small = lambda x: pa.array(x.astype(np.int32))
                cols = [pa.array(h.view(np.int64)), *(b.column(c).take(pa.array(text)) for c in ("id", "uid", "tk"))]
                cols += [small(begin - offs[text]), small(end - begin), small(_lines(data, offs, begin, text))]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in RUNS.split(", ")])

    return run


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage that stands in two places, whether it stays or not: id, para (number of the non-empty line in
    which it begins), start and size (bytes of the text), keep_id, keep_para, keep_start, keep_size (of the one that
    stays), class_size (the most places of one of its runs), removed."""
    return _passages(docs, id_col, text_col).drop("keep_tk")


def _passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """passages, with keep_tk: the hash of the text that stays, by which rows of one id, or without one, are told apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(F.col(text_col)).alias("body"))
    bits, log = _bitmap(rows.select("body"))
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    # the numbers of rows are fixed by writing them
    found = saved(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("tk", F.xxhash64("body")).mapInArrow(lean(_windows(sent, log)), RUNS), "passages")
    place = F.struct(F.col("id").isNotNull(), "id", "uid", "start", "size", "para", "tk")
    # written, so that the join may split a hash that very many documents hold
    first = saved(found.groupBy("h").agg(F.min(place).alias("k"), F.count("*").alias("copies")).filter("copies > 1"), "firsts")
    runs = found.join(first, "h").select(
        *("id", "uid", "para", "start", "copies"),
        (F.col("start") + F.col("size")).alias("end"),
        *(F.col(f"k.{c}").alias(f"k_{c}") for c in ("id", "uid", "tk", "para", "start")),
        (F.col("k.start") + F.col("k.size")).alias("k_end"),
    )
    runs = runs.withColumn("removed", (F.col("uid") != F.col("k_uid")) | (F.col("start") != F.col("k_start")))
    # a text that repeats itself leaves its first run whole
    itself = F.col("removed") & (F.col("uid") == F.col("k_uid")) & (F.col("k_end") > F.col("start"))
    runs = runs.withColumn("start", F.when(itself, F.col("k_end")).otherwise(F.col("start"))).filter("end > start")
    doc = Window.partitionBy("uid").orderBy("start", "end")  # a text's own runs
    before = lambda c: F.lag(c).over(doc)
    goes_on = (before("end") >= F.col("start")) & (before("removed") == F.col("removed")) & (before("k_uid") == F.col("k_uid"))
    goes_on &= before("k_start") <= F.col("k_start")
    runs = runs.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(doc))
    least = ("id", "start", "para", "k_id", "k_start", "k_para")
    out = runs.groupBy("uid", "run").agg(
        *(F.min(c).alias(c) for c in least), F.max("end").alias("end"), F.max("k_end").alias("k_end"), F.max("copies").alias("copies"), F.first("removed").alias("removed"),
        F.first("k_tk").alias("k_tk"),
    )
    return out.select(
        F.col("id").alias(id_col),
        "para",
        "start",
        (F.col("end") - F.col("start")).alias("size"),
        F.col("k_id").alias("keep_id"),
        F.col("k_para").alias("keep_para"),
        F.col("k_start").alias("keep_start"),
        (F.col("k_end") - F.col("k_start")).alias("keep_size"),
        F.col("copies").alias("class_size"),
        "removed",
        F.col("k_tk").alias("keep_tk"),
    )


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of near-equal paragraphs (short lines joined) and those of passages, in the columns of paragraphs.repeats.

    A passage whose staying place lies in a paragraph that goes isn't removed, so that the two never remove all copies. The
    place is that of the row's id and text: rows without an id are told apart by their texts.
    """
    lines = saved(paragraphs.keyed(docs, id_col=id_col, text_col=text_col, joined=True), "repeats")
    found = _passages(docs, id_col, text_col)
    span = F.struct("start", (F.col("start") + F.col("size")).alias("end"))
    # the different spans that go of one text: not more than it has paragraphs, however many rows hold it
    gone = lines.filter("removed").groupBy(F.col(id_col).alias("gone_id"), F.col("tk").alias("gone_tk")).agg(F.collect_set(span).alias("spans"))
    same = F.col("keep_id").eqNullSafe(F.col("gone_id")) & (F.col("keep_tk") == F.col("gone_tk"))
    found = found.join(gone, same & F.col("removed"), "left")
    hit = F.exists("spans", lambda x: (x["start"] < F.col("keep_start") + F.col("keep_size")) & (x["end"] > F.col("keep_start")))
    found = found.withColumn("removed", F.col("removed") & ~F.coalesce(hit, F.lit(False)))
    lines = lines.drop("tk")
    return lines.unionByName(found.select(*lines.columns))
