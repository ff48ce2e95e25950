"""Substring dedup by paragraph MinHash banding.

Paragraphs are the lines of a text (cut at U+000A and U+000D) with at least `MIN_WORDS` words and, with `joined`, runs of
consecutive shorter lines that have as many words together. How short a paragraph may be is a parameter: fewer words
repeat by nature, so by default they stay. Their sets of 5-word shingles get MinHash values in `BANDS` bands of `ROWS`:
paragraphs with an equal band are candidates, confirmed by exact Jaccard similarity of the full sets. Components of
links are classes of repeats; of each class the paragraph that comes first (by document, then place) stays and the
others are to be removed.

At similarity 0.8 a pair misses all bands with probability (1 - 0.8**3)**10 = 8e-4, at 0.9 with 2e-6. Equal sets are
joined by fingerprint first; large buckets go by neighbours and across components as in the LSH forest.

Defined results: null and empty texts have no paragraphs; a null id sorts before all others; rows that repeat an id are
separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, by_bytes, cut, filled, flat, lean, saved, small_batches
from .lsh_forest import bits_of, link
from .shingles import fingerprints, sets, signatures, starts

MIN_WORDS, WORDS = 25, 5
BANDS, ROWS, BITS = 10, 3, 64
SLICE = 1 << 20
SCHEMA = "id long, tk long, para int, start int, size int, n int, print binary, bands array<long>, b0 long"


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end (bytes from the buffer's start) of every line."""
    cut_ = np.flatnonzero((data == 10) | (data == 13))
    start = np.unique(np.concatenate((cut_ + 1, offs[:-1])))
    start = start[start < offs[-1]]
    text = np.searchsorted(offs, start, "right") - 1
    nxt = np.append(cut_, offs[-1])
    end = np.minimum(nxt[np.searchsorted(nxt, start)], offs[text + 1])
    return text, start, end


def _alone(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some spans one after the other, their offsets, and how many words each has."""
    edge = np.concatenate(([0], np.cumsum(end - start)))
    own = data[np.repeat(start - edge[:-1], end - start) + np.arange(edge[-1])]
    return own, edge, np.diff(np.searchsorted(starts(own, edge), edge))


def _bands(sig: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sig), BANDS), np.int64)
    for j in range(BANDS):
        band = sig[:, j * ROWS : (j + 1) * ROWS].astype(np.uint64)
        h = band[:, 0] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j)
        for r in range(1, ROWS):
            h = (h ^ (h >> np.uint64(29)) ^ band[:, r]) * np.uint64(0xBF58476D1CE4E5B9)
        keys[:, j] = (h ^ (h >> np.uint64(32))).view(np.int64)
    return keys


def _features(min_words: int, joined: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, "body", SLICE):
                data, offs = flat(b.column("body"))
                text, start, end = spans(data, offs)
                full = np.flatnonzero(end > start)
                text, start, end = text[full], start[full], end[full]
                place = np.arange(len(text)) - np.searchsorted(text, text)
                own, edge, count = _alone(data, start, end)
                if joined and len(text):
                    short = count < min_words
                    first = np.flatnonzero(np.append(True, ~(short[1:] & short[:-1]) | (text[1:] != text[:-1])))
                    text, start, place, end = text[first], start[first], place[first], end[np.append(first[1:], len(end)) - 1]
                    own, edge, count = _alone(data, start, end)
                long = np.flatnonzero(count >= min_words)
                text, start, place, end = text[long], start[long], place[long], end[long]
                own, edge, _ = _alone(own, edge[:-1][long], edge[1:][long])
                shingle, so = sets(own, edge, WORDS)
                sig = signatures(shingle, so, max(BITS, BANDS * ROWS))
                small = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).take(pa.array(text)) for c in ("id", "tk")),
                        *(small(x) for x in (place, start - offs[text], end - start, np.diff(so))),
                        pa.array(fingerprints(shingle, so), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(long) + 1) * BANDS, pa.int32()), pa.array(_bands(sig).ravel())),
                        bits_of(sig, BITS)[0],
                    ],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )

    return run


def repeats(
    docs: DataFrame, threshold: int = 80, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", joined: bool = False
) -> DataFrame:
    """One row per paragraph that has a repeat: id, para (number of the line, or of the first of joined lines, among the
    text's non-empty lines), start and size (bytes of the text), keep_id and keep_para (the one that stays), class_size,
    removed. joined: consecutive shorter lines are one paragraph."""
    return keyed(docs, threshold, min_words, id_col, text_col, joined).drop("tk")


def keyed(docs: DataFrame, threshold: int = 80, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", joined: bool = False) -> DataFrame:
    """repeats, with tk: a hash of each paragraph's text as a whole."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(F.col(text_col)).alias("body")).withColumn("tk", F.xxhash64("body"))
    # numbers are fixed by writing them
    paras = saved(rows.mapInArrow(lean(_features(min_words, joined)), SCHEMA).withColumn("pid", F.monotonically_increasing_id()), "paragraphs")
    # written, so that the joins may split a paragraph that very many documents hold
    reps = saved(paras.groupBy("print").agg(F.min("pid").alias("rep"), F.count("*").alias("copies")), "representatives")
    member = saved(paras.join(reps, "print").select("pid", "rep", "copies", "id", "tk", "para", "start", "size"), "members")
    own = paras.join(member.filter("pid = rep").select("pid"), "pid", "left_semi")
    # bands of 128-bit fingerprints' representatives; there is no deeper order
    bands = own.select(F.explode("bands").alias("key"), F.lit(0).alias("deep"), F.col("pid").alias("id"), "n", "b0", F.lit(0).cast("long").alias("b1"))

    def texts(pids: DataFrame) -> DataFrame:
        where = member.join(pids.withColumnRenamed("id", "pid"), "pid", "left_semi").select("pid", F.col("id").alias("doc"), F.col("tk").alias("doc_tk"), "start", "size")
        few = where.limit(BROADCAST_IDS // 4 + 1).count() <= BROADCAST_IDS // 4
        found = rows.join(F.broadcast(where) if few else where, rows["id"].eqNullSafe(F.col("doc")) & (rows["tk"] == F.col("doc_tk")))
        body = F.substring(F.encode("body", "UTF-8"), F.col("start") + 1, F.col("size"))
        return found.select(F.col("pid").alias("id"), F.decode(body, "UTF-8").alias("body"))

    comps = link(bands, texts, WORDS, threshold, BITS).withColumnRenamed("id", "rep")
    out = member.join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    many = out.filter("copies > 1 or component <> rep").select("component").unionByName(
        comps.select("component")
    ).distinct()
    out = cut(out.join(many, "component", "left_semi"))
    first = out.groupBy("component").agg(
        F.min(F.struct(F.col("id").isNotNull(), "id", "para", "pid")).alias("first"), F.count("*").alias("class_size")
    )
    first = saved(first, "classes")
    return out.join(first, "component").select(
        F.col("id").alias(id_col),
        "para",
        "start",
        "size",
        F.col("first.id").alias("keep_id"),
        F.col("first.para").alias("keep_para"),
        "class_size",
        (F.col("pid") != F.col("first.pid")).alias("removed"),
        "tk",
    )
