"""Vector code compression: a codebook for each part of a vector, learned in rounds, and vectors as codes of nearest entries.

Each round builds a kd-tree per codebook and broadcasts them (`parts` times `entries` short integer rows, whatever the
input). A task searches its vectors part by part, all points of a batch at once: a subtree is entered where the squared
distance to the box of its entries is at most the best so far, so entries at an equal distance are met and the lower index
wins. Sums and counts per entry are integers, summed in the task and then by Spark, so that a round doesn't hang on the
partitioning, the order or a retried task. What comes to the driver is one row per entry.

Defined results: vectors that are null or hold null or non-finite components are dropped, and so are those whose length
isn't the commonest (the longer of several). Components are floor(4096 * x), held within +-2**26 so that 64 bits hold all
sums. Parts are cut at part * length // parts: equal where that divides. The first entries are those of the smallest ids,
null ids last, repeated ids by components, then by label; of fewer vectors there are fewer entries. An entry that no part
takes stays. A table without vectors gives no rows. Input columns beyond the three named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE, MOST = 4096, 2**26
#: Points that are searched at once.
BATCH = 16_384
#: Sums of errors by label are broadcast up to so many labels; beyond it the rows are shuffled by label.
BROADCAST_LABELS = 100_000


@dataclass(frozen=True)
class Node:
    """A box of entries; a leaf has their indexes, ascending."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    children: tuple["Node", ...] = ()


def build(book: np.ndarray, index: np.ndarray | None = None, leaf: int = 2) -> Node:
    """A kd-tree over the rows of a codebook, split at the median of the widest dimension."""
    index = np.arange(len(book)) if index is None else index
    own = book[index]
    low, high = own.min(0), own.max(0)
    if len(index) <= leaf or not own.shape[1] or (low == high).all():
        return Node(low, high, np.sort(index))
    order = index[np.argsort(own[:, int(np.argmax(high - low))], kind="stable")]
    half = len(order) // 2
    return Node(low, high, np.sort(index), (build(book, order[:half], leaf), build(book, order[half:], leaf)))


def _gap(node: Node, x: np.ndarray) -> np.ndarray:
    """Squared distances of points to the node's box."""
    d = np.maximum(np.maximum(node.low - x, x - node.high), 0)
    return np.einsum("ij,ij->i", d, d)


def nearest(tree: Node, book: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest entry; ties go to the lower index."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    found = np.full(len(x), len(book), np.int64)

    def visit(node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if not node.children:
            for e in node.entries:
                d = x[at] - book[e]
                d = np.einsum("ij,ij->i", d, d)
                better = (d < best[at]) | ((d == best[at]) & (e < found[at]))
                best[at[better]], found[at[better]] = d[better], e
            return
        left, right = node.children
        gap_l, gap_r = _gap(left, x[at]), _gap(right, x[at])
        first = gap_l <= gap_r
        # the nearer child, then the other where its box is no farther than the best
        visit(left, at[first])
        visit(right, at[~first])
        near_r, near_l = at[first], at[~first]
        visit(right, near_r[gap_r[first] <= best[near_r]])
        visit(left, near_l[gap_l[~first] <= best[near_l]])

    visit(tree, np.arange(len(x)))
    return found, best


def bounds(size: int, parts: int) -> list[tuple[int, int]]:
    return [(p * size // parts, (p + 1) * size // parts) for p in range(parts)]


def integers(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, v of the vectors that are kept, written to the shared folder once, as every round reads them."""
    x = F.transform(rows[vector_col], lambda e: F.greatest(F.least(F.floor(e.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    bad = F.exists(rows[vector_col], lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = rows.filter(rows[vector_col].isNotNull() & ~bad).select(rows[id_col].alias("id"), rows[label_col].alias("label"), x.alias("v"))
    kept = saved(kept, "vectors")
    common = kept.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    return kept.filter(F.size("v") == (common[0]["n"] if common else 0))


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(batch.num_rows, size)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def one_round(vectors: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The codebooks after one assignment: entries become floors of the means of their parts."""
    spark, cuts = vectors.sparkSession, bounds(size, len(books))
    sent = spark.sparkContext.broadcast([(build(b), b) for b in books])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for _, b in trees]
        for batch in _pieces(batches):
            v = _matrix(batch, size)
            for (lo, hi), (tree, book), t in zip(cuts, trees, total, strict=True):
                x = v[:, lo:hi]
                found = nearest(tree, book, x)[0]
                for e in range(len(book)):
                    own = x[found == e]
                    t[e, :-1] += own.sum(0)
                    t[e, -1] += len(own)
        keys = [(p, e, t[e]) for p, t in enumerate(total) for e in np.flatnonzero(t[:, -1])]
        yield pa.RecordBatch.from_pydict(
            {"part": [k[0] for k in keys], "entry": [k[1] for k in keys], "s": [k[2][:-1].tolist() for k in keys], "n": [int(k[2][-1]) for k in keys]},
            pa.schema([("part", pa.int64()), ("entry", pa.int64()), ("s", pa.list_(pa.int64())), ("n", pa.int64())]),
        )

    part = vectors.mapInArrow(sums, "part long, entry long, s array<long>, n long")
    width = max(hi - lo for lo, hi in cuts)
    means = part.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(width)]).alias("s"))
    out = [b.copy() for b in books]
    for row in means.collect():  # a row per entry at most
        wide = out[row["part"]].shape[1]
        out[row["part"]][row["entry"]] = [s // row["n"] for s in row["s"][:wide]]
    sent.unpersist()
    return out


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, list[np.ndarray]]:
    """The vectors' length and a codebook for each part."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v", "label").limit(entries).collect()
    if not first:
        return 0, []
    size, start = len(first[0]["v"]), np.array([r["v"] for r in first], np.int64)
    books = [start[:, lo:hi] for lo, hi in bounds(size, parts)]
    for _ in range(rounds):
        books = one_round(vectors, books, size)
    return size, books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()


def encode(vectors: DataFrame, size: int, books: list[np.ndarray]) -> DataFrame:
    """id, label, code, error: two hex digits a part, and the squared distances to the entries taken."""
    if max(map(len, books), default=0) > 256:
        raise ValueError("two hex digits hold 256 entries")
    spark, cuts = vectors.sparkSession, bounds(size, max(len(books), 1))
    sent = spark.sparkContext.broadcast([(build(b), b) for b in books])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            v = _matrix(batch, size)
            pairs = [nearest(tree, book, v[:, lo:hi]) for (lo, hi), (tree, book) in zip(cuts, sent.value, strict=True)]
            code = np.stack([p[0] for p in pairs], 1).astype(np.uint8)
            hexed = [row.tobytes().hex() for row in code]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(hexed, pa.string()), pa.array(sum(p[1] for p in pairs))], ["id", "label", "code", "error"]
            )

    kinds = dict(vectors.dtypes)
    return vectors.select("id", "label", "v").mapInArrow(codes, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: list[np.ndarray], code_col: str = "code") -> DataFrame:
    """codes with the vector that each code stands for, as integers: a look-up, without a task of its own."""
    entry = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    table = lambda b: F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b])
    return codes.withColumn("v", F.concat(*[F.get(table(b), entry(p)) for p, b in enumerate(books)]))


def compress(rows: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, label, code, error, label_error, codebooks_sha256 of each vector that is kept."""
    vectors = integers(rows, id_col, vector_col, label_col)
    size, books = learn(vectors, parts, entries, rounds)
    done = saved(encode(vectors, size, books), "codes")
    sums = done.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    t = done.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")))
    return t.select("id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
