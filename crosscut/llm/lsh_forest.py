"""MinHash near-dedup by an LSH forest.

Documents link when 100 * |A & B| >= threshold * |A | B| for their sets of k-word shingles; components of links are the
classes of near-duplicates. Steps:

1. Documents with equal sets (by a 128-bit fingerprint) are one class, represented by the smallest id.
2. `TREES` orders of `DEPTH` MinHash values each sort the representatives. A region is a run of rows that share the
   first `root` values. Its rows are candidates of each other. A region of more than `NEAR` + 1 rows goes deeper, by the
   further values: a row's candidates are the region's row of the smallest id and, in one of `SPARSE` large regions, its
   next row in the sorted order, with which it has the longest common prefix. Regions that would crowd a task (found
   from one in `SAMPLE` of the ids) are dealt out by ranges of the order instead of by key, and their rows meet the row
   of the smallest id where they are; nothing else differs for them.
3. Candidates whose sizes rule the link out, or whose signature bits agree too seldom (see `agreeing`), go; the rest
   are confirmed on the full sets, and confirmed links give components.
4. What the deeper regions skipped is made up for: in each large region whose rows lie in more than one component, the
   rows outside its largest component are compared with all its rows, by counting their shingles' occurrences (an exact
   overlap, without emitting pairs), and the links that join components are added. Other regions need nothing. Regions
   are compared in blocks of about `SQUARE` rows by `SQUARE` rows, one group of a task each.

`root` is the largest of 3, 2 and 1 with which a link at the threshold is missed by all trees with a probability of at
most `MISS`. At 0.8 that is 3, and the probability 0.488**20 = 6e-7; too few bits agree with a probability of 3e-7.
Sets of fewer than threshold / (100 - threshold) shingles can link with equal sets only and skip steps 2 to 4.

Defined results: null and empty texts, or texts of white space, have an empty set and are their own component; a null
id is never linked and kept; rows that repeat an id are one document, of which the text with the smallest fingerprint
counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, anti, by_bytes, cut, filled, flat, lean, saved, small_batches
from .components import components, joined
from .shingles import fingerprints, overlap, sets, signatures, sketches

TREES, DEPTH, NEAR = 20, 7, 5
MISS = 5e-3
#: Of large regions, one in so many gives neighbours in the sorted order.
SPARSE = 4
CHUNK = 200_000
#: A region with CROWD of the sampled ids (one in SAMPLE) is dealt out by ranges. So many keys of regions are broadcast.
SAMPLE, CROWD, BROADCAST_KEYS = 16, 500, 200_000
SQUARE = 1000
SLICE = 1 << 20
BITS = 128


def root_of(threshold: int) -> int:
    """The number of MinHash values that a region shares."""
    return max((r for r in (1, 2, 3) if (1 - (threshold / 100) ** r) ** TREES <= MISS), default=1)


def agreeing(threshold: int, bits: int) -> int:
    """So many bits of two signatures agree at least at the threshold: five standard deviations below their mean."""
    p = (1 + threshold / 100) / 2
    return floor(bits * p - 5 * sqrt(bits * p * (1 - p)))


def bits_of(sig: np.ndarray, bits: int) -> list[pa.Array]:
    """The last bits of the first signature values as two longs; the second is 0 for 64 bits."""
    x = np.zeros((len(sig), 2), np.int64)
    x[:, : bits // 64] = np.ascontiguousarray(sketches(sig, bits)).view(np.int64).reshape(len(sig), bits // 64)
    return [pa.array(x[:, 0]), pa.array(x[:, 1])]


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, "body", SLICE):
                shingle, offs = sets(*flat(b.column("body")), k)
                sig = signatures(shingle, offs, TREES * DEPTH)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id"),
                        pa.array(np.diff(offs), pa.int64()),
                        pa.array(fingerprints(shingle, offs), pa.binary()),
                        pa.array([r.tobytes() for r in sig.astype(">u4")], pa.binary()),
                        *bits_of(sig, BITS),
                    ],
                    ["id", "n", "print", "sig", "b0", "b1"],
                )

    return run


def features(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), print (of the set), sig (MinHash values), b0 and b1 (their last bits)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(F.col(text_col)).alias("body"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(lean(_features(k)), "id long, n long, print binary, sig binary, b0 long, b1 long")


def _agree(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: int, bits: int) -> np.ndarray:
    differ = np.bitwise_count((a ^ b).view(np.uint64)).sum(-1)
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    return (bits - differ >= agreeing(threshold, bits)) & (100 * small >= threshold * large)


def _agrees(a: str, b: str, threshold: int, bits: int) -> Column:
    """_agree for two structs of columns."""
    differ = F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))) + F.bit_count(F.col(f"{a}.b1").bitwiseXOR(F.col(f"{b}.b1")))
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (F.lit(bits) - differ >= agreeing(threshold, bits)) & (100 * small >= threshold * large)


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    key, ids, n, b0, b1 = (b.column(c).to_numpy() for c in ("key", "id", "n", "b0", "b1"))
    return key, ids, n, np.stack((b0, b1), 1)


PAIRS = "a long, b long, key long, id long"


def _batch(a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None, ids: np.ndarray | None = None) -> pa.RecordBatch:
    """Candidate pairs, and rows of large regions."""
    more = 0 if key is None else len(key)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    pair = np.unique(np.stack((lo, hi), 1)[lo < hi], axis=0)
    none = lambda m: pa.nulls(m, pa.int64())
    cols = [pa.concat_arrays([pa.array(pair[:, i]), none(more)]) for i in (0, 1)]
    cols += [pa.concat_arrays([none(len(pair)), pa.array(x) if more else none(0)]) for x in (key, ids)]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in PAIRS.split(", ")])


def _candidates(cols: tuple[np.ndarray, ...], threshold: int, width: int) -> Iterator[pa.RecordBatch]:
    """cols: whole regions, one after the other."""
    key, ids, n, bits = cols
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    big = np.repeat(size > NEAR + 1, size)
    found = []
    for o in range(1, min(NEAR, len(key) - 1) + 1):
        i = np.flatnonzero((key[:-o] == key[o:]) & (~big[:-o] | (o == 1) & (key[:-o] % SPARSE == 0)))
        i = i[_agree(bits[i], bits[i + o], n[i], n[i + o], threshold, width)]
        found.append((ids[i], ids[i + o]))
    # large regions: each row with the one of the smallest id, which is the same in most trees
    low = np.lexsort((ids, np.repeat(np.arange(len(start)), size)))[start]
    head = np.repeat(low, size)
    i = np.flatnonzero(big)
    i = i[_agree(bits[i], bits[head[i]], n[i], n[head[i]], threshold, width)]
    found.append((ids[head[i]], ids[i]))
    yield _batch(*(np.concatenate(x) for x in zip(*found, strict=True)), key[big], ids[big])


def _regions(threshold: int, width: int):
    """Candidates of sorted rows, as (a, b); and the rows of large regions, as (key, id).

    A region is held until it ends; one of more than CHUNK rows is handled in parts that share their first row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: tuple[np.ndarray, ...] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = _columns(b)
            if keep is not None:
                cols = tuple(np.concatenate((x, y)) for x, y in zip(keep, cols, strict=True))
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield from _candidates(tuple(x[:last] for x in cols), threshold, width)
            keep = tuple(x[last:] for x in cols)
            if len(keep[0]) > CHUNK:
                yield from _candidates(keep, threshold, width)
                first = int(keep[1].argmin())
                keep = tuple(x[[first, *range(len(x) - NEAR, len(x))]] for x in keep)
        if keep is not None:
            yield from _candidates(keep, threshold, width)

    return run


def _adjacent(threshold: int, width: int):
    """Of sorted rows, those that follow each other in a region, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: tuple[np.ndarray, ...] | None = None
        for b in batches:
            if b.num_rows:
                cols = _columns(b)
                if keep is not None:
                    cols = tuple(np.concatenate((x, y)) for x, y in zip(keep, cols, strict=True))
                key, ids, n, bits = cols
                i = np.flatnonzero(key[1:] == key[:-1])
                i = i[_agree(bits[i], bits[i + 1], n[i], n[i + 1], threshold, width)]
                yield _batch(ids[i], ids[i + 1])
                keep = tuple(x[-1:] for x in cols)

    return run


def _links_across(ids: np.ndarray, comp: np.ndarray, items: list[np.ndarray], asks: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that join components of a block's rows, by exact set overlap; one for each join of two components.

    Each row that asks (those outside the region's largest component) looks up the rows that hold its shingles, so that
    all overlaps of a row are one count. Rows of the largest component need no lookup: a link to them is found from its
    other end.
    """
    n = np.array([len(x) for x in items])
    flat = np.concatenate(items)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], np.repeat(np.arange(len(ids)), n)[order]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    value, size = flat[start], np.diff(np.append(start, len(flat)))
    names, label = np.unique(comp, return_inverse=True)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for r in np.flatnonzero(asks).tolist():
        at = np.searchsorted(value, items[r])
        many = at[size[at] > 1]
        if not len(many):
            continue
        held = np.repeat(start[many] - np.concatenate(([0], np.cumsum(size[many])[:-1])), size[many]) + np.arange(size[many].sum())
        both = np.bincount(row[held], minlength=len(ids))
        hit = np.flatnonzero((100 * both >= threshold * (n[r] + n - both)) & (both > 0))
        for j in hit[np.unique(label[hit], return_index=True)[1]].tolist():  # one row of each component
            x, y = find(int(label[r])), find(int(label[j]))
            if x != y:
                root[x] = y
                out.append((min(int(ids[r]), int(ids[j])), max(int(ids[r]), int(ids[j]))))
    return out


def _across(threshold: int):
    """Links between components within each block of sorted rows (key, ask, block, id, component, asks, items)."""

    def square(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, comp, asks = (np.concatenate([p[i] for p in parts]) for i in range(3))
        items = [np.frombuffer(x, np.uint64) for p in parts for x in p[3]]
        links = _links_across(ids, comp, items, asks, threshold) if asks.any() and (comp != comp[0]).any() else []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            if not b.num_rows:
                continue
            ids, comp, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "asks"))
            name = np.stack([b.column(c).to_numpy() for c in ("key", "ask", "block")], 1)
            items = b.column("items").to_pylist()
            edges = np.flatnonzero(np.append(True, (name[1:] != name[:-1]).any(1)))
            for lo, hi in zip(edges, np.append(edges[1:], len(ids)), strict=True):
                if at is not None and tuple(name[lo]) != at:
                    yield from square(held)
                    held = []
                at = tuple(name[lo])
                held.append((ids[lo:hi], comp[lo:hi], asks[lo:hi], items[lo:hi]))
        if held:
            yield from square(held)

    return run


def _squares(wide: DataFrame) -> DataFrame:
    """wide: key, id, component of the rows of mixed regions. The same with ask, block (the square) and asks.

    A region's rows outside its largest component are dealt into as many parts as `SQUARE` rows need, and so are all its
    rows; each part of the first meets each part of the second in a square.
    """
    sizes = wide.groupBy("key", "component").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("key").agg(F.sum("c").alias("rows"), F.max(F.struct("c", "component")).alias("top"))
    part = lambda rows: F.ceil(rows / SQUARE).cast("int")
    sizes = sizes.select("key", F.col("top.component").alias("top"), part(F.col("rows")).alias("blocks"), part(F.col("rows") - F.col("top.c")).alias("asking"))
    rows = wide.join(sizes, "key").withColumn("odd", F.col("component") != F.col("top"))
    spot = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    rows = rows.withColumn("mine", spot(F.col("blocks"), 1)).withColumn("own", F.when(F.col("odd"), spot(F.col("asking"), 2)))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    # a row is a member of its block with every part that asks; where it asks, it goes to all blocks
    held = rows.select("key", "id", "component", "mine", "own", F.explode(every(F.col("asking"))).alias("ask"))
    held = held.select("key", "ask", F.col("mine").alias("block"), "id", "component", F.coalesce(F.col("own") == F.col("ask"), F.lit(False)).alias("asks"))
    sent = rows.filter("odd and blocks > 1").select("key", "id", "component", "mine", "own", F.explode(every(F.col("blocks"))).alias("block"))
    sent = sent.filter("block <> mine").select("key", F.col("own").alias("ask"), "block", "id", "component", F.lit(True).alias("asks"))
    return held.unionByName(sent)


def _items(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, "body", SLICE):
                shingle, offs = sets(*flat(b.column("body")), k)
                items = [shingle[i:j].tobytes() for i, j in zip(offs[:-1], offs[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(items, pa.binary())], ["id", "items"])

    return run


def _confirm(k: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, "text_a", SLICE):
                sa, oa = sets(*flat(b.column("text_a")), k)
                sb, ob = sets(*flat(b.column("text_b")), k)
                good = []
                for i in range(b.num_rows):
                    x, y = sa[oa[i] : oa[i + 1]], sb[ob[i] : ob[i + 1]]
                    both = overlap(x, y)
                    good.append(both > 0 and 100 * both >= threshold * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def confirm(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """pairs: a, b; texts: id, body. The pairs that link by their full sets."""
    left = texts.select(F.col("id").alias("a"), F.col("body").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("body").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lean(_confirm(k, threshold)), "a long, b long")


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and body of the documents whose ids are listed (id)."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(F.col(text_col)).alias("body"))
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _found(rows: DataFrame, threshold: int, bits: int) -> DataFrame:
    """Candidates (a, b) and rows of large regions (key, id) of rows: key, deep, id, n, b0, b1."""
    shape = rows.schema
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).groupBy("key").count().filter(F.col("count") >= CROWD)
    crowded = cut(some.select("key"))
    n = crowded.count()
    keys = F.broadcast(crowded) if n <= BROADCAST_KEYS else crowded
    plain = rows.join(keys, "key", "left_anti") if n else rows
    plain = plain.repartition("key").sortWithinPartitions("key", "deep", "id").drop("deep")
    found = plain.mapInArrow(_regions(threshold, bits), PAIRS)
    if not n:
        return found
    own = rows.join(keys, "key", "left_semi").select(*shape.names)
    here = own.select("key", F.struct("id", "n", "b0", "b1").alias("x"))
    heads = here.groupBy("key").agg(F.min("x").alias("h"))
    star = here.join(F.broadcast(heads) if n <= BROADCAST_KEYS else heads, "key").filter("x.id <> h.id").filter(_agrees("x", "h", threshold, bits))
    none = F.lit(None).cast("long")
    star = star.select(F.col("h.id").alias("a"), F.col("x.id").alias("b"), none.alias("key"), none.alias("id"))
    order = own.filter(F.col("key") % SPARSE == 0).repartitionByRange("key", "deep", "id").sortWithinPartitions("key", "deep", "id").drop("deep")
    wide = own.select(none.alias("a"), none.alias("b"), "key", "id")
    return found.unionByName(star).unionByName(order.mapInArrow(_adjacent(threshold, bits), PAIRS)).unionByName(wide)


def link(rows: DataFrame, texts: Callable[[DataFrame], DataFrame], k: int, threshold: int, bits: int = BITS) -> DataFrame:
    """rows: key, deep, id, n, b0, b1; rows of equal keys are candidates, in the order of deep. texts: id and body of
    some ids. Gives id and component of every id that has a confirmed link."""
    found = cut(_found(rows, threshold, bits))
    pairs = cut(found.filter("a is not null").select("a", "b").distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bodies = cut(texts(ends).dropDuplicates(["id"]))
    links = cut(confirm(pairs, bodies, k, threshold))
    comps = components(links)
    # what large regions skipped
    wide = found.filter("key is not null").select("key", "id").join(comps, "id", "left")
    wide = wide.withColumn("component", F.coalesce("component", "id"))
    mixed = wide.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    wide = cut(wide.join(mixed, "key", "left_semi"))
    if wide.take(1):
        items = cut(texts(wide.select("id").distinct()).dropDuplicates(["id"]).mapInArrow(lean(_items(k)), "id long, items binary"))
        names = ("key", "ask", "block")
        rows = _squares(wide).join(items, "id").repartition(*names).sortWithinPartitions(*names)
        more = cut(rows.select(*names, "id", "component", "asks", "items").mapInArrow(_across(threshold), "a long, b long").distinct())
        if more.take(1):
            comps = joined(comps, more)
    return comps


def _classes(docs: DataFrame, k: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n_id (shingles of the text of its id), mixed (its id has different texts), component."""
    feats = saved(features(docs, k, id_col, text_col), "forest")
    known = feats.filter(F.col("id").isNotNull())
    # of rows that repeat an id, one text counts
    text = known.groupBy("id").agg(F.min(F.struct("print", "n")).alias("t"), F.max("print").alias("last"), F.count("*").alias("times"))
    again = cut(text.filter("times > 1").select(F.col("id").alias("t_id"), F.col("t.print").alias("t_print"), F.col("t.n").alias("t_n"), "last"))
    repeated, twice = bool(again.take(1)), again.filter("t_print <> last").drop("last")
    few = twice.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    feats = feats.join(F.broadcast(twice) if few else twice, F.col("id") == F.col("t_id"), "left")
    counts = F.col("id").isNotNull() & (F.col("t_print").isNull() | (F.col("print") == F.col("t_print")))
    feats = feats.withColumn("counts", counts).withColumn("print_", F.coalesce("t_print", "print")).withColumn("n_", F.coalesce("t_n", "n"))
    reps = feats.filter("counts and n > 0").groupBy("print").agg(F.min("id").alias("rep")).withColumnRenamed("print", "print_")
    member = feats.select("id", "print_", "n_", F.col("t_id").isNotNull().alias("mixed")).join(reps, "print_", "left")
    rep = F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n_") > 0, F.col("rep")), "id"))
    member = cut(member.select("id", "mixed", F.col("n_").alias("n_id"), rep.alias("rep")))
    tall = feats.filter(F.col("counts") & (F.col("n") * (100 - threshold) >= threshold))
    own = tall.join(member.filter("id = rep").select("id").distinct(), "id", "left_semi")
    own = own.dropDuplicates(["id"]) if repeated else own
    rows = own.select("id", "n", "b0", "b1", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    cell, root = F.col("tree") * (4 * DEPTH) + 1, root_of(threshold)
    rows = rows.select(
        F.xxhash64("tree", F.substring("sig", cell, F.lit(4 * root))).alias("key"),
        F.substring("sig", cell + 4 * root, F.lit(4 * (DEPTH - root))).alias("deep"),
        "id",
        "n",
        "b0",
        "b1",
    )

    def texts(ids: DataFrame) -> DataFrame:
        found = texts_of(docs, ids, id_col, text_col)
        if not repeated:
            return found
        one = texts_of(docs, twice.select(F.col("t_id").alias("id")).join(ids, "id", "left_semi"), id_col, text_col)
        one = one.mapInArrow(lean(_prints(k)), "id long, body string, print binary")
        one = one.join(twice, (F.col("id") == F.col("t_id")) & (F.col("print") == F.col("t_print"))).select("id", "body")
        return found.join(twice.select(F.col("t_id").alias("id")), "id", "left_anti").unionByName(one)

    comps = link(rows, texts, k, threshold).withColumnRenamed("id", "rep")
    return member.join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _prints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, "body", SLICE):
                prints = pa.array(fingerprints(*sets(*flat(b.column("body")), k)), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("body"), prints], ["id", "body", "print"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles (of the text of its id), component_id, kept."""
    out = _classes(docs, k, threshold, id_col, text_col)
    kept = F.col("id").isNull() | (F.col("id") == F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n_id").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each component, with all its columns. Rows with a null id stay, as do rows of an id that repeats
    with different texts, which the id can't tell apart; rows that repeat an id and its text stay or go together."""
    gone = _classes(docs, k, threshold, id_col, text_col).filter("id is not null and id <> component and not mixed")
    return anti(docs, gone.select(F.col("id").alias(id_col)).distinct(), id_col)
