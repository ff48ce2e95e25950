"""Token-id files coded by adaptive context mixing and a range coder, in independent blocks.

A segment's header lists its distinct ids with their frequencies (in steps of a third of a power of two) and, for frequent
ids with a clear successor, that successor. Ids are ranked by frequency; ranks fall into classes by powers of two. Each
block of `BLOCK` ids starts from the header's statistics anew, adapts to its own ids and has its own checksum. A coding
step mixes three predictions of the next id:

* order 2: the id that last followed the previous two in the block;
* order 1: the id that last followed the previous one in the block, or else the header's successor of it;
* order 0: the class by an adaptive distribution of the block, and the id within its class by the header's frequencies.

The shares of orders 2 and 1 are learned weights: how often each was right lately in the block. A 64-bit carry-less range
coder codes the mixed decision, and the place within a class as a second step.

Blocks are coded in lockstep: step k codes id k of every block of a group, so the state of a block (its two context
tables, distribution and coder) is one lane of numpy arrays. A segment holds whole documents, so each can be read
alone; its header has the ids and lengths of the documents, and each block its length and crc32.

Files are Parquet containers with one segment a row, in ascending order of document and partition, so that any store
that Spark writes to will do. Encoding finds the tokenizer's own pre-tokens on the bytes of many texts at once; the
tokenizers library encodes each distinct one once per worker while it stays in the worker's cache. Words with characters
other than ASCII and U+00C0 to U+00FF go to the library up to their white space, and texts with a special token's mark
go to it whole.

Defined results: a null or empty text is the end id alone; repeated document ids keep any order among each other;
documents with a null id come first; an empty table writes no segment; other columns are ignored; damaged segments
raise an error that names the block; ids may be any unsigned 32-bit integers under 2**32 - 1.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, filled, flat, lean, mix64, powers, scratch, small_batches

BLOCK = 1024
GROUP = 8192  # blocks in lockstep
SEGMENT = 8 << 20  # ids of a segment, about
SLICE = 1 << 20
MAGIC = b"CMR4"
ONE, TWO = 128, 256  # cells of the context tables of a block
BITS, STEP, RATE = 14, 24, 4  # the classes' distribution sums to 2**BITS, each has at least about STEP / 3; it learns from every second id
TOTAL = 20  # bits of a mixed decision
SURE, DOUBT = 943_718, 1 << 10  # an order that was always right gets 0.9 of 2**TOTAL
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 40)  # a span of BOTTOM outlasts a decision and a place
U16, U48 = np.uint64(16), np.uint64(48)
#: Steps of the stored frequencies, as thousandths of a power of two.
THIRDS = np.array([1000, 1260, 1587])
#: A successor is stored for ids seen so often, if it follows so large a share of them.
FOLLOWED, CLEAR = 8, 0.25
DENSE = 1 << 22  # ids under it are counted in an array
PLACES = 1 << 22  # up to so many places of classes, a table has the rank of each


class _Prior:
    """Ranks, frequencies and successors of a segment's ids; equal on both sides, as it's computed from the header."""

    def __init__(self, ids: np.ndarray, level: np.ndarray, follow: np.ndarray) -> None:
        """ids: distinct, ascending; level: of each one's frequency; follow: rank + 1 of each rank's successor, or 0."""
        n = len(ids)
        order = np.lexsort((ids, -level.astype(np.int64)))
        self.ids, self.level, self.follow = ids, level, np.append(0, follow).astype(np.int32)
        self.by_rank = ids[order]
        self.rank = np.zeros(n, np.int64)
        self.rank[order] = np.arange(n)
        weight = THIRDS[level[order] % 3] << (level[order].astype(np.int64) // 3)
        self.classes = max(1, n.bit_length())
        first = np.minimum((1 << np.arange(self.classes + 1)) - 1, n)
        size = np.diff(first)
        self.bits = max(16, int(size.max(initial=1)).bit_length() + 1)
        run = np.concatenate(([0], np.cumsum(weight)))
        mass = np.maximum(run[first[1:]] - run[first[:-1]], 1)
        cls = np.repeat(np.arange(self.classes), size)
        self.width = 1 + weight * ((1 << self.bits) - size[cls]) // mass[cls] if n else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(self.width)))
        left = (1 << self.bits) - (ends[first[1:]] - ends[first[:-1]])
        self.width[first[:-1][size > 0]] += left[size > 0]
        ends = np.concatenate(([0], np.cumsum(self.width)))
        self.low = ends[:-1] - ends[first[:-1]][cls] if n else self.width
        self.ends = ends[1:]  # class c has the places from c << bits on
        self.small = np.uint16 if n < (1 << 16) - 1 else np.int32  # holds a rank + 1
        share = np.concatenate(([0], np.cumsum(mass * size.astype(bool))))
        room = (1 << BITS) - self.classes * STEP
        self.cdf = share * room // max(int(share[-1]), 1) + np.arange(self.classes + 1) * STEP
        self.cdf[-1] = 1 << BITS
        # of a rank + 1: its number of bits, less 1
        self.cls = (np.frexp(np.arange(n + 2) * 1.0)[1] - 1).astype(np.int16)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[_Prior, np.ndarray]:
        """The prior of a segment, and the ranks of its ids."""
        if len(ids) and int(ids.max()) < DENSE:
            count = np.bincount(ids)
            names = np.flatnonzero(count)
            where, count = (np.cumsum(count > 0, dtype=np.int32) - 1).take(ids), count[names]
        else:
            names, where, count = np.unique(ids, return_inverse=True, return_counts=True)
        level = np.round(3 * np.log2(np.maximum(count, 1))).astype(np.uint8)
        bare = cls(names, level, np.zeros(len(names), np.int32))
        ranks = bare.rank.astype(np.int32).take(where) if len(ids) else np.zeros(0, np.int32)
        follow = np.zeros(len(names), np.int64)
        if len(ids) > 1:
            pair = ranks[:-1].astype(np.int64) << 32 | ranks[1:]
            pair.sort()
            at = np.flatnonzero(pair[1:] != pair[:-1]) + 1
            at, times = np.append(0, at), np.diff(at, prepend=0, append=len(pair))
            pair = pair[at]
            seen = np.zeros(len(names), np.int64)
            seen[bare.rank] = count
            had = seen[pair >> 32]
            good = np.flatnonzero((had >= FOLLOWED) & (times >= CLEAR * had))
            good = good[np.argsort(times[good], kind="stable")]
            follow[pair[good] >> 32] = (pair[good] & 0xFFFFFFFF) + 1
        return cls(names, level, follow), ranks

    def held(self) -> np.ndarray | None:
        """The rank + 1 that holds each place, if there aren't too many places."""
        if self.classes << self.bits > PLACES:
            return None
        return np.repeat(np.arange(1, len(self.ids) + 1).astype(self.small), self.width)

    def places(self) -> tuple[np.uint64, np.ndarray, np.ndarray]:
        """The bits of a place, and for each rank + 1 its first place and their number; for 0 all places."""
        start, width = np.append(0, self.low), np.append(1 << self.bits, self.width)
        return np.uint64(self.bits), start.astype(np.uint64), width.astype(np.uint64)

    def pack(self) -> bytes:
        n = len(self.ids)
        steps = np.diff(self.ids, prepend=0).astype("<u4")
        return struct.pack("<I", n) + steps.tobytes() + self.level.tobytes() + self.follow[1:].astype("<u4").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> _Prior:
        n = struct.unpack("<I", raw[:4])[0]
        ids = np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64))
        return cls(ids, np.frombuffer(raw, np.uint8, n, 4 + 4 * n), np.frombuffer(raw, "<u4", n, 4 + 5 * n).astype(np.int32))


class _Model:
    """The predictions of all lanes."""

    def __init__(self, lanes: int, prior: _Prior) -> None:
        self.lane, self.follow, n = np.arange(lanes, dtype=np.int32), prior.follow.astype(prior.small), prior.classes
        self.one, self.two = np.zeros(lanes * ONE, prior.small), np.zeros(lanes * TWO, prior.small)
        self.base1, self.base2 = self.lane * np.int32(ONE), self.lane * np.int32(TWO)
        self.cdf = np.repeat(prior.cdf[:, None], lanes, 1).astype(np.int16)
        self.flat = self.cdf.reshape(-1)
        self.rows = np.arange(1, n, dtype=np.int16)[:, None]
        self.low = (self.rows * STEP).astype(np.int16)
        self.room = np.int16((1 << BITS) - n * STEP)
        self.hit1, self.hit2 = np.full(lanes, 1 << 18, np.int32), np.full(lanes, 1 << 17, np.int32)  # of 2**TOTAL
        self.before, self.last = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)

    def predict(self) -> None:
        """Sets the ranks + 1 that order 2 and order 1 predict (0: none) and the shares of the three orders."""
        h = self.last * np.int32(40503)
        self.i1 = self.base1 + (h >> 4 & ONE - 1)
        self.i2 = self.base2 + ((h ^ self.before * np.int32(60493)) >> 5 & TWO - 1)
        self.p2, self.p1 = self.two.take(self.i2), self.one.take(self.i1)
        new = np.flatnonzero(self.p1 == 0)
        self.p1[new] = self.follow.take(self.last.take(new))
        self.w2 = self.hit2 * (self.p2 > 0)
        self.w1 = (self.hit1 >> 10) * ((1 << TOTAL) - self.w2 >> 10) * ((self.p1 > 0) & (self.p1 != self.p2))
        self.w12 = self.w2 + self.w1
        self.rest = (1 << TOTAL) - self.w12

    def within(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a class begins in what orders 1 and 2 leave, and its width."""
        at = cls * np.int32(len(self.lane)) + self.lane
        rest = self.rest.astype(np.int64)
        lo = self.flat.take(at) * rest >> BITS
        return lo, (self.flat.take(at + len(self.lane)) * rest >> BITS) - lo

    def update(self, coded: np.ndarray, cls: np.ndarray, k: int) -> None:
        for h, p in ((self.hit2, self.p2), (self.hit1, self.p1)):
            step = (p == coded) * np.int32(SURE)
            step += np.int32(DOUBT)
            step -= h
            step >>= 4
            step *= p > 0
            h += step
        if not k & 1:
            c = self.cdf[1:-1]
            step = (self.rows > cls) * self.room
            step += self.low
            step -= c
            step >>= RATE
            c += step
        self.one[self.i1] = self.two[self.i2] = coded
        self.before, self.last = self.last, coded.astype(np.int32)


def _encode_group(grid: np.ndarray, prior: _Prior) -> list[bytes]:
    """grid: ranks + 1, steps x lanes. The code of each lane."""
    steps, n = grid.shape
    m = _Model(n, prior)
    low, span = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0), np.uint64)
    out = np.zeros((n, 3 * steps + 8), np.uint16)
    cells, at = out.reshape(-1), np.arange(n) * out.shape[1]
    bits, start, width_of = prior.places()
    for k in range(steps):
        x = grid[k]
        cls = prior.cls.take(x)
        m.predict()
        is2 = m.p2 == x
        is1 = (m.p1 == x) & (m.w1 > 0)
        miss = ~(is2 | is1)
        lo, width = m.within(cls.astype(np.int32))
        span >>= np.uint64(TOTAL)
        low += span * np.where(miss, m.w12 + lo, m.w2 * is1).view(np.uint64)
        span *= np.where(miss, width, np.where(is2, m.w2, m.w1)).view(np.uint64)
        # the place within the class: all of it where orders 1 and 2 were right
        r = x * miss
        span >>= bits
        low += span * start.take(r)
        span *= width_of.take(r)
        at_once, idx = True, None
        while True:
            lo_, sp_ = (low, span) if at_once else (low[idx], span[idx])
            same = (lo_ ^ (lo_ + sp_)) < TOP
            go = same | (sp_ < BOTTOM)
            short = go & ~same
            if short.any():
                sp_[short] = (np.uint64(0) - lo_[short]) & (BOTTOM - np.uint64(1))
            if at_once:
                cells[at] = low >> U48  # stays only where the lane moves on
                at += go
                by = go * U16
                low <<= by
                span <<= by
                idx, at_once = np.flatnonzero(((low ^ (low + span)) < TOP) | (span < BOTTOM)), False  # few move on again
                continue
            idx, lo_, sp_ = idx[go], lo_[go], sp_[go]
            if not len(idx):
                break
            cells[at[idx]] = lo_ >> U48
            at[idx] += 1
            low[idx], span[idx] = lo_ << U16, sp_ << U16
        m.update(x, cls, k)
    for shift in (48, 32, 16, 0):
        cells[at] = (low >> np.uint64(shift)) & np.uint64(0xFFFF)
        at += 1
    used = at - np.arange(n) * out.shape[1]
    return [out[i, : used[i]].tobytes() for i in range(n)]


def _decode_group(codes: list[bytes], steps: int, prior: _Prior) -> np.ndarray:
    """The grid that _encode_group coded, of ranks + 1."""
    n = len(codes)
    sizes = np.array([len(c) // 2 for c in codes])
    cells = np.frombuffer(b"".join(codes) + bytes(8), "<u2")
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    m = _Model(n, prior)
    low, span, code = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0), np.uint64), np.zeros(n, np.uint64)
    for _ in range(4):
        code = code << U16 | cells.take(at, mode="clip").astype(np.uint64)
        at += 1
    bits, start, width_of = prior.places()
    grid = np.zeros((steps, n), prior.small)
    most, last_place, last_rank = np.uint64((1 << TOTAL) - 1), np.uint64((1 << prior.bits) - 1), len(prior.by_rank) - 1
    held = prior.held()
    for k in range(steps):
        m.predict()
        span >>= np.uint64(TOTAL)
        v = np.minimum((code - low) // span, most).astype(np.int32)
        is2 = v < m.w2
        miss = v >= m.w12
        y = ((np.maximum(v - m.w12, 0).astype(np.int64) + 1 << BITS) - 1) // m.rest
        cls = (m.cdf[1:-1] <= y.astype(np.int16)).sum(0, dtype=np.int8).astype(np.int32)
        lo, width = m.within(cls)
        low += span * np.where(miss, m.w12 + lo, m.w2 * ~is2).view(np.uint64)
        span *= np.where(miss, width, np.where(is2, m.w2, m.w1)).view(np.uint64)
        span >>= bits
        place = np.minimum((code - low) // span, last_place).astype(np.int64)
        place += cls.astype(np.int64) << prior.bits
        if held is None:
            r = (np.minimum(np.searchsorted(prior.ends, place, "right"), last_rank) + 1).astype(prior.small)
        else:
            r = held.take(place, mode="clip")
        r *= miss
        x = np.where(miss, r, np.where(is2, m.p2, m.p1))
        low += span * start.take(r)
        span *= width_of.take(r)
        at_once, idx = True, None
        while True:
            lo_, sp_ = (low, span) if at_once else (low[idx], span[idx])
            same = (lo_ ^ (lo_ + sp_)) < TOP
            go = same | (sp_ < BOTTOM)
            short = go & ~same
            if short.any():
                sp_[short] = (np.uint64(0) - lo_[short]) & (BOTTOM - np.uint64(1))
            if at_once:
                by = go * U16
                code <<= by
                code |= cells.take(at, mode="clip") * go  # of 16 bits until here
                at += go
                low <<= by
                span <<= by
                idx, at_once = np.flatnonzero(((low ^ (low + span)) < TOP) | (span < BOTTOM)), False  # few move on again
                continue
            idx, lo_, sp_ = idx[go], lo_[go], sp_[go]
            if not len(idx):
                break
            code[idx] = code[idx] << U16 | cells.take(at[idx], mode="clip").astype(np.uint64)
            at[idx] += 1
            low[idx], span[idx] = lo_ << U16, sp_ << U16
        grid[k] = x
        m.update(x, prior.cls.take(x, mode="clip"), k)
    return grid


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: header, then the code of each block."""
    n = len(ids)
    if n and (ids.min() < 0 or ids.max() >= (1 << 32) - 1):
        raise ValueError("ids must be unsigned 32-bit integers under 2**32 - 1")
    prior, ranks = _Prior.of(ids)
    blocks = -(-n // BLOCK)
    padded = np.ones(blocks * BLOCK, prior.small)
    padded[:n] = ranks
    padded[:n] += 1
    codes: list[bytes] = []
    for g in range(0, blocks, GROUP):
        part = padded[g * BLOCK : (g + GROUP) * BLOCK].reshape(-1, BLOCK)
        steps = BLOCK if blocks > 1 else n
        codes += _encode_group(np.ascontiguousarray(part[:, :steps].T), prior)
    le = ids.astype("<u4")
    sums = [zlib.crc32(le[i * BLOCK : (i + 1) * BLOCK].tobytes()) for i in range(blocks)]
    head = zlib.compress(
        np.array([d is not None for d in doc_ids], np.uint8).tobytes()
        + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        + np.asarray(sizes, "<i8").tobytes()
        + np.array([len(c) for c in codes], "<u4").tobytes()
        + np.array(sums, "<u4").tobytes()
        + prior.pack(),
        1,
    )
    return MAGIC + struct.pack("<IIQII", len(doc_ids), blocks, n, len(head), zlib.crc32(head)) + head + b"".join(codes)


def unpack(segment: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, sizes and ids of a segment; ValueError if a checksum differs."""
    docs, blocks, n, size, crc = struct.unpack("<IIQII", segment[4:28])
    head = segment[28 : 28 + size]
    if segment[:4] != MAGIC or zlib.crc32(head) != crc:
        raise ValueError("bad segment header")
    head = zlib.decompress(head)
    known = np.frombuffer(head, np.uint8, docs)
    names = np.frombuffer(head, "<i8", docs, docs)
    sizes = np.frombuffer(head, "<i8", docs, 9 * docs).astype(np.int64)
    lengths = np.frombuffer(head, "<u4", blocks, 17 * docs).astype(np.int64)
    sums = np.frombuffer(head, "<u4", blocks, 17 * docs + 4 * blocks)
    prior = _Prior.unpack(head[17 * docs + 8 * blocks :])
    ends = np.cumsum(lengths) + 28 + size
    out, named = np.zeros(blocks * BLOCK, np.int64), np.append(0, prior.by_rank)
    for g in range(0, blocks, GROUP):
        codes = [segment[e - k : e] for e, k in zip(ends[g : g + GROUP], lengths[g : g + GROUP], strict=True)]
        grid = _decode_group(codes, BLOCK if blocks > 1 else n, prior)
        part = out[g * BLOCK : (g + GROUP) * BLOCK].reshape(-1, BLOCK)
        part[:, : len(grid)] = named.take(np.ascontiguousarray(grid.T))
    out = out[:n]
    le = out.astype("<u4")
    for i in range(blocks):
        if zlib.crc32(le[i * BLOCK : (i + 1) * BLOCK].tobytes()) != sums[i]:
            raise ValueError(f"block {i} is damaged")
    return [int(d) if k else None for d, k in zip(names, known, strict=True)], sizes, out


# ---- encoding texts

SPACE, LETTER, DIGIT, OTHER = range(4)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = LETTER
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
LATIN = 0xC3  # the first byte of U+00C0 to U+00FF
# The characters that byte-level vocabularies write for bytes; the space between words stays.
_AS_IS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_MAPPED = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_AS_IS))) if b != 0x20}
_CODE = np.array([_MAPPED.get(b, b) for b in range(256)], "<u4")
_BYTE = np.where(_KIND == SPACE, np.uint64(0), mix64(np.arange(1, 257, dtype=np.uint64)))
#: Distinct words that a worker's cache holds, besides those of the texts at hand, with so many bytes a word on average;
#: beyond it the half that was used longest ago goes.
CACHE, CACHE_BYTES = 400_000, 64
JOINED = 100  # words that the library gets as one text


def pre_tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts without marks: the bytes (lower-cased but for words that stay whole), where each pre-token begins and ends
    in them, and the first pre-token of each text (n + 1)."""
    n = len(data)
    kind, low = _KIND[data], _FOLD[data]
    high = data >= 128
    if len(pair := np.flatnonzero(data == LATIN)):
        high[pair] = high[pair + 1] = False
        second = data[pair + 1]
        sign = (second == 0x97) | (second == 0xB7)
        kind[pair[sign]] = kind[pair[sign] + 1] = OTHER
        up = pair[(second <= 0x9E) & ~sign]
        low[up + 1] += 32
    edge = np.zeros(n + 1, bool)
    edge[offs[:-1]] = True
    edge = edge[:n]
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    before[edge] = SPACE
    begin = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
    # 's 't 'm 'd 're 've 'll where an apostrophe begins a run of others
    quote = np.flatnonzero((data == 39) & (before != OTHER))
    quote = quote[quote + 1 < n]
    one = low[quote + 1]
    two = low[np.minimum(quote + 2, n - 1)]
    inside2 = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n - 1)]
    size = np.where(np.isin(one, (115, 116, 109, 100)), 2, 0)
    size[inside2 & ((two == 101) & ((one == 114) | (one == 118)) | (one == 108) & (two == 108))] = 3
    size[edge[quote + 1]] = 0
    quote, size = quote[size > 0], size[size > 0]
    begin[quote + 1] = False
    after = (quote + size)[quote + size < n]
    begin[after[(kind[after] == LETTER) & ~edge[after]]] = True
    inner = kind != SPACE
    if high.any():  # words with such bytes stay whole and as they are
        word = np.cumsum(inner & (before == SPACE)) - 1
        wide = np.zeros(max(int(word[-1]) + 1, 1), bool)
        wide[word[high]] = True
        own = np.flatnonzero(wide[np.maximum(word, 0)] & inner)
        begin[own] = before[own] == SPACE
        low[own] = data[own]
    last = inner.copy()
    last[:-1] &= begin[1:] | ~inner[1:]
    start = np.flatnonzero(begin)
    return low, start, np.flatnonzero(last) + 1, np.searchsorted(start, offs)


def _joined(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The elements of many runs, one run after the other."""
    end = np.cumsum(size)
    return data.take(np.repeat(start - end + size, size) + np.arange(int(end[-1]) if len(end) else 0))


def _appended(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """The first n elements and then more, with room to grow."""
    if n + len(more) > len(held):
        held = np.concatenate((held[:n], np.zeros(len(more) + (n + len(more)) // 4, held.dtype)))
    held[n : n + len(more)] = more
    return held


class Words:
    """Words with their ids, found by hash: a table of slots by the hash's low bits, with linear probing. Of words with one
    hash the table has the first; the others are in a dictionary by their bytes."""

    def __init__(self) -> None:
        self.n = self.n_ids = self.n_raw = 0  # word 0 is none
        self.key, self.used = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.int32)
        self.begin, self.size, self.ids = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32), np.zeros(1 << 12, np.int32)
        self.start, self.length, self.raw = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32), np.zeros(1 << 12, np.uint8)
        self.slots, self.odd = np.zeros(1 << 12, np.int32), {}

    def find(self, key: np.ndarray) -> np.ndarray:
        """The word of each hash; 0 if there is none."""
        most = len(self.slots) - 1
        slot = (key & np.uint64(most)).astype(np.int64)
        word = self.slots.take(slot)
        todo = np.flatnonzero(self.key.take(word) != key)
        while len(todo):
            todo = todo[word[todo] > 0]
            slot[todo] = slot[todo] + 1 & most
            word[todo] = self.slots.take(slot[todo])
            todo = todo[self.key.take(word[todo]) != key[todo]]
        return word

    def add(self, key: np.ndarray, raw: np.ndarray, length: np.ndarray, ids: np.ndarray, size: np.ndarray, now: int | np.ndarray) -> np.ndarray:
        """Adds words, whose bytes and ids lie one after the other, and returns their numbers; the table is left as it is."""
        n, new = self.n + 1, len(key)
        self.key, self.used = _appended(self.key, n, key), _appended(self.used, n, np.broadcast_to(now, new))
        self.begin, self.size = _appended(self.begin, n, np.cumsum(size) - size + self.n_ids), _appended(self.size, n, size)
        self.start, self.length = _appended(self.start, n, np.cumsum(length) - length + self.n_raw), _appended(self.length, n, length)
        self.ids, self.raw = _appended(self.ids, self.n_ids, ids), _appended(self.raw, self.n_raw, raw)
        self.n, self.n_ids, self.n_raw = self.n + new, self.n_ids + len(ids), self.n_raw + len(raw)
        return np.arange(n, n + new, dtype=np.int32)

    def place(self, word: np.ndarray) -> None:
        """Puts words of distinct hashes, which aren't there yet, into the table."""
        if 3 * self.n > len(self.slots):
            old = self.slots[self.slots > 0]
            self.slots = np.zeros(1 << (6 * self.n).bit_length(), np.int32)
            self.place(old)
        most = len(self.slots) - 1
        slot = (self.key[word] & np.uint64(most)).astype(np.int64)
        while len(word):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = word[free]  # of several the last stays
            todo = np.flatnonzero(self.slots[slot] != word)
            word, slot = word[todo], slot[todo] + 1 & most

    def last(self, words: int, most: int) -> Words:
        """The words used last: so many, and of so many bytes in all."""
        order = 1 + np.argsort(-self.used[1 : self.n + 1], kind="stable")[:words]
        keep = np.sort(order[np.cumsum(self.length[order], dtype=np.int64) <= most])
        size, length, kept = self.size[keep], self.length[keep], Words()
        number = np.zeros(self.n + 1, np.int32)
        number[keep] = kept.add(self.key[keep], _joined(self.raw, self.start[keep], length), length, _joined(self.ids, self.begin[keep], size), size, self.used[keep])
        kept.odd = {w: number[i] for w, i in self.odd.items() if number[i]}
        placed = number[self.slots]
        kept.place(placed[placed > 0])
        return kept


class Encoder:
    """Ids of texts by the tokenizers library, with each distinct pre-token encoded once."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.cache = Tokenizer.from_file(path), cache
        # for pre-tokens whose bytes are mapped to characters here, so that nothing normalises or splits them again
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocab, suffix = self.bare.get_vocab(), getattr(self.bare.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # of ids, whether a word ends there
        self.ends[[i for piece, i in vocab.items() if suffix and piece.endswith(suffix)]] = True
        self.marks = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.words, self.now = Words(), 0

    def _learn(self, key: np.ndarray, low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Has the library encode words, and returns their numbers."""
        raw, size = _joined(low, start, size), size.astype(np.int32)
        high = raw >= 128
        pair = np.flatnonzero(raw == LATIN)
        high[pair] = high[pair + 1] = False
        other = np.add.reduceat(high, np.cumsum(size) - size, dtype=np.int32) > 0
        number = np.zeros(len(key), np.int32)
        at = np.flatnonzero(~other)
        if len(at):
            own, long = raw[~np.repeat(other, size)], size[at]
            # many words are one text for the library; its ids tell where each word ends
            code = np.full(len(own) + len(at), 0x20, "<u4")
            stop = np.cumsum(long) + np.arange(1, len(at) + 1)
            code[np.arange(len(own)) + np.repeat(np.arange(len(at)), long)] = _CODE.take(own)
            ends = [0, *stop[JOINED - 1 : -1 : JOINED].tolist(), len(code)]
            texts = [code[i:j].tobytes().decode("utf-32-le") for i, j in zip(ends[:-1], ends[1:], strict=True)]
            found = [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.array(list(chain.from_iterable(found)), np.int32)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(at) and len(ids) == last[-1]:
                number[at] = self.words.add(key[at], own, long, ids, np.diff(last, prepend=0).astype(np.int32), self.now)
            else:
                other[:] = True
        at = np.flatnonzero(other)
        if len(at):
            own, long = raw[np.repeat(other, size)], size[at]
            whole, stop = own.tobytes(), np.cumsum(long)
            texts = [whole[i:j].decode() for i, j in zip((stop - long).tolist(), stop.tolist(), strict=True)]
            found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            count = np.array([len(x) for x in found], np.int32)
            number[at] = self.words.add(key[at], own, long, np.array(list(chain.from_iterable(found)), np.int32), count, self.now)
        return number

    def _number(self, key: np.ndarray, low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word; between words there may be white space. New ones are learned."""
        words = self.words
        word = words.find(key)
        new = np.flatnonzero(word == 0)
        if len(new):
            names, pick, kind = np.unique(key[new], return_index=True, return_inverse=True)
            pick = new[pick]
            learned = self._learn(names, low, start[pick], size[pick])
            words.place(learned)
            word[new] = learned[kind]
        if (words.length.take(word) == size).all():
            first, count = int(start[0]), np.diff(start, append=len(low))
            like = np.repeat((words.start.take(word) - start + first).astype(np.int32), count)
            like += np.arange(len(like), dtype=np.int32)
            same = words.raw.take(like, mode="clip") == low[first:]
            if same.all() or (same | (_KIND.take(low[first:]) == SPACE)).all():
                return word
        # two words have one hash
        raw, held = low.tobytes(), words.raw.tobytes()
        every = [raw[i:j] for i, j in zip(start.tolist(), (start + size).tolist(), strict=True)]
        like = zip(words.start[word].tolist(), words.length[word].tolist(), strict=True)
        wrong = [i for i, (w, (at, n)) in enumerate(zip(every, like, strict=True)) if held[at : at + n] != w]
        first = {every[i]: i for i in reversed(wrong) if every[i] not in words.odd}
        pick = np.array(list(first.values()), np.int64)
        words.odd.update(zip(first, self._learn(key[pick], low, start[pick], size[pick]).tolist(), strict=True))
        word[wrong] = [words.odd[every[i]] for i in wrong]
        return word

    def encode(self, data: np.ndarray, offs: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8, one after the other), each followed by the end id, and how many each has."""
        raw = data.tobytes()
        marked = sorted({i for m in self.marks for i in self._rows_with(raw, m, offs)})
        if not marked:
            return self._encode(data, offs, end)
        ids, counts, at = [], [], 0
        for i in [*marked, len(offs) - 1]:
            if i > at:
                x, n = self._encode(data[offs[at] : offs[i]], offs[at : i + 1] - offs[at], end)
                ids.append(x)
                counts.append(n)
            if i < len(offs) - 1:
                whole = self.tok.encode(raw[offs[i] : offs[i + 1]].decode(), add_special_tokens=False).ids
                ids.append(np.array(whole + [end] * (end is not None), np.int64))
                counts.append(np.array([len(ids[-1])]))
            at = i + 1
        return np.concatenate(ids), np.concatenate(counts)

    @staticmethod
    def _rows_with(raw: bytes, mark: bytes, offs: np.ndarray) -> Iterator[int]:
        at = raw.find(mark)
        while at >= 0:
            yield int(np.searchsorted(offs, at, "right")) - 1
            at = raw.find(mark, at + 1)

    def _encode(self, data: np.ndarray, offs: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        low, start, stop, first = pre_tokens(data, offs)
        self.now += 1
        if self.words.n > self.cache or self.words.n_raw > CACHE_BYTES * self.cache:
            self.words = self.words.last(self.cache // 2, CACHE_BYTES * self.cache // 2)
        if len(start):
            up, down = powers(len(low))
            run = np.cumsum(_BYTE.take(low) * up[: len(low)])  # white space adds nothing
            at = run.take(stop - 1)
            at[1:] -= at[:-1].copy()
            key = mix64(at * down.take(start))
            word = self._number(key, low, start, stop - start)
            self.words.used[word] = self.now
        else:
            word = np.zeros(0, np.int32)
        size = self.words.size.take(word)
        run = np.concatenate(([0], np.cumsum(size)))
        ids = self.words.ids.take(np.repeat(self.words.begin.take(word) - run[:-1], size) + np.arange(run[-1]))
        edges = run[first]
        if end is not None:
            ids = np.insert(ids, edges[1:], end)
        return ids, np.diff(edges) + (end is not None)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker, for all tasks that the worker runs."""
    return Encoder(path)


SEGMENTS = "part int, seg int, docs long, ids long, segment binary"


def _write(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seg, part = encoder(path), 0, TaskContext.get().partitionId()
        docs, sizes, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            row = [[part], [seg], [len(docs)], [len(all_ids)], [pack(docs, np.concatenate(sizes), all_ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["part", "seg", "docs", "ids", "segment"])

        for whole in batches:
            for b in by_bytes(whole, "body", SLICE):
                x, n = enc.encode(*flat(b.column("body")), end)
                docs += b.column("id").to_pylist()
                sizes.append(n)
                ids.append(x)
                held += len(x)
                if held >= SEGMENT:
                    yield flush()
                    docs, sizes, ids, held, seg = [], [], [], 0, seg + 1
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 2) -> None:
    """Writes the ids of all documents below path, in ascending order of id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(F.col(text_col)).alias("body"))
    small_batches(docs.sparkSession)
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    rows.mapInArrow(lean(_write(tokenizer, end)), SEGMENTS).write.option("compression", "none").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, seg, body in zip(*(b.column(c).to_pylist() for c in ("part", "seg", "segment")), strict=True):
            names, sizes, ids = unpack(body)
            edges = np.concatenate(([0], np.cumsum(sizes)))
            raw = ids.astype("<u4").tobytes()
            crcs = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(names), pa.int32()),
                    pa.array([seg] * len(names), pa.int32()),
                    pa.array(names, pa.int64()),
                    pa.array(edges[:-1], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                ["part", "seg", "id", "within", "n_tokens", "ids_crc32"],
            )


def read(spark, path: str) -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    parts = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    segs = files.select("part", "seg", F.coalesce(F.sum("ids").over(within), F.lit(0)).alias("seg_start"))
    starts = segs.join(parts, "part").select("part", "seg", (F.col("seg_start") + F.col("part_start")).alias("base"))
    docs = files.select("part", "seg", "segment").mapInArrow(
        lean(_read), "part int, seg int, id long, within long, n_tokens long, ids_crc32 long"
    )
    return docs.join(starts, ["part", "seg"]).select("id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 2) -> DataFrame:
    """write and read, in a new folder below the shared one."""
    path = scratch(docs.sparkSession, "tokens")
    write(docs, tokenizer, path, id_col, text_col, end)
    return read(docs.sparkSession, path)
