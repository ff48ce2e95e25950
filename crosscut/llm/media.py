"""Media columns: Baseline JPEG markers, Huffman scans and DC-only luminance thumbnails, in numpy.

`thumbnails` reads a binary column of JPEG files (several images may follow each other in one value), parses the
markers, decodes the Huffman scans far enough to get the DC coefficient of each luminance block, and returns the
dimensions, the thumbnail (one pixel a block) and hashes of it. Restart intervals are independent, so all intervals of
a slice of rows are decoded in lockstep: step k decodes block k of every interval at once.

`store` writes byte strings as such images without loss. A payload (padded by 0 to a positive multiple of 64) is the DC
thumbnail: each byte is the flat 8-bit luminance of one 8 x 8 block, with a quantiser of 8 the DC coefficient is the
byte - 128, and each row of 64 blocks is a restart interval. 8,191 rows fill an image; longer payloads go on in
further images.

Defined results: null and empty texts are a payload of 64 zeros; null media give null values; damaged or unsupported
media (progressive, 12 bits, cut off) give a `status` that says so and null features; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, flat

SIDE = 64
MAX_ROWS = 65535 // 8
SLICE = 1 << 20
WIDE = 1 << 28  # from so many bytes on, places of bits take 64 bits

# DC symbols (sizes of differences) of the files written here, by code length; lengths 2, 4, 5, 6, 7.
DC_LENGTHS = {2: (7, 4, 3), 4: (2, 5, 1), 5: (0,), 6: (6,), 7: (8,)}
AC_LENGTHS = {1: (0,)}  # only "end of block", in one bit


def _table(lengths: dict[int, tuple[int, ...]]) -> bytes:
    return bytes(len(lengths.get(n, ())) for n in range(1, 17)) + bytes(s for n in sorted(lengths) for s in lengths[n])


def canonical(spec: bytes) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a DHT table: 16 counts, then symbols."""
    out, code, at = [], 0, 16
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            out.append((code, n, spec[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(spec: bytes) -> np.ndarray:
    """For each next 16 bits: code length << 8 | symbol; 0 if no code matches."""
    t = np.zeros(1 << 16, np.int32)
    for code, n, s in canonical(spec):
        if code >> n:
            raise ValueError("bad Huffman table")
        t[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
    return t


def _extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The signed value of n magnitude bits."""
    return np.where(v < (1 << n >> 1), v - (1 << n) + 1, v)


def _fused(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """For 16 bits that hold a DC code, its bits and "end of block": total length << 16 | difference + 32768; else 0."""
    w = np.arange(1 << 16, dtype=np.int64)
    n, size = dc >> 8, dc & 255
    used = n + size
    ok = (n > 0) & (used < 16)
    bits = np.where(ok, (w >> np.where(ok, 16 - used, 0)) & ((1 << np.where(ok, size, 0)) - 1), 0)
    diff = _extend(bits, np.where(ok, size, 0).astype(np.int64))
    end = ac[np.where(ok, (w << np.where(ok, used, 0)) & 0xFFFF, 0)]
    total = used + (end >> 8)
    ok &= (end > 0) & ((end & 255) == 0) & (total <= 16)
    return np.where(ok, total.astype(np.int64) << 16 | (diff + 32768), 0).astype(np.int32)


# ---- writing


def _header(rows: int) -> bytes:
    seg = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    return (
        b"\xff\xd8"
        + seg(0xDB, b"\0" + b"\x08" * 64)
        + seg(0xC0, struct.pack(">BHHB", 8, rows * 8, SIDE * 8, 1) + b"\x01\x11\x00")
        + seg(0xC4, b"\x00" + _table(DC_LENGTHS))
        + seg(0xC4, b"\x10" + _table(AC_LENGTHS))
        + seg(0xDD, struct.pack(">H", SIDE))
        + seg(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and length of a whole block, by difference + 255."""
    dc = {s: (c, n) for c, n, s in canonical(_table(DC_LENGTHS))}
    bits, length = np.zeros(511, np.uint64), np.zeros(511, np.uint64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        bits[d + 255] = (code << size | (d if d >= 0 else d + (1 << size) - 1)) << 1
        length[d + 255] = n + size + 1
    return bits, length


BITS, LENGTHS = _code_tables()


def _packed(diff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of all rows (differences + 255), each row padded with ones to a byte; and each row's bytes.

    Rows are packed in lockstep: each has an accumulator of which full 32-bit words are stored.
    """
    n = len(diff)
    bits, length = BITS.take(diff.T), LENGTHS.take(diff.T)
    words = np.zeros(n * (SIDE // 2 + 1), np.uint32)
    at, acc = np.arange(n) * (SIDE // 2 + 1), np.zeros(n, np.uint64)
    held, used = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(SIDE):
        acc <<= length[k]
        acc |= bits[k]
        held += length[k]
        full = held >> np.uint64(5)  # 0 or 1
        words[at] = acc >> (held & np.uint64(31)) * full  # overwritten until it is full
        at += full.astype(np.int64)
        held &= np.uint64(31)
    used = (at - np.arange(n) * (SIDE // 2 + 1)) * 4 + (held.astype(np.int64) + 7) // 8
    gap = np.uint64(32) - held
    words[at] = (acc << gap) | ((np.uint64(1) << gap) - np.uint64(1))
    rows = words.byteswap().view(np.uint8).reshape(n, -1)
    return rows[np.arange(rows.shape[1]) < used[:, None]], used


def encode(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """One value of media per byte string."""
    sizes = np.diff(offs)
    padded = np.maximum((sizes + SIDE - 1) // SIDE, 1)
    first = np.concatenate(([0], np.cumsum(padded)))  # rows
    pay = np.zeros(int(first[-1]) * SIDE, np.int16)
    pay[np.arange(len(data)) + np.repeat(first[:-1] * SIDE - offs[:-1], sizes)] = data
    pay = pay.reshape(-1, SIDE)
    diff = np.empty_like(pay)
    diff[:, 0] = pay[:, 0] - 128
    np.subtract(pay[:, 1:], pay[:, :-1], out=diff[:, 1:])
    diff += 255
    raw, n_bytes = _packed(diff)
    at = np.concatenate(([0], np.cumsum(n_bytes)))
    stuffed = np.flatnonzero(raw == 255)
    row_bytes = n_bytes + np.bincount(np.searchsorted(at, stuffed, "right") - 1, minlength=len(n_bytes)) + 2
    marks = np.concatenate([np.arange(n) % MAX_ROWS for n in padded])
    out = np.insert(  # zeros after 0xFF, and a restart marker after each row
        raw,
        np.concatenate((stuffed + 1, np.repeat(at[1:], 2))),
        np.concatenate((np.zeros(len(stuffed), np.int64), np.stack((np.full(len(marks), 255), 0xD0 + marks % 8), 1).ravel())),
    )
    starts = np.concatenate(([0], np.cumsum(row_bytes)))
    body, media = out.tobytes(), []
    for k in range(len(sizes)):
        parts = []
        for r in range(int(first[k]), int(first[k + 1]), MAX_ROWS):
            to = min(r + MAX_ROWS, int(first[k + 1]))
            parts += [_header(to - r), body[starts[r] : starts[to] - 2], b"\xff\xd9"]
        media.append(b"".join(parts))
    return media


# ---- reading


class Image:
    """What the markers of one image say. Only the scan with the first component is kept."""

    __slots__ = ("width", "height", "comps", "quant", "dc", "ac", "interval", "start", "layout", "across", "down", "luma")


def parse(buf: bytes, at: int, end: int, ends: np.ndarray) -> Iterator[Image]:
    """The images in buf[at:end]; ends: positions of markers that end a scan, in ascending order."""
    while at < end:
        if buf[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        im, quant, huff, interval, done = Image(), {}, {}, 0, False
        while not done:
            if at + 4 > end and buf[at : at + 2] != b"\xff\xd9":
                raise ValueError("cut off")
            if buf[at] != 255:
                raise ValueError("no marker")
            mark = buf[at + 1]
            if mark == 0xFF:
                at += 1
                continue
            if mark == 0xD9:
                at += 2
                break
            size = int.from_bytes(buf[at + 2 : at + 4], "big")
            seg, at = buf[at + 4 : at + 2 + size], at + 2 + size
            if at > end:
                raise ValueError("cut off")
            if mark == 0xDB:
                while seg:
                    wide = seg[0] >> 4
                    quant[seg[0] & 15] = int.from_bytes(seg[1 : 2 + wide], "big")
                    seg = seg[1 + 64 * (1 + wide) :]
            elif mark == 0xC4:
                while seg:
                    n = 17 + sum(seg[1:17])
                    huff[seg[0]] = seg[1:n]
                    seg = seg[n:]
            elif mark == 0xDD:
                interval = int.from_bytes(seg[:2], "big")
            elif mark in (0xC0, 0xC1):
                depth, im.height, im.width, n = struct.unpack(">BHHB", seg[:6])
                if depth != 8 or not im.width or not im.height:
                    raise ValueError("unsupported")
                im.comps = [(seg[6 + 3 * i], seg[7 + 3 * i] >> 4, seg[7 + 3 * i] & 15, seg[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
                raise ValueError("unsupported")
            elif mark == 0xDA:
                chosen = {seg[1 + 2 * i]: seg[2 + 2 * i] for i in range(seg[0])}
                k = int(np.searchsorted(ends, at))
                stop = int(ends[k]) if k < len(ends) else end
                if im.comps[0][0] in chosen:
                    luma = im.comps[0]
                    parts = [c for c in im.comps if c[0] in chosen]
                    h, v = max(c[1] for c in im.comps), max(c[2] for c in im.comps)
                    bw, bh = -(-im.width * luma[1] // (8 * h)), -(-im.height * luma[2] // (8 * v))
                    if len(parts) == 1:
                        im.across, im.down, im.layout = bw, bh, ((True, chosen[luma[0]]),)
                        im.luma = (1, 1)
                    else:
                        im.across, im.down = -(-im.width // (8 * h)), -(-im.height // (8 * v))
                        im.layout = tuple((c is luma, chosen[c[0]]) for c in parts for _ in range(c[1] * c[2]))
                        im.luma = luma[1:3]
                    im.quant, im.interval, im.start = quant[luma[3]], interval, (at, stop)
                    im.dc = tuple(huff[t >> 4] for _, t in im.layout)
                    im.ac = tuple(huff[16 | t & 15] for _, t in im.layout)
                    im.comps = [(bw, bh), *im.comps]
                    done_image = im
                at = stop
        if not hasattr(im, "start"):
            raise ValueError("no scan")
        yield done_image


_LUTS: dict = {}


def _luts(dc: bytes, ac: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if (dc, ac) not in _LUTS:
        if len(_LUTS) > 64:
            _LUTS.clear()
        a, b = _lookup(dc), _lookup(ac)
        _LUTS[dc, ac] = a, b, _fused(a, b)
    return _LUTS[dc, ac]


def _lanes(win: np.ndarray, pos: np.ndarray, stop: np.ndarray, mcus: np.ndarray, im: Image) -> tuple[np.ndarray, np.ndarray]:
    """DC values of the luminance blocks of lanes of one format: (lanes, mcus, blocks); and which lanes failed."""
    n, most = len(pos), int(mcus.max())
    luma = [k for k, (is_luma, _) in enumerate(im.layout) if is_luma]
    out = np.zeros((most * len(luma), n), np.int32)
    order = np.argsort(-mcus, kind="stable")  # the lanes that go on stay in front
    pos, left = pos[order].copy(), mcus[order]
    stop = stop[order]
    dead = np.zeros(n, bool)

    def peek(p: np.ndarray) -> np.ndarray:
        return (win.take(p >> 3, mode="clip") >> (8 - (p & 7))) & 0xFFFF

    luts = [_luts(d, a) for d, a in zip(im.dc, im.ac, strict=True)]
    total = np.zeros(n, np.int32)
    for m in range(most):
        live = int(np.searchsorted(-left, -m))  # left > m
        col = 0
        for k, (is_luma, _) in enumerate(im.layout):
            dc, ac, fused = luts[k]
            p = pos[:live]
            e = fused.take(peek(p), mode="clip")
            diff = (e & 0xFFFF) - 32768
            step = e >> 16
            if not step.all():
                slow = np.flatnonzero(step == 0)
                d, s, wrong = _slow(peek, p[slow], dc, ac)
                diff[slow], step[slow] = d, s
                dead[slow[wrong]] = True
            p += step
            if is_luma:
                total[:live] += diff
                out[m * len(luma) + col, :live] = total[:live]
                col += 1
    dead |= pos > stop  # read beyond its interval
    back = np.empty_like(order)
    back[order] = np.arange(n)
    bad = dead[back]
    return out.T[back], bad


def _slow(peek, p: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One block a lane, symbol by symbol: DC difference, bits used, whether a code was unknown."""
    at = p.copy()
    e = dc[peek(at)]
    wrong = e == 0
    size = (e & 255).astype(np.int64)
    wrong |= size > 15
    size = np.where(wrong, 0, size)
    at += e >> 8
    v = peek(at) >> (16 - size)
    diff = _extend(v, size)
    at += size
    k = np.ones(len(p), np.int64)
    go = ~wrong
    while go.any():
        e = ac[peek(at)]
        lost = go & (e == 0)
        wrong |= lost
        go &= ~lost
        sym = e & 255
        run, bits = sym >> 4, sym & 15
        at += np.where(go, (e >> 8) + bits, 0)
        over = (sym & 15 == 0) & (run != 15)
        k = np.where(go, np.where(over, 64, k + run + 1), k)
        go &= k < 64
    return diff, at - p, wrong


def decode(data: np.ndarray, offs: np.ndarray) -> list[tuple[str, list]]:
    """Per value: status, and (width, height, thumbnail as uint8 rows x columns) per image."""
    buf = data.tobytes()
    n = len(offs) - 1
    ff = np.flatnonzero(data[:-1] == 255)
    nxt = data[ff + 1]
    rst = (nxt >= 0xD0) & (nxt <= 0xD7)
    ends, marks = ff[(nxt != 0) & ~rst & (nxt != 255)], ff[rst]
    status, images = ["ok"] * n, [[] for _ in range(n)]
    for i in range(n):
        try:
            images[i] = list(parse(buf, int(offs[i]), int(offs[i + 1]), ends))
            if not images[i]:
                status[i] = "empty"
        except (ValueError, IndexError, KeyError, struct.error, AttributeError) as e:
            status[i] = "unsupported" if str(e) == "unsupported" else "corrupt"
            images[i] = []
    stuffing = ff[nxt == 0] + 1
    clean = np.delete(data, stuffing)
    shift = lambda x: x - np.searchsorted(stuffing, x)
    pad = np.concatenate((clean, np.zeros(3, np.uint8))).astype(np.int32)
    win = pad[:-2] << 16 | pad[1:-1] << 8 | pad[2:]
    place = np.int32 if len(clean) < WIDE else np.int64  # of a bit
    groups = defaultdict(list)
    for i, ims in enumerate(images):
        for j, im in enumerate(ims):
            a, b = im.start
            cuts = marks[np.searchsorted(marks, a) : np.searchsorted(marks, b)] if im.interval else marks[:0]
            n_mcu = im.across * im.down
            want = -(-n_mcu // im.interval) if im.interval else 1
            if len(cuts) != want - 1:
                status[i] = "corrupt"
                continue
            groups[im.dc, im.ac, tuple(x for x, _ in im.layout)].append((i, j, im, a, b, cuts, n_mcu, want))
    thumbs: dict = {}
    for found in groups.values():
        begin = np.concatenate([np.concatenate(([a], cuts + 2)) for _, _, _, a, _, cuts, _, _ in found])
        stop = np.concatenate([np.concatenate((cuts, [b])) for _, _, _, _, b, cuts, _, _ in found])
        mcus = np.concatenate(
            [np.minimum(np.full(w, im.interval or m), m - np.arange(w) * (im.interval or m)) for _, _, im, _, _, _, m, w in found]
        )
        dc, bad = _lanes(win, (shift(begin) * 8).astype(place), (shift(stop) * 8).astype(place), mcus, found[0][2])
        at = 0
        for i, j, im, _, _, _, m, w in found:
            mine, at = slice(at, at + w), at + w
            if bad[mine].any():
                status[i] = "corrupt"
                continue
            per = sum(x for x, _ in im.layout)
            vals = dc[mine].ravel() if (mcus[mine] * per == dc.shape[1]).all() else np.concatenate(
                [r[: c * per] for r, c in zip(dc[mine], mcus[mine], strict=True)]
            )
            h, v = im.luma
            grid = vals.reshape(im.down, im.across, v, h).transpose(0, 2, 1, 3).reshape(im.down * v, im.across * h)
            bw, bh = im.comps[0]
            pix = (grid[:bh, :bw].astype(np.int64) * im.quant + 4) // 8 + 128
            thumbs[i, j] = np.clip(pix, 0, 255).astype(np.uint8)
    return [
        (s, [(im.width, im.height, thumbs[i, j]) for j, im in enumerate(images[i])] if s == "ok" else [])
        for i, s in enumerate(status)
    ]


def mean_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are brighter than the mean of the cells."""
    r, c = thumb.shape
    rows, cols = np.arange(8) * r // 8, np.arange(8) * c // 8
    s = np.add.reduceat(np.add.reduceat(thumb, rows, 0, dtype=np.int64), cols, 1)
    area = np.outer(np.maximum(np.diff(rows, append=r), 1), np.maximum(np.diff(cols, append=c), 1))
    cell = s / area
    return np.packbits((cell > cell.mean()).ravel()).tobytes().hex()


STORED = "id long, n_bytes long, media binary"
READ = (
    "id long, n_bytes long, status string, width long, height long, images int, thumb binary, mean_hash string, "
    "media_bytes long, media_sha256 string"
)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in by_bytes(whole, "body", SLICE):
            data, offs = flat(b.column("body"))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(np.diff(offs), pa.int64()), pa.array(encode(data, offs), pa.binary())],
                ["id", "n_bytes", "media"],
            )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in by_bytes(whole, "media", SLICE):
            col = b.column("media")
            data, offs = flat(col)
            rows = {k.split()[0]: [] for k in READ.split(", ")}
            for i, (status, ims) in enumerate(decode(data, offs)):
                null = not col[i].is_valid
                media = data[offs[i] : offs[i + 1]].tobytes()
                ok = status == "ok"
                row = {
                    "status": None if null else status,
                    "width": ims[0][0] if ok else None,
                    "height": sum(h for _, h, _ in ims) if ok else None,
                    "images": len(ims) if ok else None,
                    "thumb": b"".join(t.tobytes() for *_, t in ims) if ok else None,
                    "mean_hash": ":".join(mean_hash(t) for *_, t in ims) if ok else None,
                    "media_bytes": None if null else len(media),
                    "media_sha256": None if null else hashlib.sha256(media).hexdigest(),
                }
                for k, v in row.items():
                    rows[k].append(v)
            rows["id"], rows["n_bytes"] = b.column("id"), b.column("n_bytes")
            types = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
            yield pa.RecordBatch.from_pydict(
                {n: pa.array(rows[n], types[t]) if isinstance(rows[n], list) else rows[n] for n, t in map(str.split, READ.split(", "))}
            )


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: each text's bytes as an image without loss."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body")).mapInArrow(_store, STORED)


def thumbnails(media: DataFrame) -> DataFrame:
    """media: id, n_bytes, media. Dimensions, thumbnails and hashes of each value."""
    return media.select("id", "n_bytes", "media").mapInArrow(_read, READ)
