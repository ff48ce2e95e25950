"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has a node per character and an edge per vocabulary piece that matches there; characters without a
piece become their byte pieces. Pieces weigh exp(alpha * log weight), where the log weight is the model's score for
unigram models and -log(rank + `RANK_SHIFT`) for merge models, whose scores are ranks. Backward sums over the lattice
give the probability of each edge.

Perturbed A-star search finds the k segmentations with the largest Gumbel-perturbed log probabilities, which are k
distinct samples without replacement. The root's maximum is one Gumbel draw. Following edges by their probabilities
gives the segmentation that attains it; at each step all other edges together are an unexplored region whose maximum is
a Gumbel draw truncated at the current one. The best region of the queue holds the next segmentation, and what remains
of it and the steps behind it become regions in turn. The best region left over after k segmentations gives the
threshold for the inclusion score: the log of the probability that a segmentation's perturbed value exceeds it.

No piece joins two characters that stand side by side in no piece, so the lattice falls apart there. Distinct parts of a
slice of rows get one lattice; sampling then runs over all parts of all rows in lockstep. Draws are hashes of the seed,
the row key, the sample and the place, so a row's result doesn't depend on its neighbours.

Defined results: a null or empty text has one segmentation, without ids and with inclusion score 0; a text with fewer
than k segmentations gives all of them, each with score 0; null keys draw as key 0; rows that repeat an id right after
each other (the copies of a mix) draw separately, by their turn; an empty table gives an empty result; other columns are
ignored; a model with pieces of more than 63 characters raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, filled, lean, mix64, small_batches

RANK_SHIFT = 10.0
SLICE = 256 << 10  # bytes of texts in one lattice, which takes about 12 bytes for each character and piece length
LONGEST = 63
SPACE = 0x2581
GOLD = np.uint64(0x9E3779B97F4A7C15)
TURN = 0x632BE59BD9B4E019  # added to the key of each further row of an id


class Vocabulary:
    """Pieces of a model as a trie over its characters."""

    def __init__(self, path: str, alpha: float = 1.0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes_of = np.full(256, sp.unk_id(), np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.bytes_of[int(sp.id_to_piece(i)[3:5], 16)] = i
        pieces = {i: sp.id_to_piece(i) for i in plain}
        scores = np.array([sp.get_score(i) for i in plain])
        merge = len(scores) and (scores == np.round(scores)).all()
        weight = alpha * (-np.log(RANK_SHIFT - scores) if merge else scores)
        chars = sorted({c for p in pieces.values() for c in p})
        self.char = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        v = self.v = len(chars) + 1
        self.joins = np.zeros((v, v), bool)
        self.longest = max(map(len, pieces.values()), default=1)
        if self.longest > LONGEST:
            raise ValueError(f"pieces of more than {LONGEST} characters aren't supported")
        nodes, self.piece, logw = {}, [-1], [0.0]
        for (i, p), w in zip(pieces.items(), weight, strict=True):
            at, before = 0, None
            for c in p:
                k = int(self.char[ord(c)])
                if before is not None:
                    self.joins[before, k] = True
                before = k
                if (at * v + k) not in nodes:
                    nodes[at * v + k] = len(self.piece)
                    self.piece.append(-1)
                    logw.append(0.0)
                at = nodes[at * v + k]
            self.piece[at], logw[at] = i, float(w)
        keys = np.array(sorted(nodes), np.int64)
        self.slots = 1 << (8 * len(keys)).bit_length()  # of a table by hash, with linear probing
        self.keys, self.next = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32)
        to, slot = np.array([nodes[k] for k in keys.tolist()], np.int32), self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.next[slot[free]] = keys[free], to[free]  # of several the last stays
            todo = np.flatnonzero(self.keys[slot] != keys)
            keys, to, slot = keys[todo], to[todo], slot[todo] + 1 & self.slots - 1
        self.piece, self.logw = np.array(self.piece, np.int32), np.array(logw)
        raw = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                raw[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
            elif i in pieces:
                raw[i] = pieces[i].replace("▁", " ").encode()
        self.raw = raw
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.concatenate(([0], np.cumsum(self.raw_size)))
        self.raw_data = np.frombuffer(b"".join(raw), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * GOLD >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The trie's next node; 0 if there is none."""
        key = node.astype(np.int64) * self.v + char
        slot = self._slot(key)
        held, out = self.keys.take(slot), self.next.take(slot)
        todo = np.flatnonzero(held != key)
        out[todo] = 0
        todo = todo[held[todo] >= 0]
        while len(todo):
            slot[todo] = at = slot[todo] + 1 & self.slots - 1
            held = self.keys.take(at)
            out[todo] = np.where(held == key[todo], self.next.take(at), 0)
            todo = todo[(held != key[todo]) & (held >= 0)]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts in front goes."""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=4)
def vocabulary(path: str, alpha: float = 1.0) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattice:
    """Edges and their probabilities for flat parts: part i has the characters from start[i] to start[i + 1].

    It is made by levels, which hold the nodes of all parts that have so many characters left, the longest part first: the
    nodes of a level, and those an edge leads to, lie side by side."""

    def __init__(self, voc: Vocabulary, code: np.ndarray, start: np.ndarray) -> None:
        n, size = len(code), np.diff(start)
        char = voc.char.take(code)
        left = np.repeat(start[1:], size) - np.arange(n)  # characters to the part's end
        levels = int(left.max(initial=0))
        turn = np.empty(len(size), np.int64)
        turn[np.argsort(-size, kind="stable")] = np.arange(len(size))
        level = np.concatenate(([0, len(size)], len(size) + np.cumsum(np.bincount(left, minlength=levels + 1)[1:])))
        place = level[left] - len(size) + np.repeat(turn, size)  # of each node; level 0, the ends, isn't counted
        most = max(1, min(voc.longest, levels))
        edge, logw = np.full((most, n), -1, np.int32), np.full((most, n), -np.inf, np.float32)
        at, node = np.arange(n), np.zeros(n, np.int32)
        for k in range(most):
            node = voc.step(node, char.take(at + k))
            keep = np.flatnonzero(node)
            at, node = at.take(keep), node.take(keep)
            piece = voc.piece.take(node)
            good = np.flatnonzero(piece >= 0)
            to = place.take(at.take(good))
            edge[k][to], logw[k][to] = piece.take(good), voc.logw.take(node.take(good))
            more = np.flatnonzero(left.take(at) > k + 1)
            at, node = at.take(more), node.take(more)
            if not len(at):
                break
        while most > 1 and (edge[most - 1] < 0).all():
            most -= 1
        edge, logw = edge[:most], logw[:most]
        own = np.empty(n, np.int64)
        own[place] = code
        alone = np.flatnonzero(edge[0] < 0)  # byte pieces: weight 1
        edge[0, alone] = -2 - own[alone]
        logw[0, alone] = 0.0
        beta, ends = np.zeros(level[-1]), len(size)
        for d in range(1, levels + 1):
            lo, hi, wide = int(level[d]), int(level[d + 1]), min(most, d)
            s = beta.take(level[d - wide : d][::-1, None] + np.arange(hi - lo))
            s += logw[:wide, lo - ends : hi - ends]
            top = s.max(0)
            beta[lo:hi] = top + np.log(np.exp(s - top).sum(0))
            s -= beta[lo:hi]
            logw[:wide, lo - ends : hi - ends] = s
        ok = edge != -1
        single = ok.sum(0, dtype=np.int8) == 1  # the edge of one character is always there
        logw[0, single] = 0.0
        self.left, self.most, self.single, self.place = left, most, single.take(place), place
        self.edge_by, self.logp_by = edge.reshape(-1), logw.reshape(-1)  # edges of one length side by side, by level
        # the last edge takes what is left, so its sum isn't kept
        cum = np.full((max(1, -(-(most - 1) // 8)) * 8, n), 2.0, np.float32)
        np.cumsum(np.exp(logw[: most - 1]), 0, dtype=np.float32, out=cum[: most - 1])
        later = np.zeros(n, bool)
        for k in range(most - 2, -1, -1):
            later |= ok[k + 1]
            np.maximum(cum[k], np.float32(2) * ~later, out=cum[k])  # sums that rounding leaves under 1
        self.cum = np.ascontiguousarray(cum.T).take(place, 0)

    def at(self, node: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Where edges are."""
        return edge * len(self.place) + self.place.take(node)

    def probabilities(self, nodes: np.ndarray) -> np.ndarray:
        """nodes x edges."""
        lp = self.logp_by.reshape(self.most, -1)[:, self.place.take(nodes)]
        return np.exp(np.ascontiguousarray(lp.T).astype(np.float64))


def _log_others(lp: np.ndarray) -> np.ndarray:
    """The log of the probability that all edges of a node but the one of log probability lp have together; 0 is sure."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(np.minimum(lp, 0.0)))


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((mix64(key) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _draw(lat: Lattice, at: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The edge (its length - 1) chosen by a uniform draw."""
    below = lat.cum.take(at, 0) <= r.astype(np.float32)[:, None]
    return np.bitwise_count(below.view(np.uint64)).sum(1, dtype=np.int64)  # eight at once


def _walk(lat: Lattice, part: np.ndarray, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples parts from a node to their end in lockstep: (part index, node, edge) in order of part and step."""
    live, at, k = np.arange(len(part)), start.copy(), 0
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        e = np.zeros(len(at), np.int64)  # the only edge of a node is that of one character
        many = np.flatnonzero(~lat.single.take(at))
        e[many] = _draw(lat, at.take(many), _uniform(key.take(live.take(many)) + np.uint64(k * 0xD1B54A32D192ED03 & (1 << 64) - 1)))
        got.append((live, at, e))
        e = e + 1
        go = np.flatnonzero(lat.left.take(at) > e)
        live, at, k = live.take(go), at.take(go) + e.take(go), k + 1
    if not got:
        z = np.zeros(0, np.int64)
        return z, z, z
    which, node, edge = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(which, kind="stable")
    return which[order], node[order], edge[order]


def _truncated(loc: np.ndarray, top: np.ndarray, r: np.ndarray) -> np.ndarray:
    """A Gumbel draw with a location, given that it doesn't exceed top."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        g = loc - np.log(np.exp(np.minimum(loc - top, 700)) - np.log(r))
    return np.where(np.isneginf(loc), -np.inf, np.minimum(g, top))


def _split(voc: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts (with the space in front), where parts begin, and the first part of each text."""
    code = np.frombuffer("".join(["▁" + t.replace(" ", "▁") if t else "" for t in texts]).encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    char = voc.char[code]
    new = np.ones(len(code), bool)
    if len(code):
        new[1:] = ~voc.joins[char[:-1], char[1:]]
        new[first[:-1][size > 0]] = True
    start = np.flatnonzero(new)
    return code.astype(np.int64), np.append(start, len(code)), np.searchsorted(start, first)


def sample(voc: Vocabulary, texts: list[str], keys: np.ndarray, k: int, seed: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """Per text up to k samples: ids, log probability, log inclusion score; best perturbed value first."""
    n = len(texts)
    code, start, first = _split(voc, texts)
    size = np.diff(start)
    within = np.arange(len(code)) - np.repeat(start[:-1], size)
    h = np.add.reduceat(mix64(code.astype(np.uint64) + within.astype(np.uint64) * GOLD), start[:-1]) if len(size) else np.zeros(0, np.uint64)
    _, pick, kind = np.unique(h, return_index=True, return_inverse=True)
    d_size = size[pick]
    d_start = np.concatenate(([0], np.cumsum(d_size)))
    d_code = code[np.repeat(start[pick] - d_start[:-1], d_size) + np.arange(d_start[-1])]
    lat = Lattice(voc, d_code, d_start)
    root = d_start[kind]  # node of each part
    doc = np.repeat(np.arange(n), np.diff(first))
    place = np.arange(len(kind)) - first[doc]
    base = mix64(keys.astype(np.uint64) * GOLD + np.uint64(seed))

    def key(docs: np.ndarray, places: np.ndarray, j: int, stream: int) -> np.ndarray:
        return (base[docs] + places.astype(np.uint64) * GOLD + np.uint64((j * 64 + stream) * 0xA24BAED4963EE407 & (1 << 64) - 1))

    def scored(which_doc: np.ndarray, node: np.ndarray, edge: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running log probability before each step and of the whole, by text; bounds: first step of each text."""
        lp = lat.logp_by.take(lat.at(node, edge)).astype(np.float64)
        run = np.concatenate(([0.0], np.cumsum(lp)))
        return run[:-1] - run[bounds[which_doc]], lp

    gumbel = -np.log(-np.log(_uniform(key(np.arange(n), np.zeros(n, np.int64), 0, 1))))
    w, node, edge = _walk(lat, kind, root, key(doc, place, 0, 2))
    part = w
    paths, top = [], gumbel
    out: list[list] = [[] for _ in range(n)]
    values: list[list] = [[] for _ in range(n)]
    alive = np.arange(n)  # the texts that this round's path covers
    fork = np.full(n, -1)  # steps up to here are an earlier path's regions
    for j in range(k):
        d = doc[part]
        bounds = np.searchsorted(d, np.arange(n + 1))
        before, lp = scored(d, node, edge, bounds)
        total = np.add.reduceat(np.append(lp, 0.0), np.minimum(bounds[:-1], len(lp))) * (np.diff(bounds) > 0)
        step = np.arange(len(d)) - bounds[d]
        banned = np.int64(1) << edge
        loc = before + _log_others(lp)
        bound = np.full(len(d), -np.inf)
        open_ = np.flatnonzero(~np.isneginf(loc) & (step > fork[d]))
        bound[open_] = _truncated(loc[open_], top[d[open_]], _uniform(key(d[open_], step[open_], j, 3)))
        paths.append([d, node, edge, part, bounds, bound, banned, before, total])
        for i in alive.tolist():
            ids = slice(bounds[i], bounds[i + 1])
            out[i].append((j, ids, total[i]))
            values[i].append(top[i])
        # the best region of each text over all paths
        best, best_path, best_at = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for q, (_, _, _, _, b, u, *_) in enumerate(paths):
            full = np.flatnonzero(np.diff(b))
            if not len(full):
                continue
            m = np.maximum.reduceat(u, b[full])
            at = np.flatnonzero(u == np.repeat(m, np.diff(b)[full]))
            where = np.full(n, -1, np.int64)
            where[paths[q][0][at][::-1]] = at[::-1]
            better = full[m > best[full]]
            best[better], best_path[better], best_at[better] = m[np.searchsorted(full, better)], q, where[better]
        alive = np.flatnonzero(~np.isneginf(best))
        if j == k - 1 or not len(alive):
            break
        parts_, nodes_, edges_ = [], [], []
        fork = np.full(n, -1)
        for q, (dq, nq, eq, pq, bq, uq, banq, befq, _) in enumerate(paths):
            mine = alive[best_path[alive] == q]
            if not len(mine):
                continue
            at = best_at[mine]
            fork[mine] = at - bq[mine]
            # another edge at the fork, in proportion to those not yet taken there
            prob = lat.probabilities(nq[at])
            row = prob * ((banq[at][:, None] >> np.arange(lat.most)) & 1 == 0)
            cum = np.cumsum(row, 1)
            r = _uniform(key(mine, fork[mine], j + 1, 4)) * cum[:, -1]
            other = np.minimum((cum <= r[:, None]).sum(1), row.shape[1] - 1)
            banq[at] |= np.int64(1) << other
            left = np.where((banq[at][:, None] >> np.arange(row.shape[1])) & 1 == 0, prob, 0.0).sum(1)
            left[left < 1e-15] = 0.0
            with np.errstate(divide="ignore"):
                uq[at] = _truncated(befq[at] + np.log(left), best[mine], _uniform(key(mine, fork[mine], j + 1, 5)))
            count = at - bq[mine]
            pre = np.repeat(bq[mine] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            parts_ += [pq[pre], pq[at]]
            nodes_ += [nq[pre], nq[at]]
            edges_ += [eq[pre], other]
            # the rest of the part at the fork, then all later parts
            inner = np.flatnonzero(lat.left[nq[at]] > other + 1)
            later = first[mine + 1] - pq[at] - 1
            tail = np.repeat(pq[at] + 1 - np.concatenate(([0], np.cumsum(later)[:-1])), later) + np.arange(later.sum())
            todo = np.concatenate((pq[at][inner], tail))
            begin = np.concatenate(((nq[at] + other + 1)[inner], root[tail]))
            w, nn, ee = _walk(lat, kind[todo], begin, key(doc[todo], place[todo], j + 1, 2))
            parts_.append(todo[w])
            nodes_.append(nn)
            edges_.append(ee)
        part, node, edge = (np.concatenate(x) for x in (parts_, nodes_, edges_))
        # by part, and within one by node: nodes of a path ascend
        order = np.argsort(part << 32 | node - root[part], kind="stable")
        part, node, edge = part[order], node[order], edge[order]
        top = best
    kappa = best if n else np.zeros(0)
    result: list[list[tuple[np.ndarray, float, float]]] = []
    flat_ids = [_ids(voc, lat.edge_by.take(lat.at(p[1], p[2]))) for p in paths]
    for i in range(n):
        rows = []
        for j, s, total_lp in out[i]:
            ids, edges = flat_ids[j]
            x = total_lp - kappa[i]
            score = 0.0 if np.isneginf(kappa[i]) else float(np.log(-np.expm1(-np.exp(min(x, 700.0))))) if x > -30 else float(x)
            rows.append((ids[edges[s.start] : edges[s.stop]], float(total_lp), score))
        result.append(rows or [(np.zeros(0, np.int32), 0.0, 0.0)])
    return result


def _ids(voc: Vocabulary, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids, and where each edge's ids begin: characters without a piece become their bytes."""
    raw = np.flatnonzero(edge < -1)
    count = np.ones(len(edge), np.int64)
    code = -2 - edge[raw].astype(np.int64)
    count[raw] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    edges = np.concatenate(([0], np.cumsum(count)))
    ids = np.zeros(edges[-1], np.int32)
    ids[edges[:-1][edge >= 0]] = edge[edge >= 0]
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
    n = count[raw]
    for k in range(4):
        has = n > k
        c, m, at = code[has], n[has], edges[raw[has]] + k
        ids[at] = voc.bytes_of[np.where(k == 0, lead[m] | c >> 6 * (m - 1), 0x80 | c >> 6 * np.maximum(m - 1 - k, 0) & 0x3F)]
    return ids, edges


def decoded(voc: Vocabulary, ids: np.ndarray, edges: np.ndarray) -> list[str]:
    """The texts of flat ids; edges: where each text's ids begin. The space that encoding puts in front goes."""
    n = voc.raw_size[ids]
    run = np.concatenate(([0], np.cumsum(n)))
    raw = voc.raw_data[np.repeat((voc.raw_at[ids] - run[:-1]).astype(np.int32), n) + np.arange(run[-1], dtype=np.int32)].tobytes()
    at = run[edges].tolist()
    return [raw[lo + (raw[lo : lo + 1] == b" " and hi > lo) : hi].decode("utf-8", "replace") for lo, hi in zip(at[:-1], at[1:], strict=True)]


SAMPLES = "id long, samples array<struct<ids:array<int>,log_prob:double,log_inclusion:double,text:string>>"


def _encode(path: str, alpha: float, k: int, seed: int, with_text: bool):
    fields = [("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("log_inclusion", pa.float64()), ("text", pa.string())]
    kind = pa.list_(pa.struct(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, last, turn = vocabulary(path, alpha), None, 0
        for whole in batches:
            for b in by_bytes(whole, "body", SLICE):
                names, turns = b.column("id").to_pylist(), []
                for x in names:
                    turn = turn + 1 if x is not None and x == last else 0
                    last = x
                    turns.append(turn)
                keys = np.array([x or 0 for x in names], np.int64) + np.array(turns, np.int64) * TURN
                found = sample(voc, b.column("body").to_pylist(), keys, k, seed)
                flat = [s for rows in found for s in rows]
                offs = np.concatenate(([0], np.cumsum([len(s[0]) for s in flat]))).astype(np.int32)
                ids = np.concatenate([s[0] for s in flat]) if flat else np.zeros(0, np.int32)
                texts = pa.array(decoded(voc, ids, offs), pa.string()) if with_text else pa.nulls(len(flat), pa.string())
                struct = pa.StructArray.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(offs), pa.array(ids, pa.int32())), *(pa.array([s[i] for s in flat], pa.float64()) for i in (1, 2)), texts],
                    fields=list(kind.value_type),
                )
                rows = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(rows), struct)], ["id", "samples"])

    return run


def encode(docs: DataFrame, model: str, k: int = 3, alpha: float = 1.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id and up to k samples (ids, log_prob, log_inclusion) of each text; with_text: and what each decodes to."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), filled(F.col(text_col)).alias("body")).mapInArrow(lean(_encode(model, alpha, k, seed, with_text)), SAMPLES)


def decode(ids: Column, model: str) -> Column:
    """The text of a column of ids; null for null."""

    @F.arrow_udf("string")
    def texts(rows: pa.Array) -> pa.Array:
        voc, out = vocabulary(model), []
        for i in range(0, len(rows), 500):
            part = rows.slice(i, 500)
            count = np.array([x or 0 for x in part.value_lengths().to_pylist()], np.int64)
            found = decoded(voc, part.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(count))))
            out += [x if ok else None for x, ok in zip(found, part.is_valid().to_pylist(), strict=True)]
        return pa.array(out, pa.string())

    return texts(ids)


def encode_best(docs: DataFrame, model: str, **kw) -> DataFrame:
    """One row per document and sample: id, sample (from 0), ids, log_prob, log_inclusion."""
    return encode(docs, model, **kw).select("id", F.posexplode("samples").alias("sample", "s")).select("id", "sample", "s.*").drop(*[] if kw.get("with_text") else ["text"])
