"""What keeps the costs of the operators' inner loops low."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from crosscut.llm import subword, token_file
from crosscut.llm.common import flat
from crosscut.llm.queries import tokenizer_path


def test_known_words_are_found_without_sorting(monkeypatch):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"]
    data, offs = flat(texts)
    enc = token_file.Encoder(tokenizer_path("word_bpe_49k.json"))
    ids, n = enc.encode(data, offs, 2)

    def sorts(*args, **kw):
        raise AssertionError("known words were sorted")

    monkeypatch.setattr(np, "unique", sorts)
    again, m = enc.encode(data, offs, 2)
    assert (again == ids).all() and (m == n).all()


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_words_are_found_by_hash(bits):
    rng, held, words = np.random.default_rng(bits), {}, token_file.Words()
    for now in range(6):
        key = np.unique(rng.integers(0, 1 << min(bits, 12), 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 if bits == 64 else 1))
        found = words.find(key)
        assert [held.get(k, 0) for k in key.tolist()] == found.tolist()
        new = key[found == 0]
        one = np.ones(len(new), np.int32)
        number = words.add(new, np.full(len(new), 97, np.uint8), one, np.arange(len(new), dtype=np.int32), one, now)
        words.place(number)
        held |= dict(zip(new.tolist(), number.tolist(), strict=True))
    some = min(10, len(held))
    kept = words.last(some, 1 << 20)
    assert kept.n == some and (kept.find(np.array(list(held), np.uint64)) > 0).sum() == some
    assert words.last(some, 4).n == min(some, 4)


def test_cache_of_words_is_bounded_in_bytes():
    """Long words leave the cache by their bytes, and keep their ids."""
    enc, rng = token_file.Encoder(tokenizer_path("word_bpe_49k.json"), cache=100), random.Random(4)
    for _ in range(8):
        texts = ["".join(rng.choices("abcdefgh", k=2000)) for _ in range(10)]
        ids, n = enc.encode(*flat(pa.array(texts)), None)
        assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert enc.words.n_raw <= 100 * token_file.CACHE_BYTES + sum(map(len, texts))


def test_places_of_a_table_are_those_of_a_search():
    ids = np.random.default_rng(2).zipf(1.3, 50_000) % 3000
    prior, _ = token_file._Prior.of(ids)
    at = np.arange(prior.classes << prior.bits)
    assert (prior.held() == np.searchsorted(prior.ends, at, "right") + 1).all()
    few = token_file.pack([1], np.array([len(ids)]), ids)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(token_file, "PLACES", 0)
        assert (token_file.unpack(few)[2] == ids).all()
    assert (token_file.unpack(few)[2] == ids).all()


def test_pieces_are_found_without_search(monkeypatch):
    voc = subword.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    node, char = (x.ravel() for x in np.meshgrid(np.arange(0, len(voc.piece), 97), np.arange(voc.v), indexing="ij"))

    def searches(*args, **kw):
        raise AssertionError("the trie was searched")

    with monkeypatch.context() as m:
        m.setattr(np, "searchsorted", searches)
        got = voc.step(node, char)
    held = dict(zip(voc.keys[voc.keys >= 0].tolist(), voc.next[voc.keys >= 0].tolist(), strict=True))
    assert len(held) == len(voc.piece) - 1
    assert got.tolist() == [held.get(x, 0) for x in (node * voc.v + char).tolist()]


def test_lattice_against_one_part_at_a_time():
    voc, rng = subword.vocabulary(tokenizer_path("piece_bpe_32k.model")), random.Random(7)
    pieces = [p.decode("utf-8", "replace").replace(" ", "\u2581") for p in voc.raw if p]
    parts = ["".join(rng.choices(["in", "the", "on", "\u2581", "x", "\u65e5", "\x01", rng.choice(pieces)], k=rng.randrange(1, 9))) for _ in range(60)] + ["e" * 300]
    code = np.array([ord(c) for p in parts for c in p], np.int64)
    start = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    lat = subword.Lattice(voc, code, start)
    known = dict(zip((p.decode("utf-8", "replace").replace(" ", "\u2581") for p in voc.raw), range(len(voc.raw)), strict=True))
    weight = np.zeros(len(voc.raw))
    weight[voc.piece[voc.piece >= 0]] = voc.logw[voc.piece >= 0]
    known = {p: i for p, i in known.items() if i in set(voc.piece.tolist())}
    for part, lo in zip(parts, start.tolist(), strict=False):
        beta = [0.0] * (len(part) + 1)
        for i in range(len(part) - 1, -1, -1):
            edges = {k: weight[known[part[i : i + k]]] for k in range(1, min(lat.most, len(part) - i) + 1) if part[i : i + k] in known}
            edges.setdefault(1, 0.0)
            beta[i] = np.logaddexp.reduce([w + beta[i + k] for k, w in edges.items()])
            want = np.array([np.exp(edges[k] + beta[i + k] - beta[i]) if k in edges else 0.0 for k in range(1, lat.most + 1)])
            node = np.array([lo + i])
            assert lat.probabilities(node)[0] == pytest.approx(want, abs=2e-6)
            ids = [int(lat.edge_by[lat.at(node, np.array([k - 1]))[0]]) for k in edges]
            assert ids == [known.get(part[i : i + k], -2 - ord(part[i])) for k in edges]
            assert bool(lat.single[lo + i]) == (len(edges) == 1)
