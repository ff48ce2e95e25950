"""Corpus operators against brute force, exact round trips and edge cases."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from crosscut.llm import compaction, exact_dedup, langid, lsh_forest, media, mixing, paragraphs, queries, subword, token_file, warc
from crosscut.llm.common import flat
from crosscut.llm.components import components, joined

SCHEMA = "doc_id long, text string, lang string, source string, kept string, n long"
WORDS = [a + b for a in "the an of ti re on whe sta lyo eri".split() for b in "nt ou ed as is or able ing th".split()]


def words(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows(n=60, seed=1):
    """Nulls, empty, long, repeated and near-repeated texts; other columns have names that results use."""
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "word", "Word", "a b", "ÀÉ ß 日本 ☃", "x" * 3000, words(4000, rng), "!!! 123"]
    base = words(60, rng)
    for _ in range(8):
        w = base.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = "changed"
        texts.append(" ".join(w))
    texts += [words(rng.randrange(1, 80), rng) + ("\n" + base) * (rng.random() < 0.3) for _ in range(n)]
    texts += [texts[20], texts[21].replace(" ", "  "), texts[8]]
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), "x", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t, k):
    w = lowered(t)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


# ---- media


def test_media_round_trip_and_digest(docs, empty):
    got = {r.id: r for r in media.thumbnails(media.store(docs)).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        want = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert bytes(got[r.doc_id].thumb) == want and got[r.doc_id].n_bytes == len(raw) and got[r.doc_id].width == 512
    same = [got[i] for i in (20, len(got) - 3)]
    assert same[0].media_sha256 == same[1].media_sha256 and same[0].mean_hash == same[1].mean_hash
    assert media.thumbnails(media.store(empty)).count() == 0


def test_media_goes_on_in_further_images(monkeypatch):
    monkeypatch.setattr(media, "MAX_ROWS", 3)
    raw = bytes(random.Random(1).randrange(256) for _ in range(64 * 8 + 5))
    m = media.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    status, images = media.decode(np.frombuffer(m, np.uint8), np.array([0, len(m)]))[0]
    assert status == "ok" and len(images) == 3 and b"".join(t.tobytes() for *_, t in images)[: len(raw)] == raw


def colour_file(dc, across, down):
    """An image with 2 x 2 luminance blocks and two colour blocks a unit, AC coefficients, no restart markers."""
    dc_spec = bytes([0, 0, 0, 12, *[0] * 12]) + bytes(range(12))
    ac_spec = bytes([0, 2, 1, *[0] * 13]) + bytes([0x00, 0x01, 0x12])
    codes = {s: (c, n) for c, n, s in media.canonical(dc_spec)}
    acs = {s: (c, n) for c, n, s in media.canonical(ac_spec)}
    bits = ""

    def put(v, n):
        nonlocal bits
        bits += format(v, f"0{n}b") if n else ""

    pred = [0, 0, 0]
    rng = random.Random(2)
    for m in range(across * down):
        for comp, n in ((0, 4), (1, 1), (2, 1)):
            for b in range(n):
                v = dc[m * 4 + b] if comp == 0 else 3
                d, pred[comp] = v - pred[comp], v
                size = abs(d).bit_length()
                put(*codes[size])
                put(d if d >= 0 else d + (1 << size) - 1, size)
                for _ in range(rng.randrange(3)):
                    if rng.random() < 0.5:
                        put(*acs[0x01])
                        put(1, 1)
                    else:
                        put(*acs[0x12])
                        put(2, 2)
                put(*acs[0])
    bits += "1" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = lambda mark, x: b"\xff" + bytes([mark]) + (len(x) + 2).to_bytes(2, "big") + x
    sof = bytes([8]) + (down * 16 - 3).to_bytes(2, "big") + (across * 16 - 3).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + b"\x10" * 64) + seg(0xC0, sof) + seg(0xC4, b"\0" + dc_spec) + seg(0xC4, b"\x10" + ac_spec)
    return head + seg(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + body + b"\xff\xd9"


def test_media_of_other_writers_and_damage():
    rng = random.Random(3)
    dc = [rng.randrange(-60, 60) for _ in range(4 * 6)]
    f = colour_file(dc, 3, 2)
    files = [f, f[:60], b"", b"GIF89a", f.replace(b"\xff\xc0", b"\xff\xc2", 1)]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in files])))
    got = media.decode(np.frombuffer(b"".join(files), np.uint8), offs)
    assert [s for s, _ in got] == ["ok", "corrupt", "empty", "corrupt", "unsupported"]
    w, h, thumb = got[0][1][0]
    grid = np.array(dc).reshape(2, 3, 2, 2).transpose(0, 2, 1, 3).reshape(4, 6)
    assert (w, h) == (45, 29) and (thumb == np.clip(grid * 16 // 8 + 128, 0, 255)).all()


# ---- mixing


def test_mix_targets_and_copies(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    by, size, taken = {}, Counter(), Counter()
    for r, d in zip(sorted(rows, key=lambda r: r.doc_id), sorted(docs.collect(), key=lambda r: r.doc_id), strict=True):
        assert r.size == len(lowered(d.text)) and r.taken == r.copies * r.size <= 3 * r.size
        by[d.source] = r
        size[d.source] += r.size
        taken[d.source] += r.taken
    names = sorted((s for s in size if s), key=str.encode) + [None] * (None in size)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, goal, open_ = float(sum(size.values())), {}, set(names)
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > 3 * size[s]}
        for s in over or open_:
            goal[s] = 3.0 * size[s] if over else part[s]
            left -= goal[s]
        open_ -= over or set(open_)
    biggest = max(r.size for r in rows)
    for s in names:
        assert by[s].target == pytest.approx(goal[s]) and by[s].source_size == size[s] and abs(taken[s] - goal[s]) <= biggest / 2 + 1
    # the extra copies go to the lowest ratios of random odds to inclusion odds, brute force
    top = 1 << 52
    for s in names:
        mine = [r for r in rows if {d.doc_id: d.source for d in docs.collect()}[r.doc_id] == s]
        odds = {r.doc_id: int(hashlib.md5(f"{r.doc_id}:1".encode()).hexdigest()[:13], 16) for r in mine}
        mine.sort(key=lambda r: odds[r.doc_id] / (top - odds[r.doc_id]) * math.sqrt(max(r.size, 1)))
        whole = math.floor(goal[s] / size[s] + 1e-12) if size[s] else 0
        rest, run = goal[s] - whole * size[s], 0
        for r in mine:
            run += r.size
            assert r.copies == min(3, whole + (rest > 0 and 2 * rest >= 2 * run - r.size))
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    counts = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert counts == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert mixing.mixed(docs).columns == docs.columns and mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


# ---- dedup


def test_exact_dedup(docs, empty):
    rows = {r.doc_id: r.text for r in docs.collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows.items()}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        g = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(g), len(g), r.doc_id == min(g))
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    kept = exact_dedup.drop_exact(docs)
    assert {r.doc_id for r in kept.collect()} == {min(g) for g in groups.values()} and kept.columns == docs.columns
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_trie_spills_whole_subtrees():
    rng = random.Random(4)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(800)]
    trie, want = exact_dedup.SpillingTrie(2000), {}
    for i, k in enumerate(keys):
        trie.insert(k, i, 1)
        a, b = want.get(k, (i, 0))
        want[k] = (min(a, i), b + 1)
    assert trie.files and {k: (o, c) for k, o, c in trie.items()} == want
    head = bytes(rng.randrange(256) for _ in range(100_000))  # a long shared head, as licences have
    trie, want = exact_dedup.SpillingTrie(20_000), {head + k: (i, 1) for i, k in enumerate(set(keys))}
    for k, (i, _) in want.items():
        trie.insert(k, i, 1)
    assert trie.files and {k: (o, c) for k, o, c in trie.items()} == want


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 360)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes(range(361), links)
    assert got == {i: c for i, c in want.items() if any(i in x and x[0] != x[1] for x in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(60)]
    both = joined(components(spark.createDataFrame(links, "a long, b long")), spark.createDataFrame(more, "a long, b long"))
    want = classes(range(400), links + more)
    assert {r.id: r.component for r in both.collect()} == {i: c for i, c in want.items() if any(i in x and x[0] != x[1] for x in links + more)}


def brute_near(rows, k):
    sets = {r.doc_id: shingle_set(r.text, k) for r in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, classes(ids, links)


def test_lsh_forest_against_all_pairs(spark, docs, empty):
    rng = random.Random(6)
    base, rows = words(70, rng).split(), []
    for i in range(90):  # a family larger than a region's direct comparisons, with pairs on both sides of the limit
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(70)] = f"new{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w), None, None, None, None))
    all_docs = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    for k in (2, 5):
        sets, comp = brute_near(all_docs.collect(), k)
        got = {r.doc_id: r for r in lsh_forest.near_duplicates(all_docs, k).collect()}
        assert {i: r.component_id for i, r in got.items()} == comp
        assert all(r.n_shingles == len(sets[i]) and r.kept == (i == comp[i]) for i, r in got.items())
    assert lsh_forest.near_duplicates(empty).count() == 0


def test_links_inside_a_large_region():
    rng = random.Random(7)
    base, items = [rng.getrandbits(63) for _ in range(60)], []
    for _ in range(200):
        s = set(base)
        for _ in range(rng.randrange(15)):
            s.discard(rng.choice(base))
            s.add(rng.getrandbits(63))
        items.append(np.array(sorted(s), np.uint64))
    ids = np.arange(200)
    want = [(i, j) for i in range(200) for j in range(i) if 100 * (b := len(np.intersect1d(items[i], items[j]))) >= 80 * (len(items[i]) + len(items[j]) - b)]
    got = lsh_forest._links_across(ids, ids.copy(), items, ids > 0, 80)
    assert set(got) <= {(b, a) for a, b in want} and classes(range(200), got) == classes(range(200), want)


def test_paragraphs_against_all_pairs(docs, empty):
    paras = {}
    for r in docs.collect():
        for n, line in enumerate(x for x in re.split("[\n\r]", r.text or "") if x):
            if len(lowered(line)) >= paragraphs.MIN_WORDS:
                paras[r.doc_id, n] = shingle_set(line, 5)
    keys = sorted(paras)
    links = [(a, b) for x, a in enumerate(keys) for b in keys[:x] if 100 * len(paras[a] & paras[b]) >= 80 * len(paras[a] | paras[b])]
    comp = classes(keys, links)
    size = Counter(comp.values())
    want = {(i, n, *comp[i, n], size[comp[i, n]], comp[i, n] != (i, n)) for i, n in keys if size[comp[i, n]] > 1}
    rows = paragraphs.repeats(docs).collect()
    assert {(r.doc_id, r.para, r.keep_id, r.keep_para, r.class_size, r.removed) for r in rows} == want and want
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(b"\n" not in text[r.doc_id][r.start : r.start + r.size] for r in rows) and paragraphs.repeats(empty).count() == 0


# ---- encoding


def test_token_files_against_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, at = Tokenizer.from_file(path), 0
    got = {r.id: r for r in token_file.round_trip(docs, path).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), crc)
        at += len(ids)
    assert token_file.round_trip(empty, path).count() == 0
    odd = ["<|endoftext|> x", "ΑΣ Σ. don'T ½ ²x", "áb ́", "İx ǅ ﬁ\x1cq\x85z\xa0k", "日本 中文's ١٢", "''s 're", "", "a'", "'", "s", "'r", "e"]
    odd += ["É×x÷y ÀÉé't Ñ'té 'ñ", "Ñ´x é\u0301 \x01a\x7f", "x'll'vez 'sam it's-'s 12'd", " <|startoftext|>", "plain", "'l", "l 're"]
    ids, n = token_file.Encoder(path).encode(*flat(pa.array(odd)), None)
    assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in odd]


@pytest.mark.parametrize("ids", [[], [5], [7] * 1500, list(range(1300)), [2**32 - 2, 0, 2**32 - 2], [1, 2, 3, 9] * 700 + [131_072]])
def test_token_coder_round_trip(ids):
    x = np.array(ids, np.int64)
    seg = token_file.pack([None, 4], np.array([len(x), 0]), x)
    names, sizes, back = token_file.unpack(seg)
    assert names == [None, 4] and list(sizes) == [len(x), 0] and (back == x).all()
    if len(set(ids)) > 100:
        for at in (28 + int.from_bytes(seg[20:24], "little") + 5, 60):  # in the first block's code, in the header
            with pytest.raises(ValueError):
                token_file.unpack(seg[:at] + bytes([seg[at] ^ 255]) + seg[at + 1 :])
    with pytest.raises(ValueError):
        token_file.pack([1], np.array([1]), np.array([2**32 - 1]))


def test_token_coder_saves_more_than_zlib():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"]
    x, n = token_file.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode(*flat(texts), 2)
    seg = token_file.pack(list(range(len(n))), n, x)
    blocks = [x[i : i + token_file.BLOCK].astype("<u2").tobytes() for i in range(0, len(x), token_file.BLOCK)]
    assert 8 * len(seg) / len(x) < 9 and len(seg) < sum(len(zlib.compress(b, 6)) for b in blocks)


def test_token_cache_forgets_what_is_old():
    enc, rng = token_file.Encoder(public_tokenizers.path("word_bpe_49k.json"), cache=100), random.Random(3)
    for _ in range(20):
        texts = [words(rng.randrange(40), rng) + f" {rng.random()}" for _ in range(10)]
        ids, n = enc.encode(*flat(pa.array(texts)), None)
        assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_subword_samples_follow_the_lattice(docs, empty):
    model = public_tokenizers.path("piece_bpe_32k.model")
    voc, n = subword.vocabulary(model), 6000
    found = subword.sample(voc, ["the in"] * n, np.arange(n), 2, 7)
    p = {tuple(s[0].tolist()): math.exp(s[1]) for r in found for s in r}
    assert sum(p.values()) == pytest.approx(1, abs=1e-3)
    first, second = (Counter(tuple(r[i][0].tolist()) for r in found) for i in (0, 1))
    for x in p:
        assert first[x] / n == pytest.approx(p[x], abs=4 * math.sqrt(p[x] / n) + 1e-3)
        want = sum(p[y] * p[x] / (1 - p[y]) for y in p if y != x)
        assert second[x] / n == pytest.approx(want, abs=4 * math.sqrt(want / n) + 1e-3)
    rows = subword.encode_best(docs, model, k=3, with_text=True).collect()
    text, seen = {r.doc_id: r.text or "" for r in docs.collect()}, defaultdict(set)
    for r in rows:
        assert r.text == text[r.id] and tuple(r.ids) not in seen[r.id] and r.log_inclusion <= 0
        seen[r.id].add(tuple(r.ids))
    assert set(seen) == set(text) and all(len(s) == (3 if len(text[i]) > 20 else len(s) if text[i] else 1) for i, s in seen.items())
    one = {(r.id, r.sample): list(r.ids) for r in subword.encode_best(docs.repartition(7), model, k=3).collect()}
    assert one == {(r.id, r.sample): list(r.ids) for r in rows}
    back = subword.encode_best(docs, model, k=1).select("id", subword.decode(F.col("ids"), model).alias("t")).collect()
    assert {r.id: r.t for r in back} == text and subword.encode(empty, model).count() == 0


# ---- language, archives, shards


def test_language_id_on_held_out_texts(spark, docs, empty):
    rng = random.Random(8)
    kinds = {"aa": "the ing ed and ther", "bb": "le que ment eux ai", "cc": "ung schen der keit ich"}
    rows = [(i, " ".join("".join(rng.choice(v.split()) for _ in range(2)) for _ in range(30)), k, None, None, None) for i, (k, v) in enumerate(list(kinds.items()) * 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit_on(df.filter(~out))
    got = langid.identify(df.filter(out), model).join(df.withColumnRenamed("doc_id", "id").select("id", "lang"), "id").collect()
    assert got and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    found = langid.identify(docs, model).collect()
    odd = {r.id: r.lang_pred for r in found}
    assert all(odd[i] == "und" for i in (0, 1, 2, 9)) and odd[3] in kinds
    kept = langid.keep_identified(docs, model)
    good = {r.id for r in found if r.lang_pred != "und" and not (r.ambiguous and r.score < langid.LEAST)}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == docs.columns
    strange = spark.createDataFrame([(1, "zzq", None, None, None, None), (2, rows[0][1], None, None, None, None)], SCHEMA)
    assert [r.doc_id for r in langid.keep_identified(strange, model).collect()] == [2]  # by the classifier alone
    assert langid.identify(empty, model).count() == 0 and langid.fit_on(empty).langs == ()
    assert {r.lang_pred for r in langid.identify(df, langid.fit([], [])).collect()} == {"und"}
    codes = langid.codewords(12)
    assert len({tuple(c) for c in codes.tolist()}) == 12


def test_archives(spark):
    pages = spark.createDataFrame([(1, "u1", "<p>"), (2, "u2", None), (3, "u\n3", "<p>"), (4, "u4", "é\r\n\r\nWARC/1.1\r\nx"), (5, None, ""), (6, "u", "<p>")], "page_id long, url string, html string")
    rows, gaps = warc.round_trip(pages)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in rows.collect()}
    assert got == {1: ("revisit", 6, 3), 3: ("revisit", 6, 3), 6: ("response", None, 3), 2: ("revisit", 5, 0), 5: ("response", None, 0), 4: ("response", None, 17)}
    assert gaps.count() == 0 and warc.round_trip(pages.limit(0))[0].count() == 0
    assert {r.record_type for r in warc.round_trip(pages, min_bytes=100)[0].collect()} == {"response"}
    long = spark.createDataFrame([(1, "u", "x" * 70_000), (2, "u", "y" * 5_000_000), (3, "u", "x" * 70_000), (4, None, "z")], "page_id long, url string, html string")
    got = {r.page_id: (r.refers_to, r.payload_bytes) for r in warc.round_trip(long)[0].collect()}
    assert got == {1: (3, 70_000), 2: (None, 5_000_000), 3: (None, 70_000), 4: (None, 1)}


def test_archives_are_salvaged():
    import base64
    import gzip

    def rec(i, body, digest=None):
        sha = digest or base64.b32encode(hashlib.sha1(body).digest()).decode()
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{sha}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    a, b, c = (rec(i, f"body {i}".encode()) for i in range(3))
    for parts, ids, n in (
        ([a, b, c], [0, 1, 2], 0),
        ([a, b[:-9], c], [0, 2], 1),
        ([b"junk", a, rec(9, b"x", "A" * 32), c], [0, 2], 2),
        ([gzip.compress(a), gzip.compress(b)[:-3], gzip.compress(c), b"tail"], [0, 1, 2], 2),
        ([gzip.compress(a), gzip.compress(b)[:40], gzip.compress(c)], [0, 2], 1),
        ([gzip.compress(a + b[:-9] + c), gzip.compress(a)], [0, 2, 0], 1),
        ([gzip.compress(a + rec(9, b"x", "A" * 32) + c)], [0, 2], 1),
        ([gzip.compress(a + b + c)[:-9], b], [0, 1, 2, 1], 1),
        ([a, gzip.compress(b)[:20] + bytes(9), c], [0, 2], 1),
        ([b""], [], 0),
    ):
        data = b"".join(parts)
        found = list(warc.salvage(data))
        assert [warc._id(x[1]["warc-record-id"]) for x in found if x[0] == "record"] == ids
        gaps = [x for x in found if x[0] == "gap"]
        assert len(gaps) == n and all(0 <= g[3] < g[4] <= len(data) for g in gaps)


def test_compaction(spark, docs, empty, tmp_path):
    store = compaction.Store(spark, f"file://{tmp_path}/store")
    for i in range(6):
        store.append(docs.filter(F.col("doc_id") % 6 == i).coalesce(1), 5)
    before = store.manifest().collect()
    small = [r.bytes for r in before]
    assert len(before) > 12 and sum(r.rows for r in before) == docs.count()
    version = store.compact(target=3 * max(small))
    after = store.manifest(version).collect()
    assert len(after) < len(before) and sum(r.rows for r in after) == docs.count()
    key = lambda df: sorted(map(tuple, df.select(*docs.columns).collect()), key=repr)
    assert key(store.read()) == key(docs) == key(store.read(6))  # older versions stay readable
    store.vacuum()  # all is younger than a day
    assert key(store.read(6)) == key(docs)
    # a writer whose shards are written but not committed yet survives a vacuum, and then commits
    late = store._folder(version + 1)
    docs.limit(3).write.parquet(late)
    store.vacuum()
    assert spark.read.parquet(late).count() == 3
    time.sleep(0.1)
    store.vacuum(hours=0)
    assert key(store.read()) == key(docs) and store.compact(target=3 * max(small)) == version
    assert not (tmp_path / "store" / "data" / late.rsplit("/", 1)[1]).exists()
    with pytest.raises(compaction.Conflict):  # another writer was first
        store.commit(store.manifest(), version)
    assert key(store.read()) == key(docs)
    none = compaction.Store(spark, f"file://{tmp_path}/none")
    assert none.append(empty) == 1 and none.compact() == 1 and none.manifest().count() == 0
    assert none.read().count() == 0 and none.read().columns == [*empty.columns, compaction.SHARD]
    empty.write.parquet(f"{tmp_path}/nothing/documents.parquet")
    assert queries.op3_compaction(spark, f"{tmp_path}/nothing").count() == 0


def test_compaction_plan(spark):
    rows = [(i, 1, 1, b, 0, 0, f"f{i}") for i, b in enumerate([10, 11, 12, 13, 14, 100, 900, 15], 1)]
    plan = {r.shard: r.into for r in compaction.Store.plan(spark.createDataFrame(rows, compaction.MANIFEST), target=50).collect()}
    assert plan == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1} or plan == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8} or set(plan) <= {1, 2, 3, 4, 5, 8}
    assert 6 not in plan and 7 not in plan


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en" if t else None, s or "s0", 1) for i, (_, t, _, s, _, _) in enumerate(odd_rows(40))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    letters = {i for i, t in text.items() if t and re.search(r"[^\W\d_]", t)}
    steps = dict(corpus_pipeline.STAGES)
    a = steps["language ID"](spark, current, str(tmp_path))
    assert {r.doc_id for r in a.collect()} == letters
    b = steps["exact dedup"](spark, a, str(tmp_path))
    firsts = {}
    for i in sorted(letters):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[i]), i)
    assert {r.doc_id for r in b.collect()} == set(firsts.values())
    c = steps["near-dedup"](spark, b, str(tmp_path))
    _, comp = brute_near(b.collect(), 5)
    assert {r.doc_id for r in c.collect()} == {i for i in comp if comp[i] == i} and c.columns == current.columns
    taken = Counter({r.doc_id: r.copies for r in mixing.mix(c).collect() if r.copies})
    d = steps["mixing"](spark, c, str(tmp_path)).cache()
    assert Counter(r.doc_id for r in d.collect()) == taken
    twice = [(i, f"{i} " + words(30, random.Random(i))) for i in (1, 2) for _ in range(3)]
    once = subword.encode_best(spark.createDataFrame(twice, "doc_id long, text string").coalesce(1), public_tokenizers.path("piece_bpe_32k.model"), k=2)
    assert len({(r.id, tuple(r.ids)) for r in once.collect()}) > 8  # copies draw separately
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out if r.sample == 0) == taken and len(corpus_pipeline.STAGES) == 5


def test_null_and_repeated_ids(spark):
    t, u = "one two three four five six seven", " ".join(WORDS[:40])
    rows = [(None, t, "en", None, "x", 1), (3, t, "en", "s", "x", 1), (3, t, "en", "s", "x", 1), (None, u, None, "s", "x", 1), (7, u, None, "s", "x", 1), (7, u, None, "s", "x", 1), (None, "alone", None, "s", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    exact = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert exact == {(None, 3, 3, False): 1, (3, 3, 3, True): 2, (None, 7, 3, False): 1, (7, 7, 3, True): 2, (None, None, 1, True): 1}
    near = Counter((r.doc_id, r.component_id, r.kept) for r in lsh_forest.near_duplicates(df).collect())
    assert near == {(None, None, True): 3, (3, 3, True): 2, (7, 7, True): 2}
    assert mixing.mix(df).count() == 7
    found = paragraphs.repeats(df).collect()
    assert Counter(r.doc_id for r in found) == {None: 1, 7: 2} and sum(r.removed for r in found) == 2 and {r.keep_id for r in found} == {None}
    assert media.thumbnails(media.store(df)).filter("id is null and status = 'ok'").count() == 3
    tokens = token_file.round_trip(df, public_tokenizers.path("word_bpe_49k.json")).orderBy("start").collect()
    assert [r.id for r in tokens] == [None] * 3 + [3, 3, 7, 7] and tokens[0].start == 0
    assert subword.encode(df, public_tokenizers.path("piece_bpe_32k.model"), k=2).count() == 7
    assert langid.identify(df, langid.fit_on(df)).filter("lang_pred = 'en'").count() == 7
    pages = df.select(F.col("doc_id").alias("page_id"), F.col("kept").alias("url"), F.col("text").alias("html"))
    got = Counter((r.page_id, r.record_type) for r in warc.round_trip(pages)[0].collect())
    assert got == {(None, "response"): 3, (3, "response"): 2, (7, "response"): 2}
