"""The hash tree, vector codes and license scan on odd inputs, against brute force and their SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crosscut.llm import license_scan, merkle, queries, vector_codes

from .test_operators import SCHEMA, odd_rows

SF = "/root/testdata/sf0.001"
DOCS = f"{SCHEMA}, n_chars long, grp string, leaf string"
VECTORS = "vec_id long, embedding array<float>, label int, code string, _label int, v string"


def same_as_sql(spark, path, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet{'/*.parquet' if str(path) != SF else ''}'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, str(path))
    assert set(got.columns) == set(columns)
    rows = sorted(map(tuple, got.select(*columns).collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd3")
    rows = [(*r, None if r[1] is None else len(r[1]), "g", "l") for r in odd_rows(40)]
    spark.createDataFrame([*rows, *rows[:5], (None, *rows[12][1:]), (None, *rows[0][1:]), (7, *rows[12][1:])], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    rng = random.Random(4)
    good = [(i, [rng.uniform(-2, 2) for _ in range(20)], rng.choice((None, 1, 2)), "c", 1, "x") for i in range(-20, 60)]
    bad = [(70, None, 1, "c", 1, "x"), (71, [None] * 20, 1, "c", 1, "x"), (72, [math.nan, *[0.0] * 19], 1, "c", 1, "x"), (73, [math.inf, *[0.0] * 19], 1, "c", 1, "x"), (74, [], 1, "c", 1, "x"), (75, [1.0], 1, "c", 1, "x")]
    huge = [(76, [3e38, *[-3e38] * 19], None, None, None, None)]
    ties = [(None, good[0][1], 1, "c", 1, "x"), (3, good[1][1], 2, "c", 1, "x"), *good[:6]]
    spark.createDataFrame([*good, *bad, *huge, *ties], VECTORS).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_vector_codes", "op13_license_scan"])
def test_queries_equal_their_sql(spark, odd, name):
    for path in (SF, odd):
        rows = same_as_sql(spark, path, name, ("documents", "embeddings"))
        assert rows


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_vector_codes", "op13_license_scan"])
def test_tables_without_rows(spark, tmp_path, name):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def reduced(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


@pytest.mark.parametrize(("fanout", "depth"), [(2, 1), (2, 3), (3, 2), (8, 4)])
def test_tree_of_any_superblock_is_the_plain_tree(spark, fanout, depth):
    groups = {"a": 1, "b": 30, "c": 9, None: 3, "": 2}
    rows = [(i, g, f"t{i}", "clash", "clash") for i, g in enumerate(g for g, n in groups.items() for _ in range(n))]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "id long, grp string, text string, i string, _row string").repartition(4)
    got = {r.id: r for r in merkle.manifest(docs, "id", "grp", ("id", "text"), fanout=fanout, depth=depth).collect()}
    assert len(got) == len(rows)
    leaf = {i: h(f"{len(str(i))}:{i}{len(t)}:{t}") for i, _, t, _, _ in rows}
    trees = {g: reduced([leaf[r[0]] for r in sorted(rows) if r[1] == g], fanout) for g in groups}
    order = sorted(groups, key=lambda g: (g is not None, g or ""))
    top = reduced([trees[g][-1][0] for g in order], fanout)
    for i, g, *_ in rows:
        r, at, others = got[i], sorted(x[0] for x in rows if x[1] == g).index(i), []
        assert (r.leaf, r.subroot, r.root, r.altered, r.grp) == (leaf[i], trees[g][-1][0], top[-1][0], None, g)
        for tree, place in ((trees[g], at), (top, order.index(g))):
            for level in tree[:-1]:
                run = place // fanout * fanout
                others += [x for j, x in enumerate(level[run : run + fanout], run) if j != place]
                place //= fanout
        assert bytes(r.proof).hex() == "".join(others)
        assert merkle.fold(r.leaf, r.proof, r.shape) == r.root != merkle.fold(h("other"), r.proof, r.shape)


def test_any_change_of_a_field_is_found(spark):
    docs = spark.createDataFrame([(1, "x", "Ab"), (2, "x", None), (3, None, "-"), (None, "x", "ÄB")], "id long, grp string, text string")
    rows = merkle.tampered(merkle.manifest(docs, "id", "grp", ("id", "grp", "text"), {"text": merkle.lowered(F.col("text"))}))
    assert {r.id: r.verified for r in rows.collect()} == {1: False, 2: True, 3: True, None: False}
    assert [r[0] for r in docs.select(merkle.lowered(F.col("text"))).collect()] == ["ab", None, "-", "Äb"]


@pytest.mark.parametrize("leaf", [1, 2, 5])
def test_tree_search_is_the_plain_search(leaf):
    rng = np.random.default_rng(leaf)
    for width in (0, 1, 3, 8):
        book = rng.integers(-3, 4, (16, width))
        book[9], book[4] = book[2], book[11]  # equal entries
        x = np.concatenate((rng.integers(-4, 5, (400, width)), book))
        found, best = vector_codes.nearest(vector_codes.build(book, leaf=leaf), book, x)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (found == d.argmin(1)).all() and (best == d.min(1)).all()


def test_codes_decode_to_their_entries(spark, odd):
    rows = spark.read.parquet(f"{odd}/embeddings.parquet")
    vectors = vector_codes.integers(rows, "vec_id", "embedding", "label")
    size, books = vector_codes.learn(vectors, parts=4, entries=8, rounds=2)
    codes = vector_codes.encode(vectors, size, books).withColumn("at", F.monotonically_increasing_id())
    near = {(r.id, r.code, r.error) for r in codes.collect()}
    cuts = vector_codes.bounds(size, 4)
    want = set()
    for r in vectors.collect():
        d = [((np.array(r.v[lo:hi]) - b) ** 2).sum(1) for (lo, hi), b in zip(cuts, books, strict=True)]
        want.add((r.id, bytes(int(x.argmin()) for x in d).hex(), int(sum(x.min() for x in d))))
    assert near == want
    for r in vector_codes.decode(codes, books).limit(5).collect():
        assert r.v == [int(x) for p, b in enumerate(books) for x in b[int(r.code[2 * p : 2 * p + 2], 16)]]


def plain(words, parts):
    """Ends of a template that begins at words[0], by trying everything."""
    ends = {0}
    for p in parts:
        if isinstance(p, str):
            ends = {e + 1 for e in ends if e < len(words) and words[e] == p}
        elif isinstance(p, list):
            ends |= {e + x for e in ends for x in plain(words[e:], p)}
        else:
            ends = {e + n for e in ends for n in range(p[0], p[1] + 1) if e + n <= len(words)}
    return ends


MARKED = (
    license_scan.Template("t1", "x", "a <<beginOptional>> b <<beginOptional>> c <<endOptional>> <<endOptional>> d"),
    license_scan.Template("t2", "y", "a b <<var;name=who;words=0-2>> <<beginOptional>> c <<endOptional>> <<var;words=1-1>> a"),
    license_scan.Template("t3", "x", "<<beginOptional>> the <<endOptional>> averyveryverylongwordofatemplate d"),
    license_scan.Template("t4", "z", "d"),
)


def test_automaton_against_trying_everything(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "the", "averyveryverylongwordofatemplate", "é", "averyveryverylongwordofatemplates"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(i, t, "n", "p") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, None, None, None), (5, "A, B;\nD", "n", "p")], "id long, text string, n_words string, places string")
    got = license_scan.scan(docs, "id", "text", MARKED).collect()
    by_text = {r.id: r for r in got if r.id is not None and (r.id != 5 or r.n_words != 3)}
    for i, t in enumerate(texts):
        words, want = t.split(), []
        for m in MARKED:
            reach = -1
            for j in range(len(words)):
                ends = plain(words[j:], license_scan.parse(m.text)) - {0}
                if ends and j + max(ends) > reach:
                    reach = j + max(ends)
                    want.append((m.name, m.label, j, reach))
        assert by_text[i].n_words == len(words) and sorted(map(tuple, by_text[i].places)) == sorted(want)
    assert [(r.n_words, r.places) for r in got if r.id is None] == [(0, [])]
    assert [[p.template for p in r.places] for r in got if r.id == 5 and r.n_words == 3] == [["t1", "t4"]]


def test_long_texts_are_read_in_blocks(monkeypatch):
    monkeypatch.setattr(license_scan, "BLOCK", 16)
    raw = np.frombuffer(b"under the MIT license" * 3 + b" cc by nc" + b"cc by nc", np.uint8)
    offs = np.array([0, 0, 63, 72, 80, 80])
    auto = license_scan.Automaton(license_scan.BASE)
    ids, begin = license_scan.words(raw, offs, auto.words)
    assert np.diff(begin).tolist() == [1, 11, 4, 4, 1]
    assert auto.places(ids) == [(2, 12, 15), (2, 16, 19)]  # words run on where no blank stands, but not across texts
    raw = np.frombuffer(b"under the MIT license; " * 9, np.uint8)
    ids, begin = license_scan.words(raw, np.array([0, len(raw)]), auto.words)
    assert begin.tolist() == [0, 37] and auto.places(ids) == [(0, i, i + 4) for i in range(0, 36, 4)]


@pytest.mark.parametrize("text", ["<<var;words=0-3>> a", "<<beginOptional>> a", "a <<endOptional>>", "<<beginOptional>> a <<endOptional>>", "<<bold>> a", "a <<var;words=3-1>>"])
def test_bad_templates_are_refused(text):
    with pytest.raises(ValueError, match=r"."):
        license_scan.Automaton((license_scan.Template("bad", "bad", text),))


def test_license_texts(spark):
    fill = {r"<<var;words=1-12>>": "the authors or copyright holders", r"<<var;words=1-14>>": "the copyright holder", "<<beginOptional>>": "", "<<endOptional>>": ""}
    texts = []
    for t in license_scan.TEMPLATES:
        text = t.text
        for k, v in fill.items():
            text = text.replace(k, v)
        texts.append((t.name, text.replace("<<var;words=1-1>>", "7").replace("<<var;words=0-12>>", "").replace("<<var;words=0-14>>", "or").replace("<<var;words=0-6>>", "the").replace("<<var;words=1-10>>", "1999 Jane Doe")))
    docs = spark.createDataFrame([(n, f"Some words. {x.upper()}! More words.") for n, x in texts] + [("broken", texts[3][1].replace("sublicense", "sell"))], "id string, text string")
    found = {r.id: r for r in license_scan.summary(license_scan.scan(docs, "id", "text")).collect()}
    for t in license_scan.TEMPLATES:
        assert t.label in found[t.name].labels.split(",") and 0.5 < found[t.name].score < 1
    assert found["broken"].labels == "" and found["broken"].score == 0


NAMES = ("_id", "_sha", "__src", "__turn", "__path", "__file", "id", "key", "c0", "c1", "body", "grp")


def test_clashing_columns_come_back(spark, tmp_path):
    """Operators that return rows as they are keep all columns, whatever their names."""
    from crosscut.llm import compaction, exact_dedup, langid, lsh_forest, mixing

    rows = [(*r[:4], *(f"{n}{r[0]}" for n in NAMES)) for r in odd_rows(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)).repartition(3).cache()
    whole = set(map(tuple, docs.collect()))
    for name, out in (
        ("mixed", mixing.mixed(docs)),
        ("exact", exact_dedup.drop_exact(docs)),
        ("near", lsh_forest.drop_near(docs, k=5, threshold=80)),
        ("language", langid.keep_identified(docs, langid.fit_on(docs))),
    ):
        found = set(map(tuple, out.collect()))
        assert out.columns == docs.columns and found and found <= whole, name
    store = compaction.Store(spark, str(tmp_path / "store"))
    store.append(docs)
    store.append(docs.limit(5))
    store.compact()
    back = store.read().drop(compaction.SHARD)
    assert back.columns == docs.columns and set(map(tuple, back.collect())) == whole and back.count() == len(rows) + 5
    with pytest.raises(ValueError, match="_metadata"):
        store.append(docs.withColumn("_metadata", F.lit(1)))


def test_a_store_goes_on_after_a_lost_claim(spark, tmp_path):
    import os
    import time

    from crosscut.llm import compaction

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id long, text string")
    store = compaction.Store(spark, str(tmp_path))
    store.append(docs)
    claim = tmp_path / "manifest" / "0000000002.json"
    claim.write_text("")
    with pytest.raises(compaction.Conflict):  # perhaps its writer is at work
        store.append(docs)
    os.utime(claim, (time.time() - 3600,) * 2)
    assert store.append(docs) == 3 and store.compact() == 4 and store.read().count() == 40


def test_merges_follow_a_reference_packer(spark):
    """The plan of merges against a plain packer: tiers, runs of about the target, at most so many shards each."""
    from crosscut.llm import compaction

    def packed(shards, target, final):
        tiers = {}
        for number, size in sorted(shards):
            if size < target:
                tier = 0 if final else int(math.floor(math.log(max(size, 1)) / math.log(compaction.GROWTH) + 1e-9))
                tiers.setdefault(tier, []).append((number, size))
        out = {}
        for own in tiers.values():
            if len(own) < (2 if final else compaction.FAN_IN):
                continue
            runs, before = {}, 0
            for number, size in own:
                runs.setdefault(before // target, []).append(number)
                before += size
            for run in runs.values():
                for i in range(0, len(run), compaction.MAX_FAN_IN):
                    part = run[i : i + compaction.MAX_FAN_IN]
                    if len(part) > 1:
                        out |= dict.fromkeys(part, part[0])
        return out

    rng = random.Random(6)
    for final in (False, True):
        for n in (1, 3, 40, 700):
            shards = [(i + 1, rng.choice((10, 30, 900, 5000, 70_000)) + rng.randrange(5)) for i in range(n)]
            table = spark.createDataFrame([(i, 1, 1, size, 0, 0, f"f{i}") for i, size in shards], compaction.MANIFEST)
            got = {r.shard: r.into for r in compaction.Store.plan(table, 40_000, final).collect()}
            assert got == packed(shards, 40_000, final), (final, n)


def test_passages_of_rows_without_an_id(spark):
    """A paragraph that goes from one row without an id doesn't keep a passage of another such row from being removed."""
    from crosscut.llm import passages

    from .test_operators import words

    rng = random.Random(11)
    para, passage = words(60, rng), words(60, rng)
    first = words(30, rng) + " " + passage + " " + words(30, rng)
    docs = spark.createDataFrame(
        [(None, first), (None, words(20, rng) + "\n" + para), (3, words(80, rng) + "\n" + para), (None, para + "\n" + words(90, rng)), (9, words(33, rng) + " " + passage + " " + words(41, rng))],
        "doc_id long, text string",
    ).repartition(2)
    rows = [r for r in passages.repeats(docs).collect() if r.doc_id == 9]
    assert any(r.removed and r.size > 200 for r in rows)


def slow_language(model, text):
    """The prediction for a text by its definition, one n-gram and one language after the other."""
    from crosscut.llm import langid

    if not any(c.isalpha() for c in text):
        return "und", 0.0
    raw = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode())
    total, count = np.zeros(model.codes.shape[1]), 0
    for i in range(len(raw) - 1):
        if raw[i] == raw[i + 1] == 32:
            continue
        total += model.weights[raw[i] << 8 | raw[i + 1]]
        count += 1
        if i + 2 < len(raw):
            key = (raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32 >> 16
            total += model.weights[langid.CELLS + key]
            count += 1
    margin = total / (count + 6)
    losses = []
    for code in model.codes:
        losses.append(sum(t * math.log1p(math.exp(-langid.SHARPNESS * m * c)) for t, m, c in zip(model.trust, margin, code, strict=True)))
    p = [math.exp(min(losses) - x) for x in losses]
    best = max(range(len(p)), key=lambda i: (p[i], -i))
    return model.langs[best], p[best] / sum(p)


def test_language_query_against_its_definition(spark):
    from crosscut.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_on(docs.filter(~langid.held_out(F.col("doc_id"))))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = queries.QUERIES["op9_language_id"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        lang, score = slow_language(model, texts[r.doc_id])
        assert r.score == pytest.approx(score, abs=1e-6)
        assert r.lang_pred == lang or score < 0.51


def test_words_of_one_hash_keep_their_ids(monkeypatch):
    """Where the hashes of pre-tokens meet, their bytes tell them apart."""
    from tokenizers import Tokenizer

    from crosscut.llm import token_file

    path = queries.tokenizer_path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), random.Random(5)
    texts = [" ".join(rng.choice(["one", "two", "six", "three", "Ünder", "it's", "42", "x,y"]) for _ in range(30)) for _ in range(20)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    for mask in (2**64 - 1, 7, 0):
        monkeypatch.setattr(token_file, "mix64", lambda x, mask=mask: x & np.uint64(mask))
        ids, n = token_file.Encoder(path).encode(data, offs, 2)
        assert ids.tolist() == [i for t in texts for i in (*library.encode(t, add_special_tokens=False).ids, 2)] and n.sum() == len(ids)
