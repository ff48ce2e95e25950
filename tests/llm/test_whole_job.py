"""Parts of the operators' jobs that a review found missing."""

import random
from collections import defaultdict

from crosscut.llm import exact_dedup, passages, queries

from .test_operators import SCHEMA, lowered, odd_rows, words


def registered(spark, tmp_path, name, rows, schema=SCHEMA, of="documents"):
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / f"{of}.parquet"))
    return queries.QUERIES[name](spark, str(tmp_path)).collect()


def test_short_lines_join_to_paragraphs(spark, tmp_path):
    rng = random.Random(5)
    lines = [words(6, rng) for _ in range(7)]
    texts = ["\n".join(lines), words(30, rng) + "\n" + "\r\n".join(lines) + "\n" + words(30, rng), "\n".join(words(6, rng) for _ in range(7))]
    rows = registered(spark, tmp_path, "op5_paragraph_dedup", [(i, t, "en", "s", "x", 1) for i, t in enumerate(texts)])
    assert sorted((r.doc_id, r.para, r.keep_doc_id, r.keep_para, r.class_size, r.removed) for r in rows) == [(0, 0, 0, 0, 2, False), (1, 1, 0, 0, 2, True)]
    assert all(texts[r.doc_id].encode()[r.start : r.start + r.size].split() == " ".join(lines).encode().split() for r in rows)


def test_passages_against_all_windows(spark):
    rng = random.Random(8)
    shared = [words(n, rng) for n in (51, 39, 60, 140)]
    rows = odd_rows(40)
    for i, p in enumerate([*shared, *shared, shared[2].upper(), shared[3].replace(" ", "\n")]):
        rows.append((1000 + i, words(40, rng) + " " + p + "\r\n" + words(40, rng), "en", "s", "x", 1))
    rows += [(2000, shared[3] + " " + words(70, rng), "en", "s", "x", 1), (2000, "another text of this id", "en", "s", "x", 1)]
    text = {r[0]: r[1] or "" for r in rows if r[1] != "another text of this id"}

    def places(k):
        found = defaultdict(list)
        for i, t in sorted(text.items()):
            w = lowered(t)
            for s in range(len(w) - k + 1):
                found[tuple(w[s : s + k])].append((i, s))
        return {w: p for w, p in found.items() if len(p) > 1}

    allowed, first = defaultdict(set), {}
    for w, found in places(passages.K).items():
        for i, s in found:
            allowed[i].update(range(s, s + passages.K))
            first[i, s] = found[0]
    got, removed = defaultdict(set), defaultdict(set)
    for r in passages.passages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        raw = text[r.doc_id].encode()
        before, span = len(raw[: r.start].split()), len(raw[r.start : r.start + r.size].split())
        got[r.doc_id].update(range(before, before + span))
        if r.removed and r.keep_id != r.doc_id:
            removed[r.doc_id].update(range(before, before + span))
            kept = text[r.keep_id].encode()[r.keep_start : r.keep_start + r.keep_size].decode()
            assert set(lowered(raw[r.start : r.start + r.size].decode())) <= set(lowered(kept))
        assert r.para == max(0, len([x for x in raw[: r.start + 1].replace(b"\r", b"\n").split(b"\n") if x]) - 1)
    assert all(got[i] <= allowed[i] for i in got) and 1005 not in got
    for found in places(passages.SPAN).values():  # each shared window of SPAN words holds a whole run that is found
        for i, s in found:
            assert any(set(range(j, j + passages.K)) <= got[i] for j in range(s, s + passages.SPAN - passages.K + 1))
    assert {1004, 1006, 1007, 1008, 1009, 2000} <= set(removed)


def test_passage_within_longer_lines(spark, tmp_path):
    rng = random.Random(9)
    p = words(60, rng)
    texts = [words(90, rng) + " " + p + " " + words(90, rng), words(70, rng) + " " + p.replace(" ", "\n", 1) + " " + words(99, rng), words(200, rng)]
    rows = registered(spark, tmp_path, "op5_paragraph_dedup", [(i, t, "en", "s", "x", 1) for i, t in enumerate(texts)])
    found = {(r.doc_id, r.keep_doc_id, r.removed): texts[r.doc_id].encode()[r.start : r.start + r.size].decode().split() for r in rows}
    assert set(found) == {(0, 0, False), (1, 0, True)}
    for got in found.values():  # whole runs: up to 11 words at either end are left
        assert " ".join(got) in p and len(got) >= len(p.split()) - 2 * (passages.SPAN - passages.K)


def test_drop_exact_decides_by_row(spark):
    rows = [(3, "one text"), (5, "one  text"), (5, "alone"), (None, "one text"), (None, None), (7, "twin"), (7, "twin"), (9, "twin"), (None, "b"), (None, "b")]
    df = spark.createDataFrame([(i, t, "en", "s", "x", 1) for i, t in rows], SCHEMA).repartition(3)
    kept = exact_dedup.drop_exact(df)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "b"), (3, "one text"), (5, "alone"), (7, "twin")]
    assert kept.columns == df.columns
