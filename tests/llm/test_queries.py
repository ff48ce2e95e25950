"""The registered queries, all columns, against brute force or their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from crosscut.llm import media, queries

from .test_operators import SCHEMA, odd_rows, words

SF = "/root/testdata/sf0.001"


def rows_of(spark, name, path=SF):
    return queries.QUERIES[name](spark, str(path)).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder whose documents have nulls, empty, long, repeated and near-repeated texts."""
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(odd_rows(40), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["op2_mixing", "op4_lsh_forest", "op6_exact_dedup"])
def test_queries_equal_their_sql(spark, odd, name):
    for path, files in ((SF, f"{SF}/documents.parquet"), (odd, f"{odd}/documents.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
        want = con.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        got = queries.QUERIES[name](spark, str(path))
        assert set(got.columns) == set(columns)
        assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_media_query(spark, texts):
    by_text = defaultdict(set)
    rows = rows_of(spark, "op1_jpeg_media")
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = bytes(media.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        by_text[raw].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_media_with_wide_places(monkeypatch):
    raw = bytes(random.Random(2).randrange(256) for _ in range(5000))
    stored = np.frombuffer(media.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0], np.uint8)
    plain = media.decode(stored, np.array([0, len(stored)]))
    monkeypatch.setattr(media, "WIDE", 0)
    wide = media.decode(stored, np.array([0, len(stored)]))
    assert plain[0][0] == wide[0][0] == "ok" and all((a[2] == b[2]).all() for a, b in zip(plain[0][1], wide[0][1], strict=True))


def test_compaction_query(spark, texts):
    rows = rows_of(spark, "op3_compaction")
    for r in rows:
        text = texts[r.doc_id].encode()
        assert r.n_bytes == len(text) and r.text_sha256 in ([hashlib.sha256(text).hexdigest()] if text else [None, hashlib.sha256(b"").hexdigest()])
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    held = Counter(r.shard for r in rows)
    assert all(r.shard_rows == held[r.shard] for r in rows)


def test_subword_query(spark, texts):
    rows = rows_of(spark, "op7_subword_samples")
    samples = defaultdict(list)
    for r in rows:
        samples[r.doc_id].append(r)
    assert set(samples) == set(texts)
    for i, found in samples.items():
        assert [r.sample for r in sorted(found, key=lambda r: r.sample)] == list(range(len(found))) and 1 <= len(found) <= 2
        assert len({r.ids_hash for r in found}) == len(found)  # without replacement
        assert all(r.log_prob <= 0 and r.log_inclusion <= 0 for r in found)
        assert {r.text_sha256 for r in found} == {hashlib.sha256(texts[i].encode()).hexdigest()}


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = rows_of(spark, "op9_language_id", "/root/testdata/sf0.01")
    assert Counter(r.doc_id for r in rows) == Counter(list(docs))
    learned = {d.lang for d in docs.values() if d.lang and zlib.crc32(str(d.doc_id).encode()) % 4 != 2}
    right = []
    for r in rows:
        text, lang = docs[r.doc_id].text or "", docs[r.doc_id].lang
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred in (learned if re.search(r"[^\W\d_]", text) else {"und"})
        if r.held_out and lang:
            right.append(r.lang_pred == lang)
    assert len(right) > 100 and np.mean(right) > 0.9


def test_token_query(spark, texts):
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    got, start = {r.doc_id: r for r in rows_of(spark, "op10_token_files")}, 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc)
        start += len(ids)
    assert len(got) == len(texts)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """An empty table gives no rows; repeated rows and rows without an id go through all stages."""
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    a, b = words(60, random.Random(1)), words(60, random.Random(2))
    rows = [(None, a, "en", "s", "x", 1), (3, a, "en", "s", "x", 1), (3, a, "en", "s", "x", 1), (None, None, None, None, None, None), (4, b, "en", None, "x", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in out} <= {3, 4} and 3 in {r.doc_id for r in out}
