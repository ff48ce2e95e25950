"""The opN queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compaction, exact_dedup, langid, license_scan, lsh_forest, media, merkle, mixing, passages, sql, subword, token_file, vector_codes, warc
from .common import saved, scratch, table

#: op3 stores its table in so many arrivals, by a hash of the id.
ARRIVALS = 4


def op1_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images are written to the shared folder and read back from there."""
    read = media.thumbnails(saved(media.store(table(spark, sf_dir, "documents")), "media", "zstd"))
    return read.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length("thumb").cast("long").alias("payload_bytes"),
        F.sha2("thumb", 256).alias("payload_sha256"),
        F.crc32(F.substring("thumb", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "mean_hash").alias("feature"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of the compacted store: its shard, that shard's rows, bytes of the stored text and their hash.

    The documents come in `ARRIVALS` arrivals, each a version of its own."""
    store = compaction.Store(spark, scratch(spark, "store"))
    docs = table(spark, sf_dir, "documents")
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))
    for i in range(ARRIVALS):
        store.append(docs.filter(arrival == i))
    version = store.compact()
    store.vacuum()
    shards = store.manifest(version).select(F.col("shard").alias("_n"), F.col("rows").alias("shard_rows"))
    rows = store.read(version)
    return rows.join(shards, rows[compaction.SHARD] == F.col("_n")).select(
        "doc_id",
        F.col(compaction.SHARD).alias("shard"),
        "shard_rows",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), k=2, threshold=80)


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents")).withColumnRenamed("keep_id", "keep_doc_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit_on(docs.filter(~out))
    return langid.identify(docs, model, flag=out).select(
        F.col("id").alias("doc_id"), F.col("flag").alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_file.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end=2)
    return docs.withColumnRenamed("id", "doc_id")


def op7_subword_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    rows = subword.encode_best(table(spark, sf_dir, "documents"), model, k=2, with_text=True)
    return rows.select(
        F.col("id").alias("doc_id"),
        "sample",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        "log_prob",
        "log_inclusion",
        F.sha2("text", 256).alias("text_sha256"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering lower-cases the texts of a third of the ids."""
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    rows = merkle.manifest(docs, "doc_id", "lang", fields, {"text": merkle.lowered(F.col("text"))}, third)
    rows = merkle.tampered(rows.withColumn("proof_sha256", merkle.proof_digest(F.col("proof"))))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_codes.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return rows.withColumnRenamed("id", "vec_id").drop("label")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    return license_scan.summary(found).withColumnRenamed("id", "doc_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jpeg_media": op1_jpeg_media,
    "op2_mixing": op2_mixing,
    "op3_compaction": op3_compaction,
    "op4_lsh_forest": op4_lsh_forest,
    "op5_paragraph_dedup": op5_paragraph_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_subword_samples": op7_subword_samples,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_token_files": op10_token_files,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_vector_codes": op12_vector_codes,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": sql.MERKLE,
    "op12_vector_codes": sql.VECTOR_CODES,
    "op13_license_scan": sql.LICENSE_SCAN,
    "op2_mixing": r"""
WITH d0 AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR || ':1'), 1, 13))::BIGINT AS v
  FROM documents),
d1 AS (SELECT doc_id, source, size, v::DOUBLE / (4503599627370496 - v)::DOUBLE / (16.0::DOUBLE / sqrt(greatest(size, 1)::DOUBLE)) AS ratio FROM d0),
d AS (SELECT doc_id, source, size, least(floor(ratio / (ratio + 1.0::DOUBLE) * 4503599627370496.0::DOUBLE)::BIGINT, 4503599627370495) AS u FROM d1),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
k AS (SELECT *, cap / w AS ratio,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, ratio) AS level FROM k WHERE level <= ratio),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM f) * w, cap)) AS target FROM k),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM t),
h AS (SELECT *, greatest(0.0, target - whole * source_size) AS rest FROM g),
r AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM d),
o AS (SELECT r.*, h.source_size, h.target, least(h.whole + CASE WHEN h.rest > 0 AND 2 * h.rest >= 2 * r.run - r.size THEN 1 ELSE 0 END, 3)::INTEGER AS copies
      FROM r JOIN h ON r.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM o
""",
    "op4_lsh_forest": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN w
                      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM t),
n AS (SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(list_sort(s), chr(10))) AS f, s FROM s),
r AS (SELECT min(doc_id) AS rep, n, f, arg_min(s, doc_id) AS s FROM n WHERE n > 0 GROUP BY n, f),
u AS (SELECT rep, n, unnest(s) AS x FROM r),
o AS (SELECT rep, n, x, row_number() OVER (PARTITION BY rep ORDER BY c, x) AS place FROM (SELECT *, count(*) OVER (PARTITION BY x) AS c FROM u)),
h AS (SELECT * FROM o WHERE 100 * (place - 1) <= 20 * n),
p AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM h a JOIN h b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM (SELECT p.a, p.b, any_value(y.n) AS na, any_value(z.n) AS nb, count(*) AS k
      FROM p JOIN u y ON y.rep = p.a JOIN u z ON z.rep = p.b AND z.x = y.x GROUP BY p.a, p.b) t WHERE 100 * k >= 80 * (na + nb - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
g AS (SELECT rep AS a, rep AS root FROM r UNION SELECT e.b, g.root FROM g JOIN e ON e.a = g.a WHERE g.root < e.b),
m AS (SELECT a AS rep, min(root) AS root FROM g GROUP BY a)
SELECT d.doc_id, d.n AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, d.doc_id = coalesce(m.root, d.doc_id) AS kept
FROM n d LEFT JOIN r ON r.n = d.n AND r.f = d.f LEFT JOIN m ON m.rep = r.rep
""",
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
""",
    "op8_warc": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS x FROM p),
d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest
  FROM h),
m AS (SELECT payload_digest, max(page_id) AS last FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d JOIN m USING (payload_digest)
""",
}
