"""SQL of the hash tree, the vector codes and the license scan."""

from __future__ import annotations

from . import license_scan, vector_codes

#: crc32 of a column of ASCII text, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b:
  list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)), 4294967295)"""
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({p})::VARCHAR || ':' || {p}, '-')" for p in parts) + ")"


MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(_LOWER.format("text"))} END AS altered FROM documents),
b AS (SELECT *, row_number() OVER (ORDER BY doc_id, leaf) AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
lv AS (
  SELECT 0 AS k, lang, i, n, leaf AS h FROM b
  UNION ALL SELECT k + 1, lang, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY k, lang, i // 8, n),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
up AS (
  SELECT 0 AS k, i, n, subroot AS h FROM sub
  UNION ALL SELECT k + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY k, i // 8, n),
pa AS (
  SELECT r, k, lv.i AS j, b.i >> (3 * k) AS own, h FROM b JOIN lv ON lv.lang IS NOT DISTINCT FROM b.lang AND lv.n > 1 AND lv.i >> 3 = b.i >> (3 * k + 3)
  UNION ALL SELECT r, k + 1000, up.i, sub.i >> (3 * k), h FROM b JOIN sub ON sub.lang IS NOT DISTINCT FROM b.lang JOIN up ON up.n > 1 AND up.i >> 3 = sub.i >> (3 * k + 3)),
sib AS (
  SELECT r, k, row_number() OVER (PARTITION BY r ORDER BY k) AS step, coalesce(string_agg(h, '' ORDER BY j) FILTER (j < own), '') AS lo, coalesce(string_agg(h, '' ORDER BY j) FILTER (j > own), '') AS hi
  FROM pa GROUP BY r, k),
pr AS (SELECT r, sha256(string_agg(lo || hi, '' ORDER BY step)) AS proof_sha256 FROM sib GROUP BY r),
fo AS (
  SELECT r, 0 AS step, coalesce(altered, leaf) AS cur FROM b
  UNION ALL SELECT fo.r, sib.step, sha256(lo || cur || hi) FROM fo JOIN sib ON sib.r = fo.r AND sib.step = fo.step + 1),
fr AS (SELECT r, arg_max(cur, step) AS folded_root FROM fo GROUP BY r)
SELECT doc_id, leaf, subroot, (SELECT h FROM up WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM up WHERE n = 1) AS verified
FROM b JOIN fr USING (r) LEFT JOIN pr USING (r) JOIN sub ON sub.lang IS NOT DISTINCT FROM b.lang
"""


def _codes(rounds: int, parts: int, entries: int) -> str:
    """One round's assignment and new entries after another; `o` is the place of a component in its part."""
    ok = "embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"
    sql = [
        f"k0 AS (SELECT vec_id, label, len(embedding) AS size, list_transform(embedding, lambda e: greatest(least(floor(e::DOUBLE * {vector_codes.SCALE}), {vector_codes.MOST}), -{vector_codes.MOST})::BIGINT) AS v FROM embeddings WHERE {ok})",
        "size AS (SELECT size FROM k0 GROUP BY size ORDER BY count(*) DESC, size DESC LIMIT 1)",
        "k AS (SELECT vec_id, label, size, v, row_number() OVER (ORDER BY vec_id NULLS LAST, v, label NULLS FIRST) - 1 AS r FROM k0 WHERE size = (SELECT size FROM size))",
        f"p AS (SELECT k.r, g.part, v[g.part * size // {parts} + 1 : (g.part + 1) * size // {parts}] AS x FROM k, (SELECT unnest(range({parts})) AS part) g)",
        f"c0 AS (SELECT part, r AS e, x AS c FROM p WHERE r < {entries})",
    ]
    for i in range(rounds + 1):
        sql += [
            f"d{i} AS (SELECT r, part, e, x, coalesce(list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j]))), 0)::BIGINT AS d FROM p JOIN c{i} USING (part))",
            f"a{i} AS (SELECT r, part, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS b FROM d{i} GROUP BY r, part)",
        ]
        if i < rounds:
            sql += [
                f"u{i} AS (SELECT part, e, list(floor(s / n)::BIGINT ORDER BY j) AS c FROM (SELECT part, b.e AS e, j, sum(x[j])::DOUBLE AS s, count(*) AS n FROM a{i}, unnest(range(1, len(x) + 1)) t(j) GROUP BY ALL) z GROUP BY part, e)",
                f"c{i + 1} AS (SELECT part, e, coalesce(u.c, o.c) AS c FROM c{i} o LEFT JOIN u{i} u USING (part, e))",
            ]
    return (
        "WITH "
        + ",\n".join(sql)
        + f""",
f AS (SELECT r, string_agg(lpad(to_hex(b.e), 2, '0'), '' ORDER BY part) AS code, sum(b.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e) FILTER (len(c) > 0)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN f USING (r), s
"""
    )


VECTOR_CODES = _codes(vector_codes.ROUNDS, vector_codes.PARTS, vector_codes.ENTRIES)


def _license() -> str:
    """Templates as regular expressions over words set between blanks; base phrases as runs in lists of words."""
    base = {t.name: t for t in license_scan.BASE}
    runs = {n: " AND ".join(f"w[i + {j + 1}] = '{word}'" for j, word in enumerate(t.text.split())) for n, t in base.items()}
    places = ", ".join(f"list_transform(list_filter(range(len(w)), lambda i: {c}), lambda i: {{'i': i, 'l': '{base[n].label}'}})" for n, c in runs.items())
    found = [(t, license_scan.regex(t)) for t in license_scan.TEMPLATES]
    labels = ", ".join(f"CASE WHEN regexp_matches(s, '{x}') THEN '{t.label}' END" for t, x in found)
    scores = ", ".join(f"CASE WHEN regexp_matches(s, '{x}') THEN {license_scan.weight(t)!r}::DOUBLE ELSE 0.0::DOUBLE END" for t, x in found)
    join = lambda c: f"array_to_string(list_sort(list_distinct(list_filter({c}, lambda e: e IS NOT NULL))), ',')"
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS s, flatten([{places}]) AS b FROM t)
SELECT doc_id, len(w)::BIGINT AS n_words, len(b)::BIGINT AS n_base, list_min(list_transform(b, lambda e: e.i))::BIGINT AS first_word, list_max(list_transform(b, lambda e: e.i))::BIGINT AS last_word,
  {join("list_transform(b, lambda e: e.l)")} AS base_labels, {join(f"[{labels}]")} AS labels, greatest(0.0::DOUBLE, {scores}) AS score
FROM p
"""


LICENSE_SCAN = _license()
