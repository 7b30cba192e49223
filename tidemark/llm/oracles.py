"""SQL for the registered queries, where SQL can express them."""

from __future__ import annotations

from .license_rules import CONFIDENCE, compiled, signatures
from .license_scan import PHRASES, phrase_rules

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS impacts
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), one AS (SELECT vec_id, min(impacts) AS impacts FROM v GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_inner_product(q.impacts::DOUBLE[], c.impacts::DOUBLE[])::BIGINT AS score
  FROM one q JOIN one c ON c.vec_id <> q.vec_id AND len(c.impacts) = len(q.impacts)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x20\x09-\x0D]+"

# Shingles that two sets share are counted by a join; components follow links step by step.
NEAR_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(b, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON a = w.doc_id
"""

SUBSTRINGS = f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents
), windows AS (
  SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)
), again AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1
), gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM windows JOIN again USING (win)
), each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w
), kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM each ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

BENCHMARK_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATION = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BENCHMARK_WORDS}') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BENCHMARK_WORDS}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), hits AS (SELECT r, size, i, item FROM dw JOIN bw USING (size, win)
), places AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) FROM hits) GROUP BY r
), items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

# CRC-32 by its definition: a table of 256 remainders, then one step for each byte of a word.
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
RESAMPLE = f"""
WITH RECURSIVE bits(n, k, v) AS (
  SELECT range, 0, range::BIGINT FROM range(256) UNION ALL SELECT n, k + 1, {_STEP.format("v")} FROM bits WHERE k < 8
), tab AS (SELECT list(v ORDER BY n) AS tab FROM bits WHERE k = 8
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BENCHMARK_WORDS}') AS w FROM documents
), b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BENCHMARK_WORDS}') AS w FROM benchmark
), words AS (SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM d UNION ALL SELECT unnest(w) FROM b)
), bytes AS (
  SELECT word, list_transform(range(0, length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS bytes FROM words
), bucket AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, tab
), s AS (SELECT bucket, count(*) AS s FROM (SELECT unnest(w) AS word FROM d) JOIN bucket USING (word) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM b) JOIN bucket USING (word) GROUP BY bucket
), totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((coalesce(s, 0) + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), totals
), sums AS (
  SELECT r, sum(gain)::BIGINT AS total FROM (SELECT r, unnest(w) AS word FROM d) JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY r
), weighed AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features,
         CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN sums USING (r)
), scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed
), able AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END::BIGINT AS rank FROM scored LEFT JOIN able USING (r)
"""

LEXICAL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BENCHMARK_WORDS}') AS w FROM documents
), held AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0
), size AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM held
), freq AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM held) GROUP BY r, term
), weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM freq, size GROUP BY term, n_docs
), asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BENCHMARK_WORDS}')) AS term FROM benchmark) GROUP BY item_id, term
), scored AS (
  SELECT item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN freq USING (term) JOIN held USING (r), size GROUP BY item_id, r, doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def _values(rules: list, first: int) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(r.label)}, {r.level}, {quote(r.keyword)}, {quote(compiled(r.pattern))}, {k})" for k, r in enumerate(rules, first))


LICENSES = f"""
WITH rule(label, level, keyword, pattern, nth) AS (VALUES {_values(phrase_rules(PHRASES), -len(PHRASES))}, {_values(signatures(), 0)}
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BENCHMARK_WORDS}') AS w FROM documents
), tagged AS (
  SELECT r, w, array_to_string(list_transform(w, lambda x, k: ' ' || x || '#' || (k - 1) || ' '), '') AS t FROM d WHERE list_has_any(w, (SELECT list(keyword) FROM rule))
), hit AS (
  SELECT r, label, level, nth, unnest(regexp_extract_all(t, pattern)) AS m FROM tagged JOIN rule ON list_contains(w, keyword) WHERE regexp_matches(t, pattern)
), span AS (
  SELECT *, regexp_extract(m, '#([0-9]+) ', 1)::BIGINT AS a, regexp_extract(m, '#([0-9]+) $', 1)::BIGINT AS z FROM hit
), kept AS (
  SELECT * FROM span x WHERE NOT EXISTS (
    SELECT 1 FROM span y WHERE y.r = x.r AND y.level <= x.level AND y.a <= x.a AND y.z >= x.z
      AND (y.a, -y.z, y.level, y.nth) < (x.a, -x.z, x.level, x.nth))
), base AS (
  SELECT r, count(*) AS n, min(a) AS first, max(a) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM span WHERE nth < 0 GROUP BY r
), named AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM kept UNION ALL SELECT r, label FROM span WHERE nth < 0) GROUP BY r
), worth AS (SELECT r, max([{", ".join(f"{c}::DOUBLE" for c in CONFIDENCE)}][level + 1]) AS score FROM kept GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first AS first_word, last AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(named.labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN worth USING (r)
"""

ORACLES: dict[str, str] = {
    "op1_near_dedup": NEAR_DEDUP,
    "op2_top_k": TOP_K,
    "op4_substring_dedup": SUBSTRINGS,
    "op6_decontaminate": DECONTAMINATION,
    "op11_resample": RESAMPLE,
    "op12_lexical_search": LEXICAL,
    "op13_license_scan": LICENSES,
}
