"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, html, jaccard_join, language, licenses, mixing, paragraphs, ppm, quality, search, tokens, vectors, warc


def queries() -> dict:
    made = [licenses.op1_license_scan, decontamination.op2_benchmark_decontamination, html.op3_html_extraction, jaccard_join.op4_ngram_jaccard_join, quality.op5_quality_rules, tokens.op6_token_counts, mixing.op7_mixing, warc.op8_warc, paragraphs.op9_substring_dedup, language.op10_language_id, ppm.op11_lm_scoring, vectors.op12_vector_codes, search.op13_ranked_search]
    return {f.__name__: f for f in made}


_MIX = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS tx, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size,
  md5('mix' || chr(1) || coalesce(cast(doc_id AS VARCHAR), '') || chr(1) || md5(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT *, -ln((cast(('0x' || substr(h, 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) /
  CASE WHEN length(tx) = 0 THEN 0.1::DOUBLE ELSE greatest(0.1::DOUBLE, length(regexp_replace(tx, '[#*$%&|<>!0-9A-Z]', '', 'g'))::DOUBLE / length(tx)) END AS key FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, 2.0 * n AS cap, 1.5 * sum(n) OVER () AS total FROM s),
l AS (SELECT a.*, (SELECT max(x.level) FROM (SELECT (b.total - coalesce((SELECT sum(c.cap) FROM w c WHERE c.cap / c.w < b.cap / b.w), 0)) / (SELECT sum(c.w) FROM w c WHERE c.cap / c.w >= b.cap / b.w) AS level, b.cap / b.w AS at FROM w b) x WHERE x.level < x.at) AS level FROM w a),
t AS (SELECT source, n, least(cap, coalesce(w * level, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS epochs FROM t),
b AS (SELECT *, floor(target - epochs * n + 0.5) AS budget FROM e),
g AS (SELECT source, key, h, sum(size) AS n, count(*) AS rows FROM k GROUP BY ALL),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY key, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
r AS (SELECT k.doc_id, k.size, b.n, b.target, b.epochs, b.budget, o.before, o.n AS own, o.rows FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source JOIN o ON o.source IS NOT DISTINCT FROM k.source AND o.key = k.key AND o.h = k.h)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target, (epochs * size + CASE WHEN budget >= before + own THEN size WHEN budget > before THEN least(size, floor((budget - before) / rows)) ELSE 0 END)::BIGINT AS taken FROM r"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS hex FROM pages), m AS (SELECT hex, max(page_id) AS last FROM p GROUP BY hex)
SELECT page_id, strlen(b)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, ((k // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p JOIN m USING (hex)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle(), "op7_mixing": _MIX, "op8_warc": _WARC, "op12_vector_codes": vectors.oracle(), "op13_ranked_search": search.ORACLE}
