"""DuckDB SQL for the operators that SQL can express: both near dedups by comparing pairs, exact dedup, PII, mixing."""

from __future__ import annotations

EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
g AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total
  FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, CASE WHEN cap <= w * level THEN cap ELSE w * first_open END AS target
  FROM l, (SELECT min_by(level, cap / w) AS first_open FROM l WHERE cap > w * level)),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM c)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)))::BIGINT AS taken
FROM e
"""


def _kind(number: int, kind: str, pattern: str, digits: str, confirmed: str, prior: float, context: str) -> str:
    return rf"""
  SELECT doc_id, '{kind}' AS kind, {number} AS number, {prior} + CASE WHEN regexp_matches(substr(t, greatest(e - length(s) + 1 - 40, 1)::BIGINT, length(s) + 80), '(?i)\b(?:{context})\b') THEN 0.2 ELSE 0 END AS score,
         (e - length(s))::BIGINT AS a, e::BIGINT AS b
  FROM (
    SELECT doc_id, t, s, sum(length(gap) + length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS e, {digits} AS digits
    FROM (
      SELECT doc_id, t, unnest(m) AS s, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i
      FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d) WHERE len(m) > 0))
  WHERE {confirmed}"""


_DIGITS = "regexp_replace(s, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(len(digits)), lambda i: CASE WHEN i % 2 = 0 THEN digits[len(digits) - i]::INT WHEN digits[len(digits) - i]::INT > 4 THEN 2 * digits[len(digits) - i]::INT - 9 ELSE 2 * digits[len(digits) - i]::INT END)) % 10 = 0"
_MOD97 = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(digits[5:] || digits[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT)), lambda a, v: (a * (CASE WHEN v < 10 THEN 10 ELSE 100 END) + v) % 97) = 1"

PII = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ("
    + " UNION ALL ".join(
        [
            _kind(1, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "s", "true", 0.8, "e-?mail|mail|contact|write"),
            _kind(2, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "s", "list_bool_and(list_transform(string_split(s, '.'), lambda p: coalesce(TRY_CAST(p AS HUGEINT), 999) <= 255))", 0.6, "ip|host|server|address|addr"),
            _kind(3, "card", r"[0-9](?:[\x20-]?[0-9])+", _DIGITS, f"len(digits) BETWEEN 13 AND 19 AND {_LUHN}", 0.7, "card|visa|mastercard|credit|debit|payment"),
            _kind(4, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", _DIGITS, "len(digits) BETWEEN 9 AND 15", 0.5, "phone|tel|call|mobile|fax|contact"),
            _kind(5, "iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "replace(s, ' ', '')", f"len(digits) BETWEEN 15 AND 34 AND {_MOD97}", 0.8, "iban|account|bank|konto|transfer"),
        ]
    )
    + """), per AS (
  SELECT doc_id, count(*) FILTER (number = 1) AS n_email, count(*) FILTER (number = 2) AS n_ip, count(*) FILTER (number = 3) AS n_card,
         count(*) FILTER (number = 4) AS n_phone, count(*) FILTER (number = 5) AS n_iban, max(score)::DOUBLE AS max_score,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY number, a) FILTER (number < 5) AS base,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY number, a) AS spans
  FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_iban, 0) AS n_iban, max_score
FROM documents LEFT JOIN per USING (doc_id)
"""
)

_CLASSES = """
r(s, t) AS (SELECT {id}, {id} FROM {table} UNION SELECT s, b FROM r JOIN l ON t = a),
m AS (SELECT s, min(t) AS component_id FROM r GROUP BY 1)
"""

EMBEDDINGS = (
    """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),"""
    + _CLASSES.format(id="vec_id", table="embeddings")
    + "SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m ON s = vec_id"
)

NEAR = (
    r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2),
n AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS i FROM c x JOIN c y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE i >= 0.8 * (x.n + y.n - i)),"""
    + _CLASSES.format(id="doc_id", table="documents")
    + "SELECT doc_id, component_id, doc_id = component_id AS kept FROM documents JOIN m ON s = doc_id"
)

SQL = {"op1_embedding_near_dedup": EMBEDDINGS, "op5_minhash_near_dedup": NEAR, "op2_exact_dedup": EXACT, "op4_pii": PII, "op8_source_mixing": MIXING}
