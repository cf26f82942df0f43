"""What SQL can say of these queries, for DuckDB, over whole tables.

Plain and quadratic in places: an oracle for small tables, not a way to do it.
"""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"


def substrings_sql(window: int = 35, source: str = "documents") -> str:
    """op2: windows as joined words; a word goes if one of the ``window`` windows that cover it stands twice."""
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM {source}),
p AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i FROM d),
x AS (SELECT p.rid, p.i, w[p.i] AS word, CASE WHEN p.i + {window - 1} <= len(w) THEN md5(array_to_string(w[p.i:p.i + {window - 1}], ' ')) END AS win FROM p JOIN d USING (rid)),
c AS (SELECT win FROM x WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
f AS (SELECT x.rid, x.i, x.word, c.win IS NOT NULL AS hit FROM x LEFT JOIN c USING (win)),
g AS (SELECT *, bool_or(hit) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS edge FROM g),
a AS (SELECT rid, count(*) AS n_words, count_if(gone)::BIGINT AS n_removed, count_if(edge)::BIGINT AS n_spans, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY rid)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN a USING (rid)"""


def near_duplicates_sql(size: int = 5, threshold: float = 0.8, source: str = "documents") -> str:
    """op1: every pair of different texts with a shingle in common, by exact similarity; classes are what can be reached."""
    return f"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id, count(*) AS n FROM {source} GROUP BY 1),
w AS (SELECT id, regexp_extract_all(text, '{WORDS}') AS w FROM t),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - {size - 2}, 2)), lambda i: md5(array_to_string(w[i:i + {size - 1}], ' ')))) AS h FROM w WHERE len(w) > 0),
k AS (SELECT id, count(*) AS k FROM s GROUP BY 1),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS nb FROM s a JOIN s b ON a.h = b.h AND a.id < b.id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN k ka ON ka.id = a JOIN k kb ON kb.id = b WHERE nb >= {threshold} * (ka.k + kb.k - nb)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT id AS node, id AS root FROM t UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.root),
m AS (SELECT node, min(root) AS class_id FROM r GROUP BY 1),
z AS (SELECT class_id, sum(n)::BIGINT AS class_size, count(*) AS n_texts FROM m JOIN t ON t.id = m.node GROUP BY 1)
SELECT doc_id, class_id, class_size, n_texts FROM {source} JOIN t ON t.text = coalesce({source}.text, '') JOIN m ON m.node = t.id JOIN z USING (class_id)"""


def suffixes_sql(window: int = 100, source: str = "documents") -> str:
    """op9: strings as hexadecimal digits; a byte goes if one of the strings that cover it stands earlier."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM {source}),
p AS (SELECT doc_id, unnest(range(0, n)) AS i FROM d),
x AS (SELECT p.doc_id, p.i, substr(h, 2 * p.i + 1, 2) AS byte, CASE WHEN p.i + {window} <= n THEN md5_number(substr(h, 2 * p.i + 1, {2 * window})) END AS str FROM p JOIN d USING (doc_id)),
f AS (SELECT doc_id, i, byte, str IS NOT NULL AND row_number() OVER (PARTITION BY str ORDER BY doc_id, i) > 1 AS hit FROM x),
g AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS edge FROM g),
a AS (SELECT doc_id, count_if(gone)::BIGINT AS n_removed, count_if(edge)::BIGINT AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""
