"""DuckDB SQL for the operators that SQL can express: the definition of the result, not the method."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 90 * (n + m - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.least, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) c ON c.a = s.doc_id
"""

#: Bytes are pairs of hexadecimal digits here.
OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(greatest(length(h) // 2 - 399, 0))) AS i, h FROM d),
k AS (SELECT doc_id, i, md5_number(substring(h, 2 * i + 1, 800)) AS k FROM w),
hit AS (SELECT doc_id, i FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
new AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM new),
span AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
kept AS (SELECT g.doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substring(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS t
 FROM gap g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN last IS NULL THEN d.h ELSE t || substring(d.h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

ORACLE = {"op5_suffix_dedup": OP5, "op7_ngram_jaccard": OP7}
