"""DuckDB statements that give the same rows as the text queries."""

from __future__ import annotations

_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85]+'))"
P8 = f"SELECT doc_id FROM documents WHERE {_TOKENS} > 2048 GROUP BY doc_id"
_GRAMS = (
    r"SELECT {k}, w[i:i + 11] AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - 10)) AS i FROM "
    r"(SELECT {k}, regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+') AS w FROM {t} WHERE text IS NOT NULL) WHERE len(w) >= 12)"
)
P9 = (
    "WITH i AS (SELECT DISTINCT item_id, hash(g) AS h FROM (" + _GRAMS.format(k="item_id", t="eval_items") + ")), "
    "d AS (SELECT DISTINCT doc_id, hash(g) AS h FROM (" + _GRAMS.format(k="doc_id", t="documents") + ")) "
    "SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (h)"
)
P10 = (
    "WITH p AS (SELECT DISTINCT doc_id, md5(substr(text, i, 320)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 318)) AS i FROM documents WHERE length(text) >= 320)), "
    "r AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1), s AS (SELECT doc_id, h FROM p SEMI JOIN r USING (h)) "
    "SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id"
)
P9_DOCUMENTS = f"SELECT doc_id, list_sort(list(item_id)) AS items, count(*) AS n_items FROM ({P9}) GROUP BY 1"
P10_DOCUMENTS = (
    "WITH p AS (SELECT doc_id, i, md5(substr(text, i, 320)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 318)) AS i FROM documents WHERE length(text) >= 320)), "
    "r AS (SELECT h FROM p GROUP BY h HAVING min(doc_id) <> max(doc_id)), s AS (SELECT doc_id, i FROM p SEMI JOIN r USING (h)), "
    "m AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 320 THEN 0 ELSE 1 END AS new FROM s), "
    "n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m), "
    "t AS (SELECT doc_id, max(i) - min(i) + 320 AS size FROM n GROUP BY doc_id, run), "
    "z AS (SELECT doc_id, count(*) AS n_stretches, CAST(sum(size) AS BIGINT) AS shared_chars, max(size) AS longest FROM t GROUP BY 1) "
    "SELECT doc_id, n_stretches, shared_chars, longest, length(text) AS n_chars, shared_chars / length(text) AS share FROM z JOIN documents USING (doc_id)"
)
# of containers SQL can state how many items and tokens they hold, that none is overfull, and the least number that could do
P8_TOTALS = (
    f"WITH d AS (SELECT doc_id, max({_TOKENS}) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1), t AS (SELECT count(*) AS documents, CAST(sum(greatest(CAST(ceil(n / 2048) AS BIGINT), 1)) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS tokens FROM d) "
    "SELECT documents, pieces, tokens, CAST(ceil(tokens / 2048) AS BIGINT) AS least_containers, 0 AS overfull, true AS within_two_percent FROM t"
)
ORACLES = {"p8_found": P8, "p8_totals": P8_TOTALS, "p9_found": P9, "p9_documents": P9_DOCUMENTS, "p10_found": P10, "p10_documents": P10_DOCUMENTS}
