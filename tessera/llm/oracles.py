"""SQL for an independent engine, for the operators that SQL can express."""

from __future__ import annotations

_WORDS = "list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="text")} AS ws FROM documents),
k AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS run FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM d)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS turn FROM k),
gone AS (SELECT DISTINCT doc_id, s + o.o AS i FROM f, (SELECT unnest(generate_series(0, 19)) AS o) AS o WHERE turn > 1),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM d),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT d.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 2], ' ') AS gram FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS s FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * both_ >= 90 * (x.n + y.n - both_)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.low AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(reached) AS low FROM r GROUP BY node) AS c ON c.node = d.doc_id
"""
