"""DuckDB SQL for the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

from .license_digest import COPYRIGHT_LINE, KNOWN, SPELLINGS, TITLE
from .url_alias import LOWER, RULES, UPPER


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_RULE = "CASE " + " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{'rule': '{r.text}', 'action': '{r.action}'}}"
    for r in sorted(RULES, key=lambda r: (-len(r.text), r.text))
) + " END"

_PARTS = f"""translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path"""

OP1 = f"""
WITH RECURSIVE link AS (
 SELECT url, regexp_extract(unnest(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\\brel\\s*=\\s*["'']?[^"''>]*\\bcanonical\\b'))), '(?is)\\bhref\\s*=\\s*"([^"]*)"', 1) AS other
 FROM pages WHERE html ILIKE '%canonical%' AND contains(url, '://')),
edge AS (SELECT DISTINCT regexp_replace(url, '(?s)#.*$', '') AS a, regexp_replace(other, '(?s)#.*$', '') AS b FROM link WHERE contains(other, '://')),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT reach.x, both_ways.b FROM reach JOIN both_ways ON reach.y = both_ways.a),
said AS (SELECT x, max(CASE (r).action WHEN 'allow' THEN 1 ELSE 0 END) AS allowed
 FROM (SELECT x, {_RULE} AS r FROM (SELECT x, {_PARTS} FROM (SELECT x, y AS url FROM reach))) WHERE r IS NOT NULL GROUP BY x),
p AS (SELECT *, {_RULE} AS r FROM (SELECT page_id, url, {_PARTS} FROM pages))
SELECT page_id, host, path, (r).rule AS rule,
 coalesce((r).action, CASE allowed WHEN 1 THEN 'allow' WHEN 0 THEN 'block' END, 'allow') AS verdict,
 CASE WHEN r IS NOT NULL THEN 'rule' WHEN allowed IS NOT NULL THEN 'alias' ELSE 'default' END AS source
FROM p LEFT JOIN said ON r IS NULL AND regexp_replace(url, '(?s)#.*$', '') = x
"""

_LOW = f"translate(text, '{UPPER}', '{LOWER}')"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
 ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS sh FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM e x JOIN e y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_n >= 80 * (na.n + nb.n - both_n)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS x, a AS y FROM g UNION SELECT reach.x, g.b FROM reach JOIN g ON reach.y = g.a),
m AS (SELECT x, min(y) AS least FROM reach GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least, n.doc_id) AS component_id, n.doc_id = coalesce(least, n.doc_id) AS kept
FROM n LEFT JOIN m ON m.x = n.doc_id
"""

OP3 = r"""
WITH t AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, lag(role, 1, '') OVER w AS prev, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
  4 + 2 + 9 + 2 * length(role) - length(regexp_replace(role, '[\\<#:]', '', 'g')) + 2 * length(text) - length(regexp_replace(text, '[\\<#]', '', 'g')) AS chars
 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and((prev = '' AND role IN ('system', 'user')) OR (prev = 'system' AND role = 'user') OR (prev = 'user' AND role = 'assistant') OR (prev = 'assistant' AND role = 'user'))
   AND bool_or(place = n AND role IN ('user', 'assistant')) AS valid
 FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, valid FROM g
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS least FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 100 AND page_id <> least THEN least END AS refers_to
FROM f
"""

_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
dw AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
i AS (SELECT item_id, coalesce({_WORDS}, []) AS ws FROM benchmark),
win AS (SELECT item_id, ws[s:s+9] AS ws FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
uw AS (SELECT ws, row_number() OVER () AS win FROM (SELECT DISTINCT ws FROM win)),
of_item AS (SELECT DISTINCT item_id, win FROM win JOIN uw USING (ws)),
t AS (SELECT win, len(ws) AS size, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS k FROM uw),
freq AS (SELECT w, count(*) AS n FROM dw GROUP BY w),
rare AS (SELECT win, size, arg_min(w, (n, k)) AS w, arg_min(k, (n, k)) AS k FROM (SELECT t.*, coalesce(n, 0) AS n FROM t LEFT JOIN freq USING (w)) GROUP BY win, size),
cand AS (SELECT DISTINCT doc_id, win, size, pos - k + unnest(range(-2, 3)) AS s FROM rare JOIN dw USING (w)),
test AS (SELECT c.doc_id, c.win, c.size, c.s, count(DISTINCT t.k) AS near_n, count(DISTINCT t.k) FILTER (WHERE dw.pos = c.s + t.k) AS exact_n
 FROM cand c JOIN t USING (win) JOIN dw ON dw.doc_id = c.doc_id AND dw.w = t.w AND dw.pos BETWEEN c.s + t.k - 2 AND c.s + t.k + 2 GROUP BY ALL),
exact AS (SELECT * FROM test WHERE exact_n = size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM exact) GROUP BY doc_id),
items AS (SELECT DISTINCT doc_id, item_id FROM exact JOIN of_item USING (win)),
near AS (SELECT DISTINCT doc_id, item_id FROM test JOIN of_item USING (win) WHERE near_n = size EXCEPT SELECT * FROM items),
agg AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM items GROUP BY doc_id),
nears AS (SELECT doc_id, count(*) AS n_near FROM near GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN agg USING (doc_id) LEFT JOIN nears USING (doc_id)
"""


def _canonical_lines(c: str) -> str:
    c = f"regexp_replace(lower({c}), '\\r\\n?', chr(10), 'g')"
    c = f"regexp_replace({c}, {_text(COPYRIGHT_LINE)}, '', 'g')"
    return f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def _spelled(c: str) -> str:
    for other, one in SPELLINGS:
        c = f"replace({c}, '{other}', '{one}')"
    return c


def _canonical(c: str) -> str:
    return f"regexp_replace({_spelled(f"trim(regexp_replace({c}, '[ \\n]+', ' ', 'g'))")}, {_text(TITLE)}, '')"


OP8 = f"""
WITH k AS (SELECT sha256({_canonical(_canonical_lines('t'))}) AS h, min(license_id) AS license_id
 FROM (VALUES {', '.join(f'({_text(i)}, {_text(t)})' for i, t in KNOWN)}) v(license_id, t) GROUP BY 1),
d AS (SELECT doc_id, row_number() OVER () AS r, {_canonical_lines('text')} AS lines FROM documents),
l AS (SELECT r, list_sort(list(DISTINCT license_id)) AS ids FROM (SELECT r, sha256({_spelled('trim(line)')}) AS h FROM (SELECT r, unnest(string_split(lines, chr(10))) AS line FROM d)) JOIN k USING (h) GROUP BY r)
SELECT doc_id, sha256({_canonical('lines')}) AS digest, license_id, coalesce(ids, []) AS line_licenses
FROM d LEFT JOIN k ON k.h = sha256({_canonical('lines')}) LEFT JOIN l USING (r)
"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach AS (SELECT a AS x, a AS y FROM l UNION SELECT reach.x, l.b FROM reach JOIN l ON reach.y = l.a),
m AS (SELECT x, min(y) AS least FROM reach GROUP BY x), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least, vec_id) AS component_id, vec_id = coalesce(least, vec_id) AS kept
FROM embeddings LEFT JOIN m ON m.x = vec_id LEFT JOIN n ON n.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_alias": OP1, "op2_minhash": OP2, "op3_chat_format": OP3, "op4_warc_zstd": OP4, "op5_decontam": OP5,
        "op8_license_digest": OP8, "op9_cover_tree": OP9,
    }
