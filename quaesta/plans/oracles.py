"""DuckDB SQL for the rows of the engine's queries."""

from __future__ import annotations

_WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"


def _slug(c: str) -> str:
    return f"trim(regexp_replace(translate(lower({_norm(c)}), 'àâçéèêëîïôùûü', 'aaceeeeiiouuu'), '[^a-z0-9]+', '-', 'g'), '-')"


def _hits(gate: float, same: bool = False) -> str:
    return f"""
q AS (SELECT vec_id, vec_id // 20 AS n, printf('v%08d', vec_id) AS query_id, label, embedding FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS qv, q.query_id, printf('v%08d', e.vec_id) AS chunk_id, e.vec_id, 'doc' || e.label AS document_id, e.label,
 list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
 FROM q JOIN embeddings e ON e.vec_id <> q.vec_id {'AND e.label = q.label' if same else ''}),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score >= {gate} QUALIFY rank <= 5)"""


_F = "f AS (SELECT 'r' || (n // 3) AS request_id, n % 3 AS pos, 'f' || vec_id AS supported_finding_id, query_id FROM q)"
_STATUS = """g AS (SELECT f.request_id, count(chunk_id) AS n_citations,
 coalesce(string_agg(CASE WHEN chunk_id IS NULL THEN supported_finding_id END, ',' ORDER BY pos), '') AS unresolved,
 coalesce(string_agg(CASE WHEN chunk_id IS NOT NULL THEN supported_finding_id || ':' || chunk_id END, ',' ORDER BY pos, rank), '') AS citation_ids
 FROM f LEFT JOIN hits USING (query_id) GROUP BY f.request_id)"""
_CASE = "CASE WHEN n_citations = 0 THEN 'INSUFFICIENT_CONTEXT' WHEN unresolved <> '' THEN 'PARTIAL' ELSE 'SUCCESS' END AS retrieval_status"

_EVAL = f"""WITH {_hits(0.35)},
c AS (SELECT query_id AS case_id, 'doc' || label AS expected, n % 5 <> 4 AS expect_retrieval FROM q),
j AS (SELECT case_id, expect_retrieval, count(chunk_id) AS n, min(rank) FILTER (WHERE document_id = expected) AS first FROM c LEFT JOIN hits ON query_id = case_id GROUP BY ALL),
r AS (SELECT case_id, expect_retrieval, CASE WHEN expect_retrieval THEN CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END AS recall_at_k,
 CASE WHEN expect_retrieval THEN first END AS first_relevant_rank, CASE WHEN expect_retrieval THEN coalesce(1.0::DOUBLE / first, 0.0) END AS reciprocal_rank,
 CASE WHEN NOT expect_retrieval THEN n = 0 END AS correct_abstention FROM j)"""

_FIRST = "string_split(text, chr(10))[1]"
_CHUNK_ID = f"'doc' || doc_id || ':' || {_slug(_FIRST)} || ':' || printf('%03d', doc_id)"

_PLAIN = "trim(regexp_replace(lower(strip_accents(replace({}, 'ß', 'ss'))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

_TERMS = f"""WITH a AS (SELECT doc_id, {_PLAIN.format('text')} AS t, doc_id % 10 = 0 AS failed, doc_id % 4 <> 0 AS grounded, doc_id % 3 <> 0 AS expected FROM documents),
r AS (SELECT *, NOT failed AND NOT contains(t, 'the of') AS m1, NOT failed AND NOT contains(t, 'in') AS m2, NOT failed AND contains(t, 'de la') AS f1, NOT failed AND contains(t, 'strasse') AS f2 FROM a),
p AS (SELECT *, NOT failed AND NOT m1 AND NOT m2 AND NOT f1 AND NOT f2 AS ok, NOT failed AND grounded = expected AS match FROM r)"""

ORACLES = {
    "vector_topk": f"WITH {_hits(-1.0)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits",
    "vector_topk_filtered": f"WITH {_hits(-1.0, True)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits",
    "relevance_gate": f"WITH {_hits(0.35)} SELECT query_id, chunk_id, document_id, round(score, 6) AS score, rank FROM hits",
    "retrieval_sufficient": f"WITH {_hits(0.35)} SELECT q.query_id, count(chunk_id) > 0 AS retrieval_sufficient, count(chunk_id) AS n_results FROM q LEFT JOIN hits USING (query_id) GROUP BY q.query_id",
    "evidence_status": f"WITH {_hits(0.35)}, {_F}, {_STATUS} SELECT request_id, {_CASE}, n_citations, unresolved, 'insurance_documents' AS knowledge_base_version FROM g",
    "evidence_status_filtered": f"WITH {_hits(0.30, True)}, {_F}, {_STATUS} SELECT request_id, {_CASE}, citation_ids FROM g",
    "evidence_citations": f"WITH {_hits(0.35)}, {_F} SELECT request_id, supported_finding_id || ':' || chunk_id AS citation_id, document_id AS source_document_id, 'Document ' || label AS source_document_title, 'Body' AS section_reference, 'Vector ' || vec_id AS excerpt, round(score, 6) AS relevance_score, supported_finding_id FROM f JOIN hits USING (query_id)",
    "unresolved_findings": f"WITH {_hits(0.35)}, {_F} SELECT request_id, supported_finding_id FROM f ANTI JOIN hits USING (query_id)",
    "eval_cases": f"{_EVAL} SELECT case_id, recall_at_k, first_relevant_rank, round(reciprocal_rank, 6) AS reciprocal_rank, correct_abstention, CASE WHEN expect_retrieval THEN recall_at_k > 0 ELSE correct_abstention END AS passed FROM r",
    "eval_metrics": f"{_EVAL} SELECT count(*) AS total_cases, count(*) FILTER (WHERE expect_retrieval) AS answerable_cases, count(*) FILTER (WHERE NOT expect_retrieval) AS unanswerable_cases, round(avg(recall_at_k), 6) AS macro_recall_at_k, round(avg(reciprocal_rank), 6) AS mean_reciprocal_rank, round(avg(correct_abstention::INT), 6) AS correct_abstention_rate FROM r",
    "chunk_text": f"""WITH RECURSIVE t AS (SELECT doc_id, string_split({_norm('text')}, ' ') AS w FROM documents WHERE text IS NOT NULL),
 d AS (SELECT doc_id, w, len(w) AS n, list_prepend(0, list_transform(range(1, len(w) + 1), lambda i: list_sum(list_transform(w[1:i], lambda x: length(x) + 1))::BIGINT)) AS p FROM t),
 step AS (SELECT doc_id, 0 AS part, 0 AS s, CASE WHEN p[n+1] - 1 <= 1600 THEN n ELSE greatest(1, len(list_filter(p, lambda x: x <= 1601)) - 1) END AS e FROM d
 UNION ALL SELECT doc_id, part + 1, s2, greatest(s2 + 1, len(list_filter(p, lambda x: x <= p[s2+1] + 1601)) - 1)
 FROM (SELECT doc_id, part, n, p, CASE WHEN again <= s THEN e ELSE again END AS s2 FROM (SELECT step.*, d.n, d.p, least(len(list_filter(p, lambda x: x < p[e+1] - 201)), e) AS again FROM step JOIN d USING (doc_id) WHERE e < n)))
 SELECT doc_id, part::BIGINT AS part, length(c) AS n_chars, sha256(c) AS chunk_sha256 FROM (SELECT doc_id, part, array_to_string(w[s+1:e], ' ') AS c FROM step JOIN d USING (doc_id))""",
    "content_hashes": f"SELECT doc_id, sha256({_norm('text')}) AS content_hash FROM documents",
    "dedup_by_hash": f"SELECT sha256({_norm('text')}) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "slugify_titles": f"SELECT doc_id, {_slug(_FIRST)} AS slug FROM documents",
    "chunk_ids": f"SELECT doc_id, {_CHUNK_ID} AS chunk_id FROM documents",
    "point_ids": f"""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({_CHUNK_ID})) AS h FROM documents)
 SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(to_hex((('0x' || h[17:18])::INT & 63) | 128)) || h[19:20] || '-' || h[21:32] AS point_id FROM h""",
    "section_parse": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
 s AS (SELECT doc_id, i // 3 AS k, {_norm("string_agg(line, chr(10) ORDER BY i)")} AS c FROM l GROUP BY 1, 2)
 SELECT doc_id, 'H' || k AS title, CASE k % 3 WHEN 0 THEN 'H' || k WHEN 1 THEN 'H' || (k - 1) || ' > H' || k ELSE 'H' || (k - 2) || ' > H' || (k - 1) || ' > H' || k END AS path, sha256(c) AS content_sha256 FROM s WHERE c <> ''""",
    "citation_normalize": f"SELECT doc_id, sha256({_norm("translate(replace(replace(text, ' the ', chr(160) || 'the '), 'th', 't' || chr(8209) || 'h'), chr(8209) || chr(160), '- ')")}) AS normalized_sha256 FROM documents",
    "citation_verify": f"""WITH p AS (SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
 c AS (SELECT * FROM p UNION SELECT doc_id + 1, item_id FROM p)
 SELECT doc_id || ':' || item_id AS query_id, CASE WHEN doc_id % 7 = 0 THEN 'non-retrieved chunk' WHEN NOT contains({_norm('d.text')}, {_norm('b.text')}) THEN 'quote not verbatim'
 WHEN doc_id % 5 = 0 THEN 'wrong document_name' END AS failure FROM c JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)""",
    "eval_text_normalize": f"SELECT doc_id, sha256({_PLAIN.format('text')}) AS normalized_sha256 FROM documents",
    "term_constraint_cases": f"{_TERMS} SELECT doc_id::VARCHAR AS case_id, concat_ws(',', CASE WHEN m1 THEN 'The of' END, CASE WHEN m2 THEN 'in' END) AS missing, concat_ws(',', CASE WHEN f1 THEN 'de la' END, CASE WHEN f2 THEN 'Straße' END) AS forbidden, ok AS answer_constraints_passed, match AS grounding_matches_expectation, match AND ok AS passed FROM p",
    "generation_metrics": f"""{_TERMS} SELECT count(*) AS total_cases, count(*) FILTER (WHERE failed) AS generation_errors, round(count(*) FILTER (WHERE expected AND match) / count(*) FILTER (WHERE expected), 6) AS grounded_answer_rate,
 round(count(*) FILTER (WHERE NOT expected AND match) / count(*) FILTER (WHERE NOT expected), 6) AS correct_grounded_abstention_rate,
 round(sum(CASE WHEN failed THEN 0 ELSE (doc_id % 4 < 2)::INT + (doc_id % 6 < 2)::INT END) / sum(CASE WHEN failed THEN 0 ELSE 2 END), 6) AS citation_document_precision,
 round(avg(ok::INT), 6) AS answer_constraint_pass_rate, round(avg(match::INT), 6) AS overall_grounding_accuracy FROM p""",
    "eval_passages": f"WITH {_hits(0.35)} SELECT query_id AS case_id, 'Question ' || query_id AS question, CASE WHEN n % 5 <> 4 THEN 'doc' || q.label ELSE '' END AS expected, rank, chunk_id, document_id, 'Body' AS section_title, round(score, 6) AS score FROM hits JOIN q USING (query_id)",
    "ingest_chunks": f"""WITH s AS (SELECT doc_id, 'Doc ' || doc_id || ' > Part' AS path, 0 AS chunk_index, {_norm("'Doc ' || doc_id || ' > Part' || chr(10) || 'Text. ' || coalesce(text, '')")} AS t, 'part' AS slug FROM documents
 UNION ALL SELECT doc_id, 'Doc ' || doc_id || ' > Part > End', 1, 'Doc ' || doc_id || ' > Part > End Done.', 'part-end' FROM documents)
 SELECT 'd' || doc_id || ':doc-' || doc_id || '-' || slug || ':00' || chunk_index AS chunk_id, 'd' || doc_id AS document_id, 'Doc ' || doc_id AS document_name, '2026-01-01' AS effective_date, path, chunk_index, length(t) AS n_chars, sha256(t) AS content_hash FROM s""",
    "metadata_checks": """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'title:too_short' END, CASE WHEN coalesce(length(source), 0) < 1 THEN 'coverage:too_short' END, CASE WHEN doc_id % 7 = 0 THEN 'jurisdiction:too_short' END,
 CASE WHEN doc_id % 5 = 0 THEN 'document_type:not_allowed' END, CASE WHEN coalesce(lang, '') NOT IN ('en', 'fr') THEN 'language:not_allowed' END, CASE WHEN doc_id % 11 = 0 THEN 'effective_date:missing' END) AS violations FROM documents""",
    "chunk_checks": """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'chunk_id:too_short' END, CASE WHEN doc_id % 2 = 0 OR coalesce(length(text), 0) < 1 THEN 'text:too_short' END, CASE WHEN doc_id % 5 = 0 THEN 'chunk_index:negative' END,
 CASE WHEN text IS NULL THEN 'content_hash:length' END, CASE WHEN doc_id % 4 = 0 THEN 'page_start:below_one' END) AS violations FROM documents""",
    "excerpts_and_places": """SELECT doc_id, sha256(left(text, 600)) AS excerpt_sha256, CASE WHEN doc_id % 3 <> 0 THEN 'pages ' || (doc_id % 9 + 1) || '-' || (doc_id % 9 + 2) ELSE 'Markdown section' END AS place,
 CASE WHEN doc_id % 4 <> 0 THEN printf('%.3f', doc_id / 8.0) ELSE 'N/A' END AS label FROM documents""",
    "prompt_build": f"""WITH {_hits(0.35)}, p AS (SELECT qv, query_id, 'Question:' || chr(10) || 'Question ' || qv || chr(10) || chr(10) || 'Retrieved source passages:' || chr(10) ||
 string_agg('<source rank="' || rank || '" chunk_id="' || chunk_id || '" document_id="' || document_id || '" document_name="Document ' || label || '" section="Body" score="' || printf('%.3f', score) || '">' || chr(10) || 'Vector ' || vec_id || chr(10) || '</source>', chr(10) || chr(10) ORDER BY rank)
 || chr(10) || chr(10) || 'Return a grounded structured answer.' AS prompt FROM hits GROUP BY 1, 2) SELECT query_id, length(prompt) AS n_chars, sha256(prompt) AS prompt_sha256 FROM p""",
    "metadata_facets": "SELECT 'doc' || label AS document_id, count(*) AS n FROM embeddings GROUP BY 1",
    "exact_count": "SELECT count(*) AS n FROM embeddings",
}
