"""DuckDB SQL of the ingestion and lookup queries, written apart from the plans."""

from __future__ import annotations

from lectern.plans.oracles import _AFFINITY, _COMPONENTS, _TITLES, _terms, _windows, _words

_TOKENS = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_SPLIT = _words("text")

_HITS = """
firsts AS (SELECT l_linenumber AS query_id, l_suppkey AS doc_id, min(l_orderkey) AS o, count(*) AS n FROM lineitem GROUP BY 1, 2),
hits AS (SELECT query_id, doc_id, k, row_number() OVER (PARTITION BY query_id ORDER BY o, doc_id, k) AS rank FROM (SELECT *, unnest(range(1, least(n, 7) + 1)) AS k FROM firsts))"""

_ANSWERS = """
c AS (SELECT conv_id AS answer_id, bool_or(turn = 0) AS p1, bool_or(turn = 2) AS p3 FROM conversations GROUP BY 1),
cited AS (
  SELECT answer_id, 0 AS nth, 'Conversation num' AS title, 1 AS page, p1 AS ok FROM c
  UNION ALL SELECT answer_id, 1, 'CONVERSATION NUMBER ' || answer_id, 3, p3 FROM c
  UNION ALL SELECT answer_id, 2, 'Convers', 1, false FROM c
  UNION ALL SELECT answer_id, 3, 'Elsewhere entirely', 2, false FROM c
  UNION ALL SELECT answer_id, 4, 'Convers', 1, false FROM c)"""

_PAGED = f"""
w AS (SELECT conv_id AS doc_id, turn + 1 AS page, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT conv_id, turn, {_SPLIT} AS ws FROM conversations)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) - 1 AS spot, count(*) OVER (PARTITION BY doc_id) AS n FROM w),
starts AS (SELECT doc_id, unnest(CASE WHEN n <= 80 THEN [0] ELSE list_transform(range(0, 1 + ceil((n - 80) / 68.0)::BIGINT), lambda i: i * 68) END) AS s FROM (SELECT DISTINCT doc_id, n FROM o)),
prose AS (
  SELECT s.doc_id, s // 68 AS seq, arg_min(page, spot) AS page, arg_max(page, spot) AS end_page, string_agg(w, ' ' ORDER BY spot) AS text
  FROM starts s JOIN o ON o.doc_id = s.doc_id AND spot >= s AND spot < s + 80 GROUP BY s.doc_id, s),
counted AS (SELECT doc_id, count(*) AS n FROM prose GROUP BY 1),
tab AS (
  SELECT c.conv_id AS doc_id, 2 - turn AS page, row_number() OVER (PARTITION BY c.conv_id ORDER BY 2 - turn) - 1 + coalesce(n, 0) AS seq
  FROM conversations c LEFT JOIN counted ON doc_id = conv_id WHERE conv_id % 3 = 0 AND turn < 2),
every AS (
  SELECT doc_id, seq, page, end_page, CASE WHEN page % 2 = 0 THEN 'OcrProse' ELSE 'Prose' END AS kind, text FROM prose
  UNION ALL SELECT doc_id, seq, page, page, 'Table', '| table on ' || page || ' |' FROM tab)
SELECT doc_id || '-' || format('{{:04d}}', seq) AS chunk_id, page, end_page, kind, md5(text) AS text_md5 FROM every"""


def oracle_sql() -> dict[str, str]:
    return {
        "manifest_scan": """
SELECT n_nationkey::VARCHAR AS doc_id, n_name AS title, 'https://files.example/' || n_nationkey AS url, r_name AS cluster, (n_nationkey + 1)::INT AS expected_pages, '1998-03-05' AS published_on
FROM nation JOIN region ON n_regionkey = r_regionkey""",
        "document_enumeration": """
SELECT n_nationkey::VARCHAR AS doc_id, n_name AS title, n_nationkey || '.pdf' AS name, n_nationkey % 3 = 0 AS missing FROM nation
UNION ALL SELECT n_nationkey || '-SCAN', n_name || ' (scanned copy)', n_nationkey || '-scanned.pdf', false FROM nation WHERE n_nationkey % 4 = 0""",
        "fetch_status": """
SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'kept' WHEN turn % 3 = 0 THEN CASE WHEN text IS NULL THEN 'empty' ELSE 'fetched' END WHEN turn % 3 = 1 OR coalesce(text, '') = '' THEN 'empty' ELSE 'not a pdf' END AS status FROM conversations""",
        "layout_paragraphs": """
SELECT conv_id AS doc_id, turn AS seq, CASE WHEN turn % 4 < 3 THEN turn + 2 ELSE 1 END AS page,
  CASE turn % 8 WHEN 0 THEN 'Title' WHEN 1 THEN 'SectionHeading' WHEN 2 THEN 'Footnote' ELSE 'Body' END AS kind, md5(text) AS text_md5
FROM conversations WHERE turn % 8 NOT IN (3, 4, 5) AND turn % 9 <> 6 AND trim(coalesce(text, '')) <> ''""",
        "layout_tables": """
SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN turn + 1 END AS page, CASE WHEN turn % 3 = 2 THEN 'no page' WHEN turn % 4 = 1 THEN 'degenerate' END AS skipped FROM conversations""",
        "gold_questions": """
SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS case_id, 'q' || lpad(n_nationkey::VARCHAR, 2, '0') AS question, CASE WHEN n_nationkey % 5 <> 0 THEN n_regionkey::VARCHAR END AS "goldDocId",
  CASE WHEN n_nationkey % 5 <> 0 THEN (n_nationkey + 1)::VARCHAR ELSE '' END AS pages, n_nationkey % 5 <> 0 AS "isAnswerable" FROM nation""",
        "gold_recommendations": """
SELECT (row_number() OVER (ORDER BY n_regionkey::VARCHAR) - 1)::INT AS case_id, n_regionkey::VARCHAR AS "seedDocId", string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey::VARCHAR) AS relevant FROM nation GROUP BY n_regionkey""",
        "telemetry_since": f"""
SELECT user_id AS turn_id, md5(string_agg(event_type, ',' ORDER BY event_id)) AS functions_md5, CAST(sum(round(1000 * value)::BIGINT) AS BIGINT) AS duration_ms,
  CAST(coalesce(sum({_TOKENS}), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum({_TOKENS}), 0) AS BIGINT) AS tokens_out, NULL::DOUBLE AS cost FROM events WHERE event_id > 100 GROUP BY 1""",
        "result_file": """
WITH v AS (SELECT s_suppkey AS k, (s_suppkey % 8) / 8.0 AS v FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT '2024-01-01T00:00:00Z,qa,dense,' || k || ',share,' || regexp_replace(regexp_replace(format('{:.6f}', v::DOUBLE), '0+$', ''), '\\.$', '') AS line FROM v
UNION ALL SELECT '2024-01-01T00:00:00Z,qa,dense,MEAN,share,' || regexp_replace(regexp_replace(format('{:.6f}', avg(v::DOUBLE)), '0+$', ''), '\\.$', '') FROM v""",
        "session_state": f"""
WITH u AS (SELECT conv_id, turn, len({_terms("text")}) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, count(DISTINCT x) AS k FROM (SELECT conv_id, unnest([turn % 3, turn % 5]) AS x FROM u) GROUP BY 1)
SELECT conv_id AS session_id, max(n) AS turns, least(5, max(n)) AS n_recent, max(k) AS n_surfaced, round(sum(pow(0.8, n - i) * CASE WHEN i = 1 THEN 1.0 ELSE 0.2 END * t), 6) AS profile_sum FROM u JOIN s USING (conv_id) GROUP BY 1""",
        "summary_cache": """
WITH c AS (SELECT sha256(text) AS key, min(length(text)) AS value FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL GROUP BY 1)
SELECT doc_id AS id, sha256(text) AS key, value, value IS NOT NULL AS cached FROM documents LEFT JOIN c ON key = sha256(text) WHERE text IS NOT NULL""",
        "lineage_union": "SELECT s_suppkey AS doc_id, s_name AS title FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
        "incremental_lineage": f"WITH RECURSIVE {_TITLES}, {_COMPONENTS} SELECT doc_id, lineage_group FROM grp",
        "ingest_run": f"""
WITH w AS (SELECT doc_id, {_words("text")} AS ws FROM documents WHERE doc_id % 10 <> 7),
c AS (SELECT doc_id, ws, unnest(st) AS start, generate_subscripts(st, 1) - 1 AS seq FROM (SELECT doc_id, ws, {_windows("ws", 800, 120)} AS st FROM w))
SELECT doc_id, doc_id || '-' || format('{{:04d}}', seq) AS chunk_id, md5(array_to_string(ws[start + 1:start + 800], ' ')) AS text_md5 FROM c""",
        "lineage_listing": f"WITH RECURSIVE {_TITLES}, {_COMPONENTS} SELECT lineage_group, string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) AS members FROM grp GROUP BY 1",
        "sanity_cosines": """
WITH p AS (SELECT a, a + 7 * a % 40 + 1 AS b FROM (SELECT unnest(range(9)) AS a))
SELECT a, b, format('{:.4f}', round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 4) + 0.0) AS cosine FROM p JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b""",
        "chunks_with_tables": f"WITH {_PAGED}",
        "chunk_variable": f"""
WITH RECURSIVE w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT doc_id, {_SPLIT} AS ws FROM documents)),
s AS (SELECT doc_id, k, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY k) AS spent FROM w),
p AS (SELECT doc_id, list_prepend(0::HUGEINT, list(spent ORDER BY k)) AS p, count(*) AS n FROM s GROUP BY 1),
cut AS (
  SELECT doc_id, 0 AS seq, 0::BIGINT AS start, greatest(1, len(list_filter(p, lambda x: x <= 400)) - 1)::BIGINT AS stop FROM p
  UNION ALL
  SELECT doc_id, seq + 1, start, greatest(start + 1, len(list_filter(p, lambda x: x <= p[start + 1] + 400)) - 1)::BIGINT FROM (
    SELECT c.doc_id, c.seq, p.p, greatest(c.start + 1, least(c.stop, len(list_filter(p.p, lambda x: x < p.p[c.stop + 1] - 60))))::BIGINT AS start FROM cut c JOIN p ON p.doc_id = c.doc_id WHERE c.stop < n))
SELECT doc_id, seq::INT AS seq, start::INT AS start, stop::INT AS stop FROM cut""",
        "ingestion_counters": """
SELECT conv_id AS doc_id, count(*) AS pages, count(*) FILTER (turn % 3 = 0) AS ocr_pages, count(*) FILTER (conv_id % 5 <> 0 AND turn % 4 = 0) AS tables,
  count(*) FILTER (conv_id % 5 <> 0) AS chunks, conv_id % 5 = 0 AS skipped FROM conversations GROUP BY 1""",
        "section_spans": f"""
WITH p AS (SELECT conv_id, turn, turn % 4 = 1 AS heading, turn // 2 AS page, len({_SPLIT}) AS n FROM conversations),
i AS (SELECT *, sum(heading::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM p),
g AS (SELECT conv_id, island, min(page) AS page, max(page) FILTER (NOT heading) AS end_page, sum(n) FILTER (NOT heading)::BIGINT AS n_tokens FROM i GROUP BY 1, 2 HAVING count(*) FILTER (NOT heading) > 0)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY island) - 1 AS section, page, end_page, n_tokens FROM g""",
        "section_windows": f"""
WITH RECURSIVE para AS (SELECT conv_id, turn, turn % 4 = 1 AS heading, turn // 2 AS page, text, {_SPLIT} AS ws FROM conversations),
isl AS (SELECT *, sum(heading::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM para),
sec AS (
  SELECT conv_id, island, arg_min(page, turn) AS page, max(page) FILTER (NOT heading) AS end_page, max(text) FILTER (heading) AS heading,
    string_agg(text, chr(10) ORDER BY turn) FILTER (NOT heading) AS body FROM isl GROUP BY 1, 2 HAVING coalesce(sum(len(ws)) FILTER (NOT heading), 0) > 0),
w AS (SELECT conv_id, island, turn, page, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM isl WHERE NOT heading),
k AS (SELECT *, row_number() OVER o AS k, sum(length(w)) OVER o AS spent FROM w WINDOW o AS (PARTITION BY conv_id, island ORDER BY turn, i)),
p AS (SELECT conv_id, island, list_prepend(0::HUGEINT, list(spent ORDER BY k)) AS p, count(*) AS n, max(spent) AS total FROM k GROUP BY 1, 2),
cut AS (
  SELECT conv_id, island, 0::BIGINT AS a, greatest(1, len(list_filter(p, lambda x: x <= 200)) - 1)::BIGINT AS z FROM p WHERE total > 300
  UNION ALL
  SELECT conv_id, island, a, greatest(a + 1, len(list_filter(p, lambda x: x <= p[a + 1] + 200)) - 1)::BIGINT FROM (
    SELECT c.conv_id, c.island, p.p, greatest(c.a + 1, len(list_filter(p.p, lambda x: x < p.p[c.z + 1] - 40)))::BIGINT AS a
    FROM cut c JOIN p ON p.conv_id = c.conv_id AND p.island = c.island WHERE c.z < n)),
large AS (
  SELECT c.conv_id, c.island, c.a, arg_min(page, k) AS page, arg_max(page, k) AS end_page, string_agg(w, ' ' ORDER BY k) AS body
  FROM cut c JOIN k ON k.conv_id = c.conv_id AND k.island = c.island AND k.k > c.a AND k.k <= c.z GROUP BY 1, 2, 3),
every AS (
  SELECT s.conv_id, s.island, 0 AS a, s.page, s.end_page, heading, body FROM sec s JOIN p USING (conv_id, island) WHERE total <= 300
  UNION ALL SELECT l.conv_id, l.island, l.a, l.page, l.end_page, heading, l.body FROM large l JOIN sec s USING (conv_id, island)),
prose AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY island, a) - 1 AS seq, page, end_page, 'Prose' AS kind,
    CASE WHEN coalesce(heading, '') = '' THEN body ELSE heading || chr(10) || body END AS text FROM every),
made AS (SELECT conv_id, count(*) AS n FROM prose GROUP BY 1),
own AS (
  SELECT conv_id, 3 - turn AS page, row_number() OVER (PARTITION BY conv_id ORDER BY 3 - turn) - 1 AS behind FROM conversations WHERE conv_id % 3 = 0 AND turn <= 1)
SELECT conv_id, seq, page::BIGINT AS page, end_page::BIGINT AS end_page, kind, md5(text) AS text_md5 FROM prose
UNION ALL SELECT conv_id, coalesce(n, 0) + behind, page, page, 'Table', md5('| table on ' || page || ' |') FROM own LEFT JOIN made USING (conv_id)""",
        "layout_blocks": r"""
WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?(?:-->|\z)', '', 'g'),
  '(?is)<script\b.*?(?:</script>|\z)', '', 'g'), '(?is)<style\b.*?(?:</style>|\z)', '', 'g'), '(?is)<head\b.*?(?:</head>|\z)', '', 'g'), '(?is)<nav\b.*?(?:</nav>|\z)', '', 'g'),
  '(?is)<footer\b.*?(?:</footer>|\z)', '', 'g'), '(?is)<div class=.ad.>.*?(?:</div>|\z)', chr(1), 'g') AS h FROM pages),
marked AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?i)<h1\b[^>]*>', chr(1) || chr(2), 'g'), '(?i)</?(?:html|body|article|h1|p|ul|li|div|section)\b[^>]*>', chr(1), 'g'),
  '(?i)<br\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS h FROM bare),
piece AS (SELECT page_id, unnest(ps) AS t, generate_subscripts(ps, 1) AS i FROM (SELECT page_id, string_split(h, chr(1)) AS ps FROM marked)),
told AS (
  SELECT page_id, i, t LIKE chr(2) || '%' AS heading,
    trim(regexp_replace(replace(replace(replace(replace(replace(t, chr(2), ''), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM piece)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS seq, CASE WHEN heading THEN 'SectionHeading' ELSE 'Body' END AS kind, md5(text) AS text_md5 FROM told WHERE text <> ''""",
        "token_prefix": f"""
WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT doc_id, {_SPLIT} AS ws FROM documents)),
s AS (SELECT *, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY k) AS spent FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY k) AS t FROM s WHERE spent <= 2000 GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n, md5(coalesce(t, '')) AS prefix_md5 FROM documents d LEFT JOIN k USING (doc_id)""",
        "ocr_pages": """
SELECT conv_id AS doc, turn AS page, CASE WHEN (turn % 2 = 0 AND length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) < 120) OR length(text) % 100 / 100.0 < 0.90 THEN 'OcrProse' ELSE 'Prose' END AS kind FROM conversations""",
        "scan_pairs": "SELECT 'S' || s_suppkey AS native, 'S' || s_suppkey || '-SCAN' AS scan FROM supplier WHERE s_suppkey % 5 = 0",
        "recommendable": "SELECT 'S' || s_suppkey AS doc_id FROM supplier WHERE s_suppkey % 5 <> 0",
        "document_pages": "SELECT conv_id AS doc, turn + 1 AS page, row_number() OVER (ORDER BY turn) AS place FROM conversations WHERE conv_id = 3 AND turn + 1 BETWEEN 2 AND 5",
        "catalogue_files": """
WITH f AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_partkey % 2 = 0), i AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1)
SELECT s_suppkey AS doc_id, s_name AS title, CASE WHEN n IS NOT NULL THEN 'ingested' WHEN f.k IS NOT NULL THEN 'downloaded' ELSE 'missing' END AS state, coalesce(n, 0) AS chunk_count
FROM supplier LEFT JOIN f ON f.k = s_suppkey LEFT JOIN i ON i.k = s_suppkey""",
        "corpus_status": """
WITH i AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1)
SELECT 'S' || s_suppkey AS doc_id, s_name AS title, s_nationkey::VARCHAR AS cluster, p.p_partkey IS NOT NULL AS present, coalesce(p.p_size, 0)::BIGINT AS n_bytes, z.p_partkey IS NOT NULL AS has_scan,
  n IS NOT NULL AS ingested, coalesce(n, 0) AS chunk_count
FROM supplier LEFT JOIN part p ON p.p_partkey = s_suppkey AND p.p_partkey % 2 = 0 LEFT JOIN part z ON z.p_partkey = s_suppkey AND z.p_partkey % 7 = 0 LEFT JOIN i ON i.k = s_suppkey""",
        "unseen": """
SELECT session_id, doc_id FROM (SELECT DISTINCT user_id AS session_id FROM events), (SELECT unnest(range(20)) AS doc_id)
WHERE (session_id, doc_id) NOT IN (SELECT (user_id, event_id % 10) FROM events)""",
        "surfaced_sets": "SELECT session_id, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM (SELECT DISTINCT user_id AS session_id, event_id % 10 AS doc_id FROM events) GROUP BY 1",
        "turn_context": """
SELECT session_id, turn, call, passage FROM (
  SELECT *, max(call) OVER (PARTITION BY session_id, turn) AS last FROM (SELECT user_id AS session_id, strftime(ts, '%Y-%m-%d') AS turn, hour(ts) // 6 AS call, event_id AS passage FROM events)) WHERE call = last""",
        "chunk_hits": f"""
WITH {_HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS nth FROM hits)
SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS evidence, count(*) AS chunk_hits, min(rank) AS best_rank FROM n WHERE nth <= 5 GROUP BY 1, 2""",
        "hits_by_document": f"""
WITH {_HITS}
SELECT q.query_id, s_suppkey AS doc_id, coalesce(string_agg(rank || ':' || k % 3, ',' ORDER BY rank), '') AS hits
FROM supplier CROSS JOIN (SELECT unnest([1, 2]) AS query_id) q LEFT JOIN hits h ON h.query_id = q.query_id AND h.doc_id = s_suppkey GROUP BY 1, 2""",
        "ranked_documents": """
WITH l AS (
  SELECT p_brand AS query_id, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part
  UNION ALL SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) FROM part),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM l GROUP BY 1, 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id FROM f)
SELECT query_id, rank, id AS doc_id, p_name AS title FROM r JOIN part ON p_partkey = id WHERE id % 4 <> 0""",
        "passthrough_topk": """
WITH l AS (
  SELECT p_brand AS query_id, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part
  UNION ALL SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) FROM part),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM l GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place, id FROM f) WHERE place <= 5""",
        "affinity_rank": f"""
SELECT * FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY affinity DESC, doc_id) AS rank, doc_id, affinity FROM ({_AFFINITY})) WHERE rank <= 10""",
        "profile_affinity": """
SELECT l_suppkey AS session_id, l_linenumber AS doc_id, CASE WHEN l_suppkey % 3 = 2 THEN 0.0::DOUBLE ELSE round(max((l_quantity / 100.0 - 0.2)::DOUBLE), 6) END AS affinity FROM lineitem GROUP BY 1, 2""",
        "citation_violations": f"WITH {_ANSWERS} SELECT answer_id, nth, title AS cited_title, page AS cited_page, 'q' || answer_id AS question FROM cited WHERE NOT ok",
        "citation_panel": f"""
WITH {_ANSWERS},
m AS (
  SELECT answer_id, nth, turn + 1 AS p_page, turn + 1 = page AS on_page FROM cited JOIN conversations ON conv_id = answer_id
  WHERE contains('conversation number ' || answer_id, lower(title)) OR contains(lower(title), 'conversation number ' || answer_id)),
s AS (SELECT *, bool_or(on_page) OVER (PARTITION BY answer_id, nth) AS any_on FROM m)
SELECT answer_id, nth, p_page, on_page FROM s WHERE on_page OR NOT any_on""",
        "summary_replies": f"""
WITH r AS (SELECT conv_id, turn, turn % 5 <> 4 AND turn % 7 <> 6 AND trim(coalesce(text, ''), chr(10) || chr(13) || chr(9) || ' ') <> '' AS ok, trim(repeat(text || ' ', 4), chr(10) || chr(13) || chr(9) || ' ') AS text FROM conversations),
w AS (SELECT *, {_SPLIT} AS ws FROM r)
SELECT conv_id, turn, CASE WHEN ok THEN md5(CASE WHEN len(ws) <= 150 THEN trim(text) ELSE array_to_string(ws[:150], ' ') || ' […]' END) END AS summary_md5,
  CASE WHEN ok THEN array_to_string(list_transform(range(1, least(6, turn % 9 + 1) + 1), lambda i: 't' || i), ',') END AS topics FROM w""",
        "grade_replies": """
WITH g AS (SELECT conv_id, turn, greatest(0, least(10, (conv_id * 7 + turn * 5) % 16 - 2))::DOUBLE AS score FROM conversations WHERE turn % 6 <> 5)
SELECT conv_id, turn, 1 AS index, score FROM g UNION ALL SELECT conv_id, turn, 2, 4.5 FROM g""",
    }
