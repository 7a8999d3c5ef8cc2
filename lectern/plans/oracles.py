"""DuckDB SQL of the registered queries, written apart from the plans."""

from __future__ import annotations

from lectern.functions.text import MONTH_NAMES, STATUS_WORDS, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_EDITION = ", ".join(f"'{w}'" for w in STATUS_WORDS + MONTH_NAMES)


def _terms(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda t: t NOT IN ({_STOP}))"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '[\\s\\p{{Z}}\\x{{0B}}\\x{{85}}]+'), lambda w: w <> '')"


_BUCKET = "('0x' || substr(md5(t), 1, 8))::BIGINT % 64"


def _sparse(source: str, key: str, terms: str) -> str:
    """(key, b, n): token counts by bucket."""
    return f"SELECT {key}, b, count(*)::DOUBLE AS n FROM (SELECT {key}, {_BUCKET} AS b FROM (SELECT {key}, unnest({terms}) AS t FROM {source})) GROUP BY ALL"


_DENSE = """
WITH s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS id,
    round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) + 0.0 AS score
  FROM embeddings q JOIN embeddings r ON {on} WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM s)
"""


def _dense(on: str, k: int) -> str:
    return _DENSE.format(on=on) + f"SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM ranked WHERE rank <= {k}"


def _bm25(k: int) -> str:
    """CTEs up to bm(query_id, rank, id, score)."""
    return f"""
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_terms("text")}) AS term FROM benchmark) GROUP BY ALL),
terms AS (SELECT doc_id AS id, {_terms("text")} AS ts FROM documents),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM terms),
post AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM terms) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bs AS (
  SELECT query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN post USING (term) JOIN freq USING (term), stats GROUP BY query_id, id),
bm AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM bs) WHERE rank <= {k})"""


_VECTORS = f"""
qv AS ({_sparse("benchmark", "item_id", _terms("text"))}),
dv AS ({_sparse("documents", "doc_id", _terms("text"))}),
qn AS (SELECT item_id, sqrt(sum(n * n)) AS l FROM qv GROUP BY 1),
dn AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM dv GROUP BY 1),
dots AS (SELECT item_id, doc_id, sum(qv.n * dv.n) AS dot FROM qv JOIN dv USING (b) GROUP BY 1, 2),
sim AS (
  SELECT b.item_id AS query_id, d.doc_id AS id, coalesce(dot / (qn.l * dn.l), 0.0) AS sim
  FROM benchmark b CROSS JOIN documents d LEFT JOIN dots ON dots.item_id = b.item_id AND dots.doc_id = d.doc_id
  LEFT JOIN qn ON qn.item_id = b.item_id LEFT JOIN dn ON dn.doc_id = d.doc_id)"""

_HYBRID = f"""
WITH {_bm25(20)}, {_VECTORS},
dense AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, id) AS rank FROM sim) WHERE rank <= 20),
fused AS (
  SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score
  FROM (SELECT query_id, rank, id FROM dense UNION ALL SELECT query_id, rank, id FROM bm) GROUP BY ALL),
short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10),
asked AS (SELECT item_id AS query_id, list_distinct({_terms("text")}) AS ts FROM benchmark),
graded AS (
  SELECT s.query_id, s.id, s.rank, d.source AS doc,
    CASE WHEN len(ts) > 0 THEN round(10.0 * len(list_intersect(ts, {_terms("d.text")})) / len(ts), 6) ELSE 0.0 END AS grade
  FROM short s JOIN asked USING (query_id) JOIN documents d ON d.doc_id = s.id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS r2 FROM graded),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY r2) > 4 AS over FROM ordered),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over, r2) AS place FROM capped)
SELECT query_id, place, id, doc, round(grade, 4) AS grade FROM placed WHERE place <= 6
"""

_TITLES = f"""
cat AS (
  SELECT d.doc_id, d.lang AS cluster, d.n_chars, o.o_orderdate AS published,
    list_distinct(list_filter(list_transform(({_words("d.text")})[:8], lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')),
      lambda t: NOT regexp_full_match(t, '[\\p{{Nd}}]*') AND t NOT IN ({_EDITION})
        AND NOT (length(t) BETWEEN 2 AND 6 AND regexp_full_match(t, '\\p{{L}}{{1,3}}\\p{{Nd}}+')))) AS toks
  FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id),
v AS ({_sparse("documents", "doc_id", _words("lower(text)"))}),
vn AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM v GROUP BY 1),
tk AS (SELECT doc_id, cluster, len(toks) AS n, unnest(toks) AS t, published FROM cat),
gated AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM tk x JOIN tk y ON x.cluster = y.cluster AND x.t = y.t AND x.doc_id < y.doc_id
  WHERE abs(epoch_us(x.published) - epoch_us(y.published)) <= 730 * 86400000000
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING count(*)::DOUBLE / (x.n + y.n - count(*)) >= 0.55),
link AS (
  SELECT a, b FROM gated JOIN v x ON x.doc_id = a JOIN v y ON y.doc_id = b AND y.b = x.b
  JOIN vn p ON p.doc_id = a JOIN vn q ON q.doc_id = gated.b GROUP BY a, gated.b, p.l, q.l HAVING sum(x.n * y.n) / (p.l * q.l) > 0.95)"""
_TITLES = _TITLES.replace("SELECT a, b FROM gated JOIN", "SELECT a, gated.b AS b FROM gated JOIN").replace("y.doc_id = b AND", "y.doc_id = gated.b AND")

_COMPONENTS = """
both_ways AS (SELECT a AS u, b AS v FROM link UNION SELECT b, a FROM link),
walk AS (SELECT DISTINCT u AS id, u AS met FROM both_ways UNION SELECT walk.id, both_ways.v FROM walk JOIN both_ways ON both_ways.u = walk.met),
grp AS (SELECT id AS doc_id, min(met) AS lineage_group FROM walk GROUP BY id)"""

_SHORT = _DENSE.format(on="true") + """,
short AS (
  SELECT * FROM (SELECT query_id, id AS doc_id, score AS seed_sim, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth
    FROM ranked WHERE rank <= 21 AND id <> query_id) WHERE nth <= 20),
pair AS (
  SELECT x.query_id, x.doc_id AS i, y.doc_id AS j, round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim
  FROM short x JOIN short y ON x.query_id = y.query_id JOIN embeddings p ON p.vec_id = x.doc_id JOIN embeddings q ON q.vec_id = y.doc_id)"""


_AMONG_SHORT = "(SELECT max(sim) FROM pair WHERE pair.query_id = s.query_id AND pair.i = s.doc_id AND pair.j IN (SELECT doc_id FROM ({before}) b WHERE b.query_id = s.query_id))"


def _mmr(lam: float, tag: str, k: int = 5, among: str = _AMONG_SHORT) -> str:
    """CTEs pick{tag}1 .. pick{tag}k, unrolled; ``among``: similarity to the closest pick, which counts from 0 up."""
    out = []
    for n in range(1, k + 1):
        before = " UNION ALL ".join(f"SELECT query_id, doc_id FROM pick{tag}{i}" for i in range(1, n))
        closest = f"greatest(0.0::DOUBLE, {among.format(before=before)})" if n > 1 else "0.0"
        left = f"WHERE NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.query_id = s.query_id AND b.doc_id = s.doc_id)" if n > 1 else ""
        out.append(
            f"pick{tag}{n} AS (SELECT query_id, doc_id, seed_sim, {n} AS pick FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
            f"ORDER BY round({lam}::DOUBLE * seed_sim - (1 - {lam}::DOUBLE) * closest, 9) DESC, seed_sim DESC, doc_id) AS r FROM "
            f"(SELECT s.*, {closest} AS closest FROM short s {left})) WHERE r = 1)"
        )
    return ",\n".join(out)


def _picked(tag: str, columns: str, k: int = 5) -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM pick{tag}{i}" for i in range(1, k + 1))


_LISTS = """
lists AS (
  SELECT * FROM (SELECT query_id AS case_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, id AS doc
    FROM ranked WHERE rank <= 7 AND id <> query_id) WHERE rank <= 6),
gold AS (SELECT s.vec_id AS case_id, g.vec_id AS doc FROM embeddings s JOIN embeddings g ON s.label = g.label AND s.vec_id <> g.vec_id WHERE s.vec_id % 20 = 0),
cases AS (SELECT vec_id AS case_id FROM embeddings WHERE vec_id % 20 = 0),
size AS (SELECT case_id, count(*) AS n_gold FROM gold GROUP BY 1),
judged AS (
  SELECT c.case_id, n_gold, l.rank, CASE WHEN g.doc IS NULL THEN 0 ELSE 1 END AS hit FROM cases c LEFT JOIN size USING (case_id)
  LEFT JOIN lists l ON l.case_id = c.case_id LEFT JOIN gold g ON g.case_id = l.case_id AND g.doc = l.doc),
per AS (
  SELECT case_id, n_gold, max(hit) FILTER (rank <= 5) AS recall, avg(hit) FILTER (rank <= 5) AS prec,
    sum(hit / log2(rank + 1)) FILTER (rank <= 5) AS dcg, min(rank) FILTER (hit = 1) AS first FROM judged GROUP BY 1, 2),
m AS (
  SELECT 'recall@5' AS metric, case_id, CASE WHEN n_gold > 0 THEN round(coalesce(recall, 0)::DOUBLE, 6) END AS value FROM per
  UNION ALL SELECT 'precision@5', case_id, CASE WHEN n_gold > 0 THEN round(prec, 6) END FROM per
  UNION ALL SELECT 'ndcg@5', case_id, CASE WHEN n_gold > 0 THEN round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(5, n_gold) + 1), lambda i: 1 / log2(i + 1))), 6) END FROM per
  UNION ALL SELECT 'mrr', case_id, CASE WHEN n_gold > 0 THEN round(coalesce(1.0 / first, 0), 6) END FROM per)"""

_METRICS = _DENSE.format(on="true") + "," + _LISTS


def _arm(name: str, on: str) -> str:
    return f"(WITH {_DENSE.format(on=on).strip()[5:]}, {_LISTS} SELECT '{name}' AS config, metric, avg(value) AS value FROM m WHERE value IS NOT NULL GROUP BY metric)"


def _windows(words: str, window: int, overlap: int) -> str:
    return f"CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) <= {window} THEN [0] ELSE list_transform(range(0, 1 + ceil((len({words}) - {window}) / {window - overlap}.0)::BIGINT), lambda i: i * {window - overlap}) END"


_PAGES = """
bare AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'),
  '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '(?is)<nav\\b.*?</nav>', '', 'g'), '(?is)<footer\\b.*?</footer>', '', 'g'),
  '(?is)<head\\b.*?</head>', '', 'g'), '(?is)<div class=.ad.>.*?</div>', '', 'g') AS h FROM pages),
cutp AS (SELECT page_id, unnest(p) AS piece, generate_subscripts(p, 1) AS seq FROM (SELECT page_id, string_split_regex(regexp_replace(h, '(?i)(<h1>|<p>)', chr(1) || '\\1', 'g'), chr(1)) AS p FROM bare)),
para AS (
  SELECT page_id, seq, lower(piece) LIKE '<h1>%' AS heading, trim(regexp_replace(regexp_replace(piece, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM cutp),
isl AS (SELECT *, sum(heading::INT) OVER (PARTITION BY page_id ORDER BY seq) AS island FROM para WHERE text <> ''),
sec AS (
  SELECT page_id, island, max(text) FILTER (heading) AS heading, string_agg(text, chr(10) ORDER BY seq) FILTER (NOT heading) AS body
  FROM isl GROUP BY 1, 2 HAVING count(*) FILTER (NOT heading) > 0)"""

_AFFINITY = f"""
WITH r AS (SELECT * FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'user') WHERE k <= 5),
rv AS ({_sparse("(SELECT conv_id * 1000 + turn AS k, text FROM r)", "k", _terms("text"))}),
qv AS ({_sparse("benchmark", "item_id", _terms("text"))}),
rn AS (SELECT k, sqrt(sum(n * n)) AS l FROM rv GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(n * n)) AS l FROM qv GROUP BY 1),
dots AS (SELECT rv.k, item_id, sum(rv.n * qv.n) AS dot FROM rv JOIN qv USING (b) GROUP BY 1, 2),
sim AS (
  SELECT conv_id AS session_id, i.item_id AS doc_id, coalesce(dot / (rn.l * qn.l), 0.0) AS sim FROM r CROSS JOIN benchmark i
  LEFT JOIN dots ON dots.k = conv_id * 1000 + turn AND dots.item_id = i.item_id LEFT JOIN rn ON rn.k = conv_id * 1000 + turn LEFT JOIN qn ON qn.item_id = i.item_id)
SELECT session_id, doc_id, round(max(sim), 6) AS affinity FROM sim GROUP BY 1, 2"""

_PHONE = "(^|[^\\w.-])\\+?\\d(?:[ -.]?\\(?\\d\\)?){8,13}(\\W|$)"

_MICROS = "round(1000 * value)::BIGINT"


def oracle_sql() -> dict[str, str]:
    from lectern.plans import eval_queries, ingest_oracles, tool_oracles

    tokens = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    return tool_oracles.oracle_sql() | ingest_oracles.oracle_sql() | eval_queries.oracle_sql() | {
        "dense_topk": _dense("true", 20),
        "dense_topk_filtered": _dense("q.label = r.label", 20),
        "bm25_topk": f"WITH {_bm25(20)} SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM bm",
        "rrf_fuse": """
WITH l AS (
  SELECT p_brand AS query_id, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part
  UNION ALL SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) FROM part),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM l GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM f""",
        "hybrid_topk": _HYBRID,
        "diversity_cap": """
WITH r AS (SELECT lang AS query_id, doc_id AS id, source AS doc, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY rank) > 4 AS over FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over, rank) AS place FROM c)
SELECT query_id, place, rank, id, doc FROM p WHERE place <= 6""",
        "read_pages": "SELECT conv_id AS doc, turn + 1 AS page, length(text) AS n_chars FROM conversations WHERE turn + 1 BETWEEN 2 AND 6",
        "resolve_id": """
WITH r AS (SELECT unnest(['Supplier#000000003', ' supplier#000000007 ', '000000009', 'Supplier#00000000', 'no such supplier', '', '5']) AS request),
m AS (
  SELECT request, s_suppkey AS id, lower(s_name) = lower(trim(request)) OR s_suppkey::VARCHAR = lower(trim(request)) AS exact
  FROM r JOIN supplier ON trim(request) <> '' AND (contains(lower(s_name), lower(trim(request))) OR s_suppkey::VARCHAR = lower(trim(request)))),
g AS (SELECT request, min(id) FILTER (exact) AS e, count(*) AS n, min(id) AS one, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM m GROUP BY 1)
SELECT r.request, CASE WHEN e IS NOT NULL OR n = 1 THEN 'match' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status,
  coalesce(e, CASE WHEN n = 1 THEN one END) AS doc_id, CASE WHEN e IS NULL AND n > 1 THEN ids END AS ambiguous FROM r LEFT JOIN g USING (request)""",
        "embedding_cache_misses": "SELECT DISTINCT sha256('hash-64' || chr(10) || text) AS key FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM conversations WHERE text IS NOT NULL)",
        "newest_upsert": "SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
        "catalogue_status": "SELECT s_suppkey AS doc_id, s_name AS title, count(l_suppkey) > 0 AS ingested, count(l_suppkey) AS chunk_count FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2",
        "chunk_fixed": f"""
WITH w AS (SELECT doc_id, {_words("text")} AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(st) AS start, generate_subscripts(st, 1) - 1 AS seq FROM (SELECT doc_id, ws, {_windows("ws", 800, 120)} AS st FROM w))
SELECT doc_id, doc_id || '-' || format('{{:04d}}', seq) AS chunk_id, start, len(ws[start + 1:start + 800]) AS n_tokens, md5(array_to_string(ws[start + 1:start + 800], ' ')) AS text_md5 FROM c""",
        "chunk_sections": f"""
WITH {_PAGES},
w AS (SELECT * FROM (SELECT *, {_words("body")} AS ws FROM sec) WHERE len(ws) > 0),
c AS (SELECT page_id, island, heading, body, ws, unnest(st) AS start FROM (SELECT *, CASE WHEN len(ws) <= 100 THEN [0] ELSE {_windows("ws", 60, 10)} END AS st FROM w)),
t AS (SELECT page_id, island, start, heading, CASE WHEN len(ws) <= 100 THEN body ELSE array_to_string(ws[start + 1:start + 60], ' ') END AS part FROM c)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY island, start) - 1 AS seq, heading,
  md5(CASE WHEN heading IS NULL THEN part ELSE heading || chr(10) || part END) AS text_md5 FROM t""",
        "page_text": "SELECT conv_id AS doc_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5, round(coalesce(avg(length(text) / 1000.0) FILTER (role = 'assistant'), 1.0), 6) AS mean_confidence FROM conversations GROUP BY 1",
        "ocr_classify": "SELECT conv_id, turn, CASE WHEN length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) >= 50 THEN 'Prose' ELSE 'OcrProse' END AS kind FROM conversations",
        "summary_trim": f"""
WITH w AS (SELECT doc_id, ({_words("text")})[:6000] AS ws FROM documents)
SELECT doc_id, md5(CASE WHEN len(ws) <= 150 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[:150], ' ') || ' […]' END) AS summary_md5 FROM w""",
        "composite_text": "SELECT p_partkey, 'Title: ' || p_name || chr(10) || 'Topics: ' || p_brand || ', ' || p_type || chr(10) || 'Summary: size ' || p_size AS text FROM part",
        "formula_restore": "SELECT n_nationkey, n_name || ' ' || CASE WHEN n_regionkey % 2 = 0 THEN '\\[ ' || n_name || ' \\]' ELSE '\\( ' || n_name || ' \\)' END || ' and :formula:, then :formula:' AS text FROM nation",
        "table_markdown": """
SELECT r_regionkey AS table_id, '| ' || r_name || ' | ' || r_name || ' |' || chr(10) || '| --- | --- |' || chr(10) ||
  string_agg('| ' || n_nationkey || ' | ' || n_name || '\\|x |', chr(10) ORDER BY n_nationkey) AS markdown
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
        # RE2 has no look-around: the characters beside a phone are matched and put back, and a second pass
        # finds a phone that begins right behind the character the first one took
        "pii_redact": f"""
WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}', '[email redacted]', 'g'),
  '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b', '[id redacted]', 'g'), '\\b\\d(?:[ -]?\\d){{12,15}}\\b', '[number redacted]', 'g') AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(t, '{_PHONE}', '\\1[number redacted]\\2', 'g') AS t FROM b)
SELECT doc_id, md5(regexp_replace(t, '{_PHONE}', '\\1[number redacted]\\2', 'g')) AS redacted_md5 FROM c""",
        "pii_redact_base": """
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}', '[email redacted]', 'g'),
  '\\b\\d{3}-\\d{2}-\\d{4}\\b', '[id redacted]', 'g'), '\\b\\d(?:[ -]?\\d){12,15}\\b', '[number redacted]', 'g')) AS redacted_md5 FROM documents""",
        "citation_guard": """
WITH c AS (SELECT conv_id AS answer_id, bool_or(turn = 0) AS p1, bool_or(turn = 2) AS p3 FROM conversations GROUP BY 1),
t AS (
  SELECT answer_id, '[Conversation num, p.1]' AS ta, '[CONVERSATION NUMBER ' || answer_id || ', p.3]' AS tb, '[Convers, p.1]' AS tc, '[Elsewhere entirely, p.2]' AS td, p1, p3 FROM c)
SELECT answer_id, 'One ' || CASE WHEN p1 THEN ta ELSE '' END || ' two ' || CASE WHEN p3 THEN tb ELSE '' END || ' three  four  five .' || chr(10) || chr(10) || '[warning: removed ' ||
  (3 + (NOT p1)::INT + (NOT p3)::INT) || ' citation(s) not supported by the retrieved passages: ' || CASE WHEN p1 THEN '' ELSE ta || ', ' END || CASE WHEN p3 THEN '' ELSE tb || ', ' END ||
  tc || ', ' || td || ']' AS guarded, 3 + (NOT p1)::INT + (NOT p3)::INT AS removed FROM t""",
        "centroid": """
WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings WHERE label IS NOT NULL),
m AS (SELECT label, pos, avg(v) AS v FROM u GROUP BY 1, 2)
SELECT label, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS value FROM m""",
        "lineage_groups": f"WITH RECURSIVE {_TITLES}, {_COMPONENTS} SELECT doc_id, lineage_group FROM grp",
        "near_dup_groups": f"""
WITH RECURSIVE {_TITLES}, {_COMPONENTS},
r AS (SELECT cluster AS query_id, doc_id, lineage_group, published, row_number() OVER (PARTITION BY cluster ORDER BY n_chars DESC, doc_id) AS rank FROM cat LEFT JOIN grp USING (doc_id)),
k AS (SELECT *, coalesce('g' || lineage_group, 'd' || doc_id) AS key FROM r),
b AS (SELECT *, min(rank) OVER (PARTITION BY query_id, key) AS best_rank, row_number() OVER (PARTITION BY query_id, key ORDER BY published DESC NULLS LAST, doc_id) AS newest FROM k),
s AS (SELECT query_id, key, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (newest > 1) AS suppressed FROM b GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY best_rank) AS rank, best_rank, doc_id, coalesce(suppressed, '') AS suppressed FROM b JOIN s USING (query_id, key) WHERE newest = 1""",
        "rec_score": f"""
WITH {_bm25(10)}, {_VECTORS},
w AS (SELECT doc_id, len({_words("text")}) AS n FROM documents),
c AS (
  SELECT query_id, s.id AS doc_id, sim AS doc_sim, coalesce(o_orderdate, TIMESTAMP '1990-01-01') AS published,
    CASE WHEN n = 0 THEN 0 WHEN n <= 800 THEN 1 ELSE 1 + ceil((n - 800) / 680.0) END AS chunks
  FROM sim s JOIN w ON w.doc_id = s.id LEFT JOIN orders ON o_orderkey = s.id),
h AS (SELECT query_id, id AS doc_id, 1.0::DOUBLE / (60 + rank) AS e FROM bm),
x AS (SELECT c.*, coalesce(e, 0) / sqrt(greatest(1, chunks)) AS raw, (e IS NOT NULL)::BIGINT AS hits FROM c LEFT JOIN h USING (query_id, doc_id)),
y AS (
  SELECT *, CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE 0 END AS agg,
    0.3 + 0.7 * exp(-greatest(0, (epoch_us(TIMESTAMP '2000-01-01') - epoch_us(published)) / 86400e6) / 1000) AS rec FROM x),
z AS (SELECT *, round(0.5::DOUBLE * doc_sim + 0.3::DOUBLE * agg + 0.2::DOUBLE * rec, 6) AS score FROM y)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score, round(doc_sim, 6) AS doc_sim,
  round(agg, 6) AS chunk_aggregate, round(rec, 6) AS recency, hits AS chunk_hits FROM z""",
        "rec_reasons": """
WITH n AS (SELECT n_nationkey AS k, n_name, upper(r_name) AS up, (n_nationkey % 5) / 4.0 AS s, (n_nationkey % 3) / 2.0 AS c, (n_nationkey % 7) / 6.0 AS r FROM nation JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT *, CASE WHEN k % 2 = 0 THEN up ELSE n_name END AS topic, 0.5::DOUBLE * s AS a, 0.3::DOUBLE * c AS b, 0.2::DOUBLE * r AS d FROM n)
SELECT k AS n_nationkey, CASE
  WHEN k % 4 > 0 AND b >= a AND b >= d THEN 'Covers ' || topic || ' in depth (' || k % 4 || CASE WHEN k % 4 = 1 THEN ' strong match, ' ELSE ' strong matches, ' END ||
    CASE WHEN k % 2 = 0 THEN 'p. ' || (k + 1) ELSE 'pp. ' || (k + 1) || '-' || (k + 2) END || ')'
  WHEN a >= d THEN CASE WHEN k % 2 = 0 THEN 'Strong topical overlap on ' || up ELSE 'Closely related to ' || n_name END
  ELSE 'A recent take on ' || topic || ' (published Mar 1998)' END ||
  CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN ', which your last one question circled around' ELSE ', which your last two questions circled around' END || '.' ||
  CASE WHEN k % 6 = 0 THEN ' Supersedes ' || k || ', Nov 1997.' ELSE '' END AS reason FROM t""",
        "mmr_topk": f"{_SHORT},\n{_mmr(0.7, 'a')}\nSELECT query_id, doc_id, seed_sim, pick FROM ({_picked('a', 'query_id, doc_id, seed_sim, pick')})",
        "lambda_sweep": f"{_SHORT},\n{_mmr(1.0, 'a')},\n{_mmr(0.7, 'b')},\n{_mmr(0.3, 'c')}\nSELECT * FROM ("
        + " UNION ALL ".join(_picked(t, f"{lam}::DOUBLE AS lam, query_id, pick, doc_id") for t, lam in (("a", 1.0), ("b", 0.7), ("c", 0.3)))
        + ")",
        "recent_queries": "SELECT * FROM (SELECT conv_id AS session_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM conversations WHERE role = 'user') WHERE recency <= 5",
        "session_profile": f"""
WITH u AS (SELECT conv_id, turn, {_terms("text")} AS ts, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user'),
w AS (SELECT *, pow(0.8, n - i) * CASE WHEN i = 1 THEN 1.0 ELSE 0.2 END AS w FROM u),
b AS (SELECT conv_id, w, {_BUCKET} AS b FROM (SELECT conv_id, w, unnest(ts) AS t FROM w)),
s AS (SELECT conv_id, b, sum(w) AS v FROM b GROUP BY 1, 2)
SELECT c.conv_id AS session_id, p.pos AS pos, round(coalesce(v, 0), 6) AS value FROM (SELECT DISTINCT conv_id FROM u) c CROSS JOIN (SELECT unnest(range(64)) AS pos) p
LEFT JOIN s ON s.conv_id = c.conv_id AND s.b = p.pos""",
        "affinity": _AFFINITY,
        "turn_metrics": f"""
SELECT user_id AS turn_id, md5(string_agg(event_type, ',' ORDER BY event_id)) AS functions_md5, CAST(sum({_MICROS}) AS BIGINT) AS duration_ms,
  CAST(coalesce(sum({tokens}), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(2 * {tokens}), 0) AS BIGINT) AS tokens_out,
  CAST(sum({tokens} * 135) AS BIGINT) AS cost_e8 FROM events GROUP BY 1""",
        "rec_metrics": _METRICS + " SELECT metric, case_id, value FROM m",
        "catalogue_coverage": _METRICS + """, f AS (SELECT doc, min(case_id) AS case_id FROM lists GROUP BY 1), c AS (SELECT case_id, count(*) AS n FROM f GROUP BY 1)
SELECT l.case_id, round(sum(coalesce(n, 0)) OVER (ORDER BY l.case_id) / (SELECT count(*) FROM embeddings), 6) AS value FROM (SELECT DISTINCT case_id FROM lists) l LEFT JOIN c USING (case_id)""",
        "intra_list_diversity": _METRICS + """
SELECT x.case_id, round(1 - avg(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS value FROM lists x JOIN lists y ON x.case_id = y.case_id AND x.rank < y.rank
JOIN embeddings p ON p.vec_id = x.doc JOIN embeddings q ON q.vec_id = y.doc GROUP BY 1""",
        "duplicate_leakage": _METRICS + """
SELECT case_id, CASE WHEN max(n) >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM (SELECT case_id, label, count(*) FILTER (label < 5) AS n FROM lists JOIN embeddings ON vec_id = doc GROUP BY 1, 2) GROUP BY 1""",
        "ablation_pivot": f"""
WITH arms AS ({_arm("dense", "true")} UNION ALL {_arm("filtered", "q.label = r.label")}), t AS (SELECT config, metric, format('{{:.3f}}', round(value, 6)) AS v FROM arms)
SELECT metric, coalesce(max(v) FILTER (config = 'dense'), '—') AS dense, coalesce(max(v) FILTER (config = 'filtered'), '—') AS filtered FROM t GROUP BY metric""",
        "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(round(sum(value), 4), 2) AS total FROM events GROUP BY 1, 2",
    }
