"""DuckDB SQL of the public functions' queries, written apart from the plans."""

from __future__ import annotations

from lectern.plans.oracles import _SHORT, _VECTORS, _bm25, _mmr, _picked, _sparse, _terms, _words

_GROUP = "CASE WHEN {id} % 10 < 2 THEN {id} - {id} % 10 END"
_AGE = "0.3 + 0.7 * exp(-greatest(0, (epoch_us(TIMESTAMP '2000-01-01') - epoch_us(published)) / 86400e6) / 1000)"

_VECTOR_STORE = f"""
store AS (
  SELECT vec_id AS doc_id, 'Vector ' || vec_id AS title, ['label ' || coalesce(label, -1)] AS topics, {_GROUP.format(id="vec_id")} AS grp,
    coalesce(o_orderdate, TIMESTAMP '1990-01-01') AS published, embedding::DOUBLE[] AS e
  FROM embeddings LEFT JOIN orders ON o_orderkey = vec_id WHERE embedding IS NOT NULL)"""


def _dense_arrays(source: str, key: str, terms: str) -> str:
    """(key, e): token counts by bucket as a list of 64."""
    return f"""SELECT k.{key}, list(coalesce(n, 0.0) ORDER BY p) AS e
  FROM (SELECT {key} FROM {source}) k CROSS JOIN (SELECT unnest(range(64)) AS p) LEFT JOIN ({_sparse(source, key, terms)}) s ON s.{key} = k.{key} AND s.b = p GROUP BY k.{key}"""


def _cos(x: str, y: str) -> str:
    return f"CASE WHEN list_dot_product({x}, {x}) > 0 AND list_dot_product({y}, {y}) > 0 THEN list_dot_product({x}, {y}) / (sqrt(list_dot_product({x}, {x})) * sqrt(list_dot_product({y}, {y}))) ELSE 0.0 END"


_DOC_STORE = f"""
vecs AS ({_dense_arrays("documents", "doc_id", _terms("text"))}),
store AS (
  SELECT d.doc_id, 'Document ' || d.doc_id AS title, [coalesce(lang, '-'), coalesce(source, '-')] AS topics, {_GROUP.format(id="d.doc_id")} AS grp,
    coalesce(o_orderdate, TIMESTAMP '1990-01-01') AS published, e,
    CASE WHEN n = 0 THEN 0 WHEN n <= 800 THEN 1 ELSE 1 + ceil((n - 800) / 680.0) END AS chunks
  FROM (SELECT *, len({_words("text")}) AS n FROM documents) d JOIN vecs USING (doc_id) LEFT JOIN orders ON o_orderkey = d.doc_id)"""


def _resolved(ceiling: float, pair: str) -> str:
    """CTEs from ranked(query_id, n, doc_id) and seeds(query_id, seed_id, seed_group, seed_e) to kept(query_id, doc_id, key, place)."""
    return f"""
keyed AS (
  SELECT r.query_id, r.n, r.doc_id, grp, published, e, seed_e, coalesce('g' || grp, 'd' || r.doc_id) AS key
  FROM ranked r JOIN store USING (doc_id) LEFT JOIN seeds s ON s.query_id = r.query_id
  WHERE NOT coalesce(r.doc_id = seed_id, false) AND NOT coalesce(grp = seed_group, false)),
best AS (
  SELECT *, min(n) OVER (PARTITION BY query_id, key) AS best_n, row_number() OVER (PARTITION BY query_id, key ORDER BY published DESC NULLS LAST, doc_id) AS newest FROM keyed),
surv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_n) AS k FROM best WHERE newest = 1),
older AS (
  SELECT query_id, key, string_agg(' Supersedes ' || doc_id || ', ' || strftime(published, '%b %Y') || '.', '' ORDER BY n) AS said,
    string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM best WHERE newest > 1 GROUP BY 1, 2),
allp AS MATERIALIZED (SELECT x.doc_id AS i, y.doc_id AS j, {pair} AS exact FROM store x JOIN store y ON x.doc_id <> y.doc_id),
closep AS MATERIALIZED (SELECT i, j FROM allp WHERE exact > {ceiling}),
near AS (SELECT x.query_id, x.doc_id, list(y.doc_id) AS close FROM surv x JOIN closep ON i = x.doc_id JOIN surv y ON y.doc_id = j AND x.query_id = y.query_id AND y.k < x.k GROUP BY 1, 2),
cand AS (
  SELECT s.query_id, s.k, s.doc_id, grp IS NULL AS alone, coalesce(close, []) AS close, seed_e IS NOT NULL AND {_cos("s.e", "seed_e")} > {ceiling} AS at_seed
  FROM surv s LEFT JOIN near USING (query_id, doc_id)),
greedy AS (
  SELECT DISTINCT query_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM cand
  UNION ALL
  SELECT g.query_id, c.k, CASE WHEN alone AND (at_seed OR len(list_intersect(close, kept)) > 0) THEN kept ELSE list_append(kept, c.doc_id) END
  FROM greedy g JOIN cand c ON c.query_id = g.query_id AND c.k = g.k + 1),
final AS (SELECT query_id, arg_max(kept, k) AS kept FROM greedy GROUP BY 1),
kept AS (
  SELECT s.query_id, s.doc_id, s.key, row_number() OVER (PARTITION BY s.query_id ORDER BY s.k) AS place FROM surv s JOIN final f ON f.query_id = s.query_id AND list_contains(f.kept, s.doc_id))"""


_PAIR = _cos("x.e", "y.e")


#: Similarity to the closest of ``before`` (query_id, doc_id), from the pairs of all documents.
_AMONG_ALL = "(SELECT max(round(exact, 6)) FROM allp JOIN ({before}) b ON b.doc_id = allp.j WHERE b.query_id = s.query_id AND allp.i = s.doc_id)"


def _explained(topics: str, first: str, related: str, pages: str) -> str:
    """CTEs from kept, ranked, store and asked(query_id, e, recent) to told(query_id, pick, doc_id, title, topics, score, reason, signals).

    ``topics``: SQL list of the context's topics.
    """
    return f"""
short AS (SELECT k.query_id, k.doc_id, round({_cos("a.e", "s.e")}, 6) AS seed_sim FROM kept k JOIN asked a USING (query_id) JOIN store s USING (doc_id)),
{_mmr(0.7, "t", 5, _AMONG_ALL)},
picks AS ({_picked("t", "query_id, doc_id, pick")}),
joined AS (
  SELECT p.query_id, p.pick, p.doc_id, s.title, s.topics, s.published, r.score, r.sim, r.agg, r.rec, r.hits, r.best, a.recent, coalesce(o.said, '') AS said,
    {first} AS first_page, {pages} AS last_page, list_filter(s.topics, lambda t: list_contains(list_transform({topics}, lambda c: lower(c)), lower(t))) AS overlap
  FROM picks p JOIN store s USING (doc_id) JOIN ranked r ON r.query_id = p.query_id AND r.doc_id = p.doc_id JOIN asked a ON a.query_id = p.query_id
  JOIN kept k ON k.query_id = p.query_id AND k.doc_id = p.doc_id LEFT JOIN older o ON o.query_id = p.query_id AND o.key = k.key),
told AS (
  SELECT *, CASE
    WHEN hits > 0 AND 0.3::DOUBLE * agg >= 0.5::DOUBLE * sim AND 0.3::DOUBLE * agg >= 0.2::DOUBLE * rec THEN 'Covers ' || coalesce(overlap[1], topics[1]) || ' in depth (' || hits ||
      CASE WHEN hits = 1 THEN ' strong match, ' ELSE ' strong matches, ' END ||
      CASE WHEN first_page IS NULL THEN 'no pages' WHEN first_page = last_page THEN 'p. ' || first_page ELSE 'pp. ' || first_page || '-' || last_page END || ')'
    WHEN 0.5::DOUBLE * sim >= 0.2::DOUBLE * rec THEN CASE WHEN len(overlap) > 0 THEN 'Strong topical overlap on ' || array_to_string(overlap, ', ') ELSE '{related}' || coalesce(overlap[1], topics[1]) END
    ELSE 'A recent take on ' || coalesce(overlap[1], topics[1]) || ' (published ' || strftime(published, '%b %Y') || ')' END ||
    CASE WHEN recent > 0 THEN ', which your last ' || ['one', 'two', 'three', 'four', 'five'][recent] || CASE WHEN recent = 1 THEN ' question' ELSE ' questions' END || ' circled around' ELSE '' END
    || '.' || said AS reason,
    format('docSim={{:.3f}}*0.5 chunkAgg={{:.3f}}*0.3 recency={{:.3f}}*0.2 hits={{}} bestRank={{}}', sim, agg, rec, hits::INT, best::INT) AS signals
  FROM joined)"""


def _lines(empty: str) -> str:
    return f"""
SELECT a.query_id, coalesce(string_agg(pick || '. ' || title || ' [' || doc_id || '] — score ' || format('{{:.2f}}', score) || chr(10) || '   ' || reason || chr(10) || '   topics: ' ||
  array_to_string(topics, ', ') || chr(10) || '   signals: ' || signals, chr(10) ORDER BY pick), '{empty}') AS answer
FROM (SELECT query_id FROM everyone) a LEFT JOIN told USING (query_id) GROUP BY a.query_id"""


def _top(score: str, source: str) -> str:
    """ranked(query_id, n, doc_id, score, ...): all of ``source`` with the columns sim, agg, rec, hits, best."""
    return f"ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM (SELECT *, {score} AS score FROM {source})))"


_MORE = f"""
WITH RECURSIVE {_VECTOR_STORE},
seeds AS (SELECT doc_id AS query_id, doc_id AS seed_id, grp AS seed_group, e AS seed_e, topics AS seed_topics FROM store WHERE doc_id % 100 IN (0, 55)),
everyone AS (SELECT query_id FROM seeds),
asked AS (SELECT query_id, seed_e AS e, 0 AS recent, seed_topics AS context FROM seeds),
raw AS (SELECT q.query_id, s.doc_id, {_cos("seed_e", "s.e")} AS exact, {_AGE} AS age FROM seeds q CROSS JOIN store s),
{_top("round(0.5::DOUBLE * exact + 0.2::DOUBLE * age, 6)", "(SELECT *, round(exact, 6) AS sim, 0.0::DOUBLE AS agg, round(age, 6) AS rec, 0 AS hits, 0 AS best FROM raw)")},
{_resolved(0.95, _PAIR)},
{_explained("a.context", "NULL::INT", "Closely related to ", "NULL::INT")}
{_lines("No recommendations available.")}"""

_SCOPE = "CASE WHEN item_id % 10 = 0 THEN 'nowhere' ELSE 'src' || item_id % 20 END"


def _search(scoped: bool, k: int) -> str:
    """CTEs to placed(query_id, place, id, doc, grade, scope), after bs, sim and the vectors."""
    scope = _SCOPE if scoped else "NULL::VARCHAR"
    inside = "WHERE scope IS NULL OR scope = source" if scoped else ""
    return f"""
items AS (SELECT item_id AS query_id, text, {scope} AS scope FROM benchmark),
lex AS (SELECT * FROM (SELECT bs.query_id, id, row_number() OVER (PARTITION BY bs.query_id ORDER BY score DESC, id) AS rank
  FROM bs JOIN items USING (query_id) JOIN documents d ON d.doc_id = id {inside}) WHERE rank <= 20),
dense AS (SELECT * FROM (SELECT sim.query_id, id, row_number() OVER (PARTITION BY sim.query_id ORDER BY round(sim, 6) DESC, id) AS rank
  FROM sim JOIN items USING (query_id) JOIN documents d ON d.doc_id = id {inside}) WHERE rank <= 20),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, rank, id FROM dense UNION ALL SELECT query_id, rank, id FROM lex) GROUP BY ALL),
shortl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10),
wanted AS (SELECT query_id, scope, list_distinct({_terms("text")}) AS ts FROM items),
graded AS (
  SELECT s.query_id, s.id, s.rank, scope, d.source AS doc,
    CASE WHEN len(ts) > 0 THEN round(10.0 * len(list_intersect(ts, {_terms("d.text")})) / len(ts), 6) ELSE 0.0 END AS grade
  FROM shortl s JOIN wanted USING (query_id) JOIN documents d ON d.doc_id = s.id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS r2 FROM graded),
capped AS (SELECT *, scope IS NULL AND row_number() OVER (PARTITION BY query_id, doc ORDER BY r2) > 4 AS over FROM ordered),
placed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over, r2) AS place FROM capped) WHERE place <= {k})"""


_PASSAGES = f"""
WITH {_bm25(20)}, {_VECTORS}, {_search(True, 6)},
told AS (
  SELECT query_id, string_agg('[Document ' || id || ', p.' || (id % 7 + 1) || '] (doc: ' || doc || ')' || chr(10) || trim(d.text), chr(10) || chr(10) ORDER BY place) AS passages
  FROM placed JOIN documents d ON d.doc_id = id GROUP BY 1)"""

_FOR_QUERY = f"""
WITH RECURSIVE {_bm25(20)}, {_VECTORS}, {_search(False, 10)}, {_DOC_STORE},
everyone AS (SELECT item_id AS query_id FROM benchmark),
qvecs AS ({_dense_arrays("benchmark", "item_id", _terms("text"))}),
asked AS (SELECT item_id AS query_id, e, 0 AS recent FROM qvecs),
seeds AS (SELECT query_id, NULL::BIGINT AS seed_id, NULL::BIGINT AS seed_group, NULL::DOUBLE[] AS seed_e FROM asked),
hit AS (SELECT query_id, id AS doc_id, place, id % 7 + 1 AS page FROM placed),
raw AS (
  SELECT q.query_id, s.doc_id, {_cos("q.e", "s.e")} AS exact, {_AGE} AS age, coalesce(1.0::DOUBLE / (60 + place), 0) / sqrt(greatest(1, chunks)) AS ev,
    (place IS NOT NULL)::INT AS hits, coalesce(place, 0) AS best
  FROM asked q CROSS JOIN store s LEFT JOIN hit h ON h.query_id = q.query_id AND h.doc_id = s.doc_id),
scaled AS (SELECT *, CASE WHEN max(ev) OVER (PARTITION BY query_id) > 0 THEN ev / max(ev) OVER (PARTITION BY query_id) ELSE 0 END AS part FROM raw),
{_top("round(0.5::DOUBLE * exact + 0.3::DOUBLE * part + 0.2::DOUBLE * age, 6)", "(SELECT *, round(exact, 6) AS sim, round(part, 6) AS agg, round(age, 6) AS rec FROM scaled)")},
{_resolved(0.95, _PAIR)},
{_explained("[]::VARCHAR[]", "(SELECT min(page) FROM hit h WHERE h.query_id = p.query_id AND h.doc_id = p.doc_id)", "Closely related to ", "(SELECT max(page) FROM hit h WHERE h.query_id = p.query_id AND h.doc_id = p.doc_id)")}
{_lines("No recommendations available.")}"""


def _sessions(candidates: str) -> str:
    """CTEs from _DOC_STORE to told; ``candidates``: condition on (a.query_id, s.doc_id)."""
    return f"""
talk AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user'),
talkv AS (SELECT k, e FROM ({_dense_arrays("(SELECT conv_id * 1000 + turn AS k, text FROM talk)", "k", _terms("text"))})),
turnv AS (SELECT conv_id AS query_id, i, n, e FROM talk JOIN talkv ON k = conv_id * 1000 + turn),
spread AS (SELECT query_id, p, sum(pow(0.8, n - i) * CASE WHEN i = 1 THEN 1.0 ELSE 0.2 END * e[p]) AS v FROM turnv, (SELECT unnest(range(1, 65)) AS p) GROUP BY 1, 2),
asked AS (SELECT query_id, list(v ORDER BY p) AS e, least(5, (SELECT max(n) FROM turnv t WHERE t.query_id = spread.query_id))::INT AS recent FROM spread GROUP BY 1),
seeds AS (SELECT query_id, NULL::BIGINT AS seed_id, NULL::BIGINT AS seed_group, NULL::DOUBLE[] AS seed_e FROM asked),
raw AS (SELECT a.query_id, s.doc_id, max(round({_cos("a.e", "s.e")}, 6)) AS exact FROM turnv a CROSS JOIN store s WHERE i > n - 5 AND {candidates} GROUP BY 1, 2),
{_top("exact", "(SELECT *, exact AS sim, 0.0::DOUBLE AS agg, 0.0::DOUBLE AS rec, 0 AS hits, 0 AS best FROM raw)")},
{_resolved(0.95, _PAIR)},
{_explained("[]::VARCHAR[]", "NULL::INT", "Closely related to ", "NULL::INT")}"""


_RESOLVER = f"""
WITH RECURSIVE {_SHORT.strip()[5:]},
ranked2 AS (SELECT query_id, nth AS n, doc_id FROM short),
store AS (
  SELECT vec_id AS doc_id, CASE WHEN vec_id % 10 < 4 THEN vec_id % 100 - vec_id % 10 END AS grp, coalesce(o_orderdate, TIMESTAMP '1990-01-01') AS published, embedding::DOUBLE[] AS e
  FROM embeddings LEFT JOIN orders ON o_orderkey = vec_id),
seeds AS (SELECT doc_id AS query_id, doc_id AS seed_id, grp AS seed_group, e AS seed_e FROM store WHERE doc_id % 20 = 0),
{_resolved(0.3, _PAIR).replace("FROM ranked r", "FROM ranked2 r")}
SELECT k.query_id, place AS rank, doc_id, coalesce(ids, '') AS suppressed FROM kept k LEFT JOIN older o ON o.query_id = k.query_id AND o.key = k.key"""


_CEILING = f"""
WITH RECURSIVE {_SHORT.strip()[5:]},
ranked2 AS (SELECT query_id, nth AS n, doc_id FROM short),
store AS (SELECT vec_id AS doc_id, NULL::BIGINT AS grp, TIMESTAMP '1990-01-01' AS published, embedding::DOUBLE[] AS e FROM embeddings),
seeds AS (SELECT DISTINCT query_id, NULL::BIGINT AS seed_id, NULL::BIGINT AS seed_group, NULL::DOUBLE[] AS seed_e FROM short),
{_resolved(0.3, _PAIR).replace("FROM ranked r", "FROM ranked2 r")}
SELECT k.query_id, nth AS rank, k.doc_id FROM kept k JOIN short s ON s.query_id = k.query_id AND s.doc_id = k.doc_id"""


_FILTERED = f"""
WITH {_bm25(20)}
SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score
  FROM bs JOIN documents d ON d.doc_id = id WHERE source = 'src' || query_id % 20) WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {
        "more_like_this": _MORE,
        "recommend_for_query": _FOR_QUERY,
        "recommend_for_user": f"""
WITH RECURSIVE {_DOC_STORE}, everyone AS (SELECT DISTINCT conv_id AS query_id FROM conversations),
{_sessions("a.query_id % 50 <> s.doc_id % 50")}
{_lines("No session history yet — ask a question or name a topic first.")}""",
        "sidebar_recommend": f"""
WITH RECURSIVE {_DOC_STORE},
{_sessions("s.doc_id % 9 <> 0")}
SELECT query_id, pick, doc_id, reason FROM told""",
        "duplicate_resolver": _RESOLVER,
        "dedup_ceiling": _CEILING,
        "bm25_topk_filtered": _FILTERED,
        "bm25_indexed": f"WITH {_bm25(20)} SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM bm",
        "bm25_indexed_filtered": _FILTERED,
        "bm25_index_work": f"WITH {_bm25(20)} SELECT query_id, count(*) AS matched, true AS bounded FROM q JOIN post USING (term) GROUP BY query_id",
        "hybrid_topk_filtered": f"WITH {_bm25(20)}, {_VECTORS}, {_search(True, 6)} SELECT query_id, place, id, round(grade, 4) AS grade FROM placed",
        "service_embeddings": f"""
WITH t AS (SELECT 'item' AS kind, item_id AS id, 0::BIGINT AS turn, text FROM benchmark UNION ALL SELECT 'turn', conv_id, turn::BIGINT, text FROM conversations WHERE role = 'user'),
k AS (SELECT row_number() OVER () AS k, * FROM t)
SELECT kind, id, turn, b::BIGINT AS pos, n AS value FROM ({_sparse("k", "k", _terms("text"))}) JOIN k USING (k)""",
        "plugged_hybrid": f"WITH {_bm25(20)}, {_VECTORS}, {_search(False, 6)} SELECT query_id, place, id, doc, round(grade, 4) AS grade FROM placed",
        "service_judge": """
SELECT conv_id * 1000 + turn AS case_id, CASE WHEN turn % 5 <> 4 AND turn % 7 <> 6 THEN (length('Passages:' || chr(10) || coalesce(role, '') || chr(10) || chr(10) || 'Answer:' || chr(10) || text) % 3) / 2.0::DOUBLE END AS value
FROM conversations""",
        "hybrid_search": f"""{_PASSAGES}
SELECT item_id AS query_id, md5(coalesce(passages, 'No passages found.')) AS answer_md5, CASE WHEN passages IS NULL THEN 'No passages found.' END AS none
FROM benchmark LEFT JOIN told ON query_id = item_id""",
        "answer_question": f"""{_PASSAGES}
SELECT item_id AS query_id, md5('Answer from the passages alone and cite each fact as [Title, p.N].' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Passages:' || chr(10) || passages) AS prompt_md5,
  CASE WHEN passages IS NULL THEN 'INSUFFICIENT_CONTEXT' END AS answer FROM benchmark LEFT JOIN told ON query_id = item_id""",
    }
