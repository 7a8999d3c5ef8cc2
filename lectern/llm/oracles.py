"""DuckDB SQL of the operators that SQL can express, written apart from the plans."""

from __future__ import annotations

#: crc32 of a text column ``g``: its bytes' bits, lowest first, through the reflected polynomial.
CRC32 = (
    "xor(list_reduce(list_transform(range(0, 8 * strlen(g)), "
    "lambda k: ((('0x' || substr(hex(g), 2 * (k // 8)::INT + 1, 2))::BIGINT >> (k % 8)::INT) & 1)), "
    "lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384), 4294967295::BIGINT), 4294967295::BIGINT)"
)

OP1 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
tok AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (
    SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM docs)),
grams AS (
  SELECT doc_id, w AS g FROM tok
  UNION ALL
  SELECT doc_id, p || ' ' || w FROM (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM tok)
  WHERE p IS NOT NULL),
hashed AS (SELECT g, {CRC32} % 10000 AS bucket FROM (SELECT DISTINCT g FROM grams)),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
placed AS (SELECT doc_id, bucket FROM grams JOIN hashed USING (g)),
counted AS (
  SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM trusted)) AS target
  FROM placed GROUP BY bucket),
weights AS (
  SELECT bucket, CAST(round(1000 * (ln((target + 1.0) / (sum(target) OVER () + 10000)::DOUBLE)
    - ln((raw + 1.0) / (sum(raw) OVER () + 10000)::DOUBLE))) AS BIGINT) AS weight FROM counted),
scored AS (
  SELECT doc_id, CAST(sum(weight) AS BIGINT) AS llr_sum, count(*) AS n_grams
  FROM placed JOIN weights USING (bucket) GROUP BY doc_id),
win AS (
  SELECT doc_id, pos, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c
  FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
again AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win WHERE c IS NOT NULL) WHERE n > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM again) GROUP BY doc_id),
words AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM tok GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(llr_sum, 0) AS llr_sum, coalesce(n_grams, 0) AS n_grams
  FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id)
  LEFT JOIN repeated USING (doc_id) LEFT JOIN scored USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr_sum, n_grams,
  NOT base_failed AND llr_sum >= -60 * n_grams AS kept
FROM failed
"""

OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
    AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.93),
walk AS (
  SELECT DISTINCT a AS id, a AS met FROM link
  UNION
  SELECT walk.id, link.b FROM walk JOIN link ON link.a = walk.met),
component AS (SELECT id, min(met) AS component_id FROM walk GROUP BY id),
counted AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN component c ON c.id = vec_id LEFT JOIN counted k ON k.id = vec_id
"""


def _matches(kind: str, pattern: str) -> str:
    """(doc_id, kind, start, m): matches of one pattern with their places."""
    return f"""SELECT doc_id, '{kind}' AS kind, m, CAST(sum(length(p) + length(m)) OVER w - length(m) AS BIGINT) AS start
FROM (SELECT doc_id, unnest(ms) AS m, unnest(ps[:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM docs))
WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 "
    f"THEN substr({_DIGITS}, -i, 1)::INT ELSE substr({_DIGITS}, -i, 1)::INT * 2 // 10 + substr({_DIGITS}, -i, 1)::INT * 2 % 10 END)) % 10 = 0"
)
_NEAR = "lower(substr(text, greatest(1, start - 39), least(start, 40)))"
OP5 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
email AS ({_matches("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+")}),
ip AS ({_matches("ip", "[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)")}),
card AS ({_matches("card", "[0-9]([ -]?[0-9])+")}),
phone AS ({_matches("phone", "[+][0-9][ ().0-9-]+[0-9]")}),
iban AS ({_matches("iban", "(?:^|[^A-Za-z0-9])[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}")}),
ssn AS ({_matches("ssn", "[0-9-]+")}),
ibans AS (
  SELECT doc_id, kind, regexp_extract(m, '[A-Z].*') AS m, start + length(m) - length(regexp_extract(m, '[A-Z].*')) AS start FROM iban),
spans AS (
  SELECT doc_id, kind, start, m, 1 AS k FROM email
  UNION ALL SELECT doc_id, kind, start, m, 2 FROM ip
  WHERE len(list_filter(string_split(m, '.'), lambda o: length(ltrim(o, '0')) > 3 OR coalesce(TRY_CAST(o AS BIGINT), 256) > 255)) = 0
  UNION ALL SELECT doc_id, kind, start, m, 3 FROM card WHERE length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}
  UNION ALL SELECT doc_id, kind, start, m, 4 FROM phone WHERE length({_DIGITS}) BETWEEN 10 AND 15
  UNION ALL SELECT doc_id, kind, start, m, 5 FROM ibans JOIN docs USING (doc_id)
  WHERE NOT regexp_matches(substr(text, start + length(m) + 1, 1), '[A-Za-z0-9]') AND length(replace(m, ' ', '')) BETWEEN 15 AND 34
    AND list_reduce(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''),
      lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE c::INT END), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0) = 1
  UNION ALL SELECT doc_id, kind, start, m, 6 FROM ssn JOIN docs USING (doc_id)
  WHERE regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND NOT regexp_matches(m, '^(000|666|9)') AND NOT regexp_matches(m, '-00-|-0000$')
    AND regexp_matches({_NEAR}, 'ssn|social|security') AND NOT regexp_matches({_NEAR}, 'example|sample|test|dummy')),
joined AS (
  SELECT doc_id, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card,
    count(*) FILTER (k = 4) AS n_phone, count(*) FILTER (k = 5) AS n_iban, count(*) FILTER (k = 6) AS n_ssn,
    string_agg(kind || ':' || start || ':' || (start + length(m)), ',' ORDER BY start, k) AS spans,
    string_agg(kind || ':' || start || ':' || (start + length(m)), ',' ORDER BY start, k) FILTER (k <= 4) AS base
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, coalesce(n_iban, 0) AS n_iban, coalesce(n_ssn, 0) AS n_ssn,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (doc_id)
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER.format('text')}, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"
OP11 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
held AS (SELECT r, doc_id, ts, len(ts)::BIGINT AS n FROM docs WHERE len(ts) > 0),
stats AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS lengths FROM held),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM held) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, stats GROUP BY term, total),
norms AS (SELECT r, doc_id, 100 - 25 + (25 * n * total) // lengths AS m FROM held, stats),
single AS (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM single) GROUP BY item_id, term),
scored AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN norms USING (r) GROUP BY item_id, r, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

OP12 = f"""
WITH runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run),
summed AS (SELECT run, n, {CRC32} AS h FROM (SELECT run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS g FROM runs)),
read AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM summed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM read WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words),
cuts AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM cut),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS rest FROM cut),
pairs AS (
  SELECT c.word AS a, c.n AS an, w.word AS b, w.n AS bn FROM cuts c JOIN words w ON c.rest = w.word
  UNION ALL SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION ALL SELECT x.word, x.n, y.word, y.n FROM gaps x JOIN gaps y ON x.rest = y.rest AND x.word <> y.word),
near AS (
  SELECT a AS word, count(*)::BIGINT AS n_near, max(bn) AS near_n, arg_min(b, (-bn, b)) AS near FROM pairs GROUP BY a),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * words.n THEN near END AS form,
    CASE WHEN near_n >= 5 * words.n THEN near_n END AS form_n
  FROM words LEFT JOIN near USING (word)),
walk AS (
  WITH RECURSIVE step(word, root) AS (
    SELECT word, word FROM formed
    UNION ALL SELECT step.word, formed.form FROM step JOIN formed ON step.root = formed.word WHERE formed.form IS NOT NULL)
  SELECT step.word, step.root FROM step JOIN formed ON step.root = formed.word WHERE formed.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN walk USING (word)
"""

OP13 = """
WITH usable AS (
  SELECT vec_id, min(v) AS v FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
