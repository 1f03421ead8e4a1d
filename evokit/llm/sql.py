"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from evokit.llm.decontaminate import THRESHOLD
from evokit.llm.quality_rules import BLANKS, BOILERPLATE, CLIPPED_WORDS, ENDINGS, INNER_END, MAX_LOSS, MAX_REPEATED, MAX_SYMBOL_SHARE, MIN_WORDS, SEPARATORS, SPACE, SYMBOLS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: chr() for each blank, so the statement has no control characters.
_BLANKS = " || ".join(f"chr({ord(c)})" for c in BLANKS)
_PHRASES = _quoted("(?i)" + "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE))

#: Turns of the table hold no tool calls, so every turn is a message; calls are tested against brute force.
CHAT_FORMAT = """
SELECT conv_id, turn, turn AS pos_turn, 0::INTEGER AS pos_level, 0::INTEGER AS pos_call, 0::INTEGER AS pos_kind, 'message' AS status, '' AS errors,
    to_json({'content': text, 'conv_id': conv_id, 'role': role, 'turn': turn})::VARCHAR AS line
FROM conversations
"""

#: The calls that ``chat_calls`` weaves in, linked by their own rules: levels by following every chain of calls.
CHAT_CALLS = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, (role = 'user' AND turn > 0) AS answers FROM conversations WHERE text IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, 0 AS place, 'c' || turn AS id, 'search' AS name, to_json({'limit': turn % 4, 'query': text})::VARCHAR AS arguments, CASE WHEN turn >= 2 THEN ['c' || (turn - 2)] ELSE [] END AS after, '' AS errors FROM t WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, 1, 'd' || turn, 'weather', '{"city":"' || role || '","days":' || CASE WHEN turn % 2 = 0 THEN (turn // 2)::VARCHAR ELSE (turn // 2)::VARCHAR || '.5' END || ',"hours":' || turn || '}',
    CASE WHEN turn >= 2 THEN ['c' || (turn - 2), 'c' || turn] ELSE ['c' || turn] END, CASE WHEN turn % 2 = 1 THEN 'days is no integer; unknown hours' ELSE 'unknown hours' END FROM t WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, 2, 'e', 'calculate', '{"expression":' || turn || '}', [], 'expression is no string' FROM t WHERE role = 'assistant'),
first AS (SELECT conv_id, id, min({'turn': turn, 'place': place}) AS pos FROM c GROUP BY 1, 2),
need AS (SELECT DISTINCT conv_id, c.id, n.need FROM c, unnest(after) n(need) WHERE EXISTS (SELECT 1 FROM first f WHERE f.conv_id = c.conv_id AND f.id = n.need)),
walk AS (SELECT conv_id, id, 0 AS level FROM first UNION SELECT n.conv_id, n.id, w.level + 1 FROM walk w JOIN need n ON n.conv_id = w.conv_id AND n.need = w.id),
lv AS (SELECT conv_id, id, max(level) AS level FROM walk GROUP BY 1, 2),
r AS (SELECT conv_id, turn, text, CASE WHEN turn % 7 = 3 THEN 'none' ELSE 'c' || (turn - 1) END AS id FROM t WHERE answers)
SELECT conv_id, turn, turn AS pos_turn, 0::INTEGER AS pos_level, 0::INTEGER AS pos_call, 0::INTEGER AS pos_kind, 'message' AS status, '' AS errors,
    to_json({'content': text, 'conv_id': conv_id, 'role': role, 'turn': turn})::VARCHAR AS line FROM t WHERE NOT coalesce(answers, false)
UNION ALL SELECT c.conv_id, c.turn, c.turn, lv.level::INTEGER, c.place, 1, CASE WHEN c.turn <> pos.turn OR c.place <> pos.place THEN 'duplicate' WHEN EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id AND r.id = c.id) THEN 'linked' ELSE 'unanswered' END, c.errors,
    '{"arguments":' || c.arguments || ',"conv_id":' || c.conv_id || ',"id":"' || c.id || '","name":"' || c.name || '","role":"call","turn":' || c.turn || '}'
    FROM c JOIN first USING (conv_id, id) JOIN lv USING (conv_id, id)
UNION ALL SELECT r.conv_id, r.turn, coalesce(pos.turn, r.turn), coalesce(lv.level, 0), coalesce(pos.place, 0), 2, CASE WHEN pos IS NULL THEN 'orphan' ELSE 'result' END, '',
    to_json({'content': text, 'conv_id': r.conv_id, 'id': r.id, 'role': 'tool', 'turn': r.turn})::VARCHAR FROM r LEFT JOIN first USING (conv_id, id) LEFT JOIN lv USING (conv_id, id)
"""

#: Words of benchmark items and documents, shingles of five words (of all, where an item has fewer).
CONTAMINATED = rf"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
ish AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS s FROM (SELECT item_id, w, least(5, len(w)) AS k FROM iw WHERE len(w) > 0) x, unnest(range(1, len(w) - k + 2)) t(i)),
n AS (SELECT item_id, count(*) AS n FROM ish GROUP BY 1),
dsh AS (SELECT DISTINCT doc_id, k, list_slice(w, i, i + k - 1) AS s FROM dw, (SELECT DISTINCT k FROM ish) ks, unnest(range(1, len(w) - k + 2)) t(i)),
c AS (SELECT doc_id, item_id, count(*) AS f FROM dsh JOIN ish USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, f AS n_found, f / n AS containment FROM c JOIN n USING (item_id) WHERE f >= {THRESHOLD} * n - 1e-9
"""

QUALITY_RULES_BODY = rf"""
d AS (SELECT doc_id, coalesce(text, '') AS t FROM {{source}}),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM w, unnest(range(1, len(w) - 1)) r(i)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
good AS (SELECT doc_id, t, w, lines, list_filter(lines, lambda x:
    (regexp_matches(right(rtrim(x), 6), {_quoted(ENDINGS)}) OR (regexp_matches(x, {_quoted(INNER_END)}) AND len(regexp_split_to_array(trim(x), '{SPACE}+')) >= {CLIPPED_WORDS}))
    AND NOT (length(x) - length(translate(x, {_quoted(SEPARATORS)}, '')) >= 3 AND (length(x) - length(translate(x, {_quoted(SEPARATORS)}, ''))) * 5 >= len(regexp_split_to_array(trim(x), '{SPACE}+')))
    AND NOT (length(x) - length(translate(x, {_quoted(SYMBOLS)}, '')) > {MAX_SYMBOL_SHARE}::DOUBLE * length(x))
    AND NOT (len(regexp_extract_all(x, '[!?]{{{{2,}}}}')) * 5 > len(regexp_split_to_array(trim(x), '{SPACE}+')))
    AND NOT regexp_matches(x, {_PHRASES})) AS good FROM w),
q AS (SELECT doc_id, t, lines, good, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, {_quoted(SYMBOLS)}, '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, length(translate(array_to_string(good, chr(10)), {_BLANKS}, '')) AS left_chars FROM good LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, CASE WHEN word_chars > 0 THEN 1 - left_chars::DOUBLE / word_chars ELSE 0.0::DOUBLE END AS loss FROM q)
"""
QUALITY_RULES = f"""
WITH {QUALITY_RULES_BODY.format(source="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, loss, NOT base_failed AND loss <= {MAX_LOSS} AS kept FROM f
"""

#: Links between all pairs of texts that share a shingle, then the least id that links reach.
JACCARD_BODY = r"""
dd AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {source}),
sh AS (SELECT DISTINCT doc_id, list_slice(w, i, i + k - 1) AS s FROM (SELECT doc_id, w, least(5, len(w)) AS k FROM dd WHERE len(w) > 0) x, unnest(range(1, len(w) - k + 2)) t(i)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
lk AS (SELECT a, b FROM pr JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM dd UNION SELECT r.a, l.b FROM reach r JOIN lk l ON l.a = r.b),
cls AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1)
"""
JACCARD_JOIN = f"""
WITH RECURSIVE {JACCARD_BODY.replace("{source}", "documents")}
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM cls LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM lk GROUP BY 1) USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
"""

HARD_NEGATIVES = """
WITH raw AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT a.id AS anchor, a.label = b.label AS same, b.id, list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score FROM raw a JOIN raw b ON a.id <> b.id WHERE a.id % 50 = 0
),
positive AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
negative AS (
    SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM positive p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 3
"""

FILL_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, list_transform([1, 9, 17, 25], lambda s: list_reduce(list_transform(range(0, 8), lambda i: strpos('0123456789abcdef', substr(h, s + i, 1)) - 1), lambda a, b: 16 * a + b)) AS k FROM d),
c AS (
    SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM r
),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""
