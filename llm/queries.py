"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from llm.audio import op6_audio_features
from llm.bpe import op7_merge_replay_bpe
from llm.html import op8_html_extraction
from llm.langid import op5_language_id
from llm.minhash import op1_minhash_dedup
from llm.packing import op4_packing
from llm.phrases import op11_phrase_collocations
from llm.pii import op12_information_sanitisation
from llm.quality import op10_kneser_ney_quality
from llm.resample import op13_importance_resampling
from llm.sharding import op9_sampled_splitters
from llm.simple8b import op3_simple8b_ids
from llm.vectors import op2_robust_graph


def queries():
    found = [op1_minhash_dedup, op3_simple8b_ids, op4_packing, op5_language_id, op7_merge_replay_bpe, op8_html_extraction, op9_sampled_splitters, op10_kneser_ney_quality, op6_audio_features, op2_robust_graph, op11_phrase_collocations, op12_information_sanitisation, op13_importance_resampling]
    return {f.__name__: f for f in found}


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_REACHED = "r(id, c) AS (SELECT id, id FROM every UNION SELECT r.id, lk.b FROM r JOIN lk ON r.c = lk.a)"

#: Shingles of two words, all pairs that share one, exact links, and the closure of the links.
OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
every AS (SELECT id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
e AS (SELECT id, len(sh) AS n, unnest(sh) AS v FROM every),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.v = b.v AND a.id < b.id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
lk AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), {_REACHED}
SELECT id AS doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, id = component_id AS kept FROM every JOIN (SELECT id, min(c) AS component_id FROM r GROUP BY 1) USING (id)"""

#: All pairs of a label by cosine in double precision, and the closure of the links.
OP2 = f"""WITH RECURSIVE every AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT * FROM every WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.id AS a, b.id AS b FROM good a JOIN good b ON a.label = b.label AND a.id < b.id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
lk AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), {_REACHED}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM (SELECT id, min(c) AS component_id FROM r GROUP BY 1) LEFT JOIN (SELECT a AS id, count(*) AS n FROM lk GROUP BY 1) USING (id)"""

#: CRC-32 byte by byte from its table, over distinct features; features, gains, weights and ranks in plain SQL.
OP13 = f"""WITH tab AS (SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
w AS (SELECT 0 AS side, doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL SELECT 1, 0, list_filter(string_split_regex(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
e AS (SELECT side, id, unnest(list_concat(ws, list_concat(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))) AS f FROM w),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM e)),
c AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(f)), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))), lambda x, y: xor(t[1 + (xor(x, y) & 255)], x >> 8)), 4294967295) % 10000 AS b FROM u, tab),
n AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM e JOIN c USING (f) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM n)::DOUBLE + 10000) / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM n)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM n),
d AS (SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM e JOIN c USING (f) JOIN g USING (b) WHERE side = 0 GROUP BY id),
p AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) >= 20 AS fit, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM documents JOIN w ON w.id = doc_id AND side = 0 LEFT JOIN d ON d.id = doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * (SELECT count(*) FROM p WHERE fit) // 100 THEN place END AS rank FROM o"""

#: All runs of one to five words; cuts, the one-word extensions and ranks in 128-bit integers.
OP11 = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
e AS (SELECT lang, k AS words, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k)),
f AS (SELECT lang, words, phrase, count(*) AS f FROM e GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY 1),
c AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND f >= 100),
k AS (SELECT c.lang, c.phrase, a, n, k, l.f AS l, r.f AS r, CAST(1000::HUGEINT * a * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM c, range(1, 5) x(k), n, f l, f r
  WHERE k < c.words AND n.lang = c.lang AND l.lang = c.lang AND r.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ') AND r.phrase = array_to_string(ws[k + 1:], ' ')),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m WHERE cut = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.lang = m.lang AND c.words > len(string_split(m.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || m.phrase || ' ') AND 100 * c.a >= 100 * m.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000"""

_KINDS = r"(VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+(?:\.[0-9]+){3}'), (3, 'card', '[0-9](?:[ -]?[0-9])+'), (4, 'phone', '\+[0-9][ ().0-9-]+[0-9]')) k(kind, name, p)"
_NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Matches and the text between them give the places; pairs of entities and near words, their documents, and every place of a disclosing term.
OP12 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, text, kind, name, string_split_regex(text, p) AS gaps, regexp_extract_all(text, p) AS ms FROM d, {_KINDS}),
i AS (SELECT doc_id, text, kind, name, gaps, ms, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
v AS (SELECT doc_id, text, kind, name, ms[i] AS value, list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda g: length(g))), 0) AS b, regexp_replace(ms[i], '[^0-9]', '', 'g') AS digits,
  list_concat(list_filter(string_split_regex(lower(gaps[i]), '{_NO_WORD}'), lambda w: w <> '')[-10:], list_filter(string_split_regex(lower(gaps[i + 1]), '{_NO_WORD}'), lambda w: w <> '')[:10]) AS near FROM i),
s AS (SELECT *, b + length(value) AS e FROM v WHERE CASE kind WHEN 1 THEN true WHEN 2 THEN len(list_filter(string_split(value, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0
  WHEN 3 THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(digits[-j] AS INT) ELSE CAST(digits[-j] AS INT) * 2 - CASE WHEN digits[-j] > '4' THEN 9 ELSE 0 END END)) % 10 = 0
  ELSE length(digits) BETWEEN 9 AND 15 END),
near AS (SELECT DISTINCT doc_id, text, kind, lower(value) AS value, unnest(near) AS term FROM s),
pair AS (SELECT kind, value, term, count(*) AS both_df FROM near WHERE length(term) >= 3 AND regexp_matches(term, '[^0-9]') GROUP BY ALL HAVING count(DISTINCT text) >= 3),
ent AS (SELECT kind, value, count(*) AS df FROM (SELECT DISTINCT doc_id, kind, lower(value) AS value FROM s) GROUP BY ALL),
said AS (SELECT term, count(*) AS df_term FROM (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '{_NO_WORD}'), lambda w: w <> ''))) AS term FROM d) GROUP BY 1),
rated AS (SELECT term, max(ln(both_df::DOUBLE * n / (df::DOUBLE * df_term)) / -ln(df::DOUBLE / n)) AS disclosure FROM pair JOIN ent USING (kind, value) JOIN said USING (term), (SELECT count(*) AS n FROM d) WHERE df < n GROUP BY 1 HAVING disclosure >= 0.95),
w AS (SELECT DISTINCT doc_id, text FROM d JOIN (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '{_NO_WORD}'), lambda w: w <> ''))) AS term FROM d) USING (doc_id) JOIN rated USING (term)),
g AS (SELECT doc_id, string_split_regex(text, '[^{_NO_WORD[1:]}') AS gaps, list_filter(string_split_regex(text, '{_NO_WORD}'), lambda w: w <> '') AS ws FROM w),
o AS (SELECT doc_id, i, ws[i] AS word, sum(length(gaps[i]) + length(ws[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM g)),
t AS (SELECT doc_id, CASE WHEN disclosure >= 0.99 THEN 5 ELSE 6 END AS kind, CASE WHEN disclosure >= 0.99 THEN 'remove' ELSE 'generalise' END AS name, e - length(word) AS b, e FROM o JOIN rated ON term = lower(word)),
a AS (SELECT doc_id, kind, name, b, e FROM s UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = t.doc_id AND s.b < t.e AND t.b < s.e)),
f AS (SELECT doc_id, count(*) FILTER (kind = 1) AS n_email, count(*) FILTER (kind = 2) AS n_ip, count(*) FILTER (kind = 3) AS n_card, count(*) FILTER (kind = 4) AS n_phone,
  string_agg(concat(name, ':', b, ':', e), ',' ORDER BY b, kind) FILTER (kind <= 4) AS base, string_agg(concat(name, ':', b, ':', e), ',' ORDER BY b, kind) AS spans FROM a GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The operators whose rows SQL can express; tests hold the others against brute force."""
    return {"op1_minhash_dedup": OP1, "op2_robust_graph": OP2, "op11_phrase_collocations": OP11, "op12_information_sanitisation": OP12, "op13_importance_resampling": OP13}
