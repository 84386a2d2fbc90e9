"""SQL for those queries of this subpackage that SQL expresses.

A text's words are cut by the contract's patterns; windows and shingles are joined words, which cannot be confused as words
hold no blanks. Groups of links are walked by recursion, and pairs are found through what they share.
"""

from __future__ import annotations

# Base 32 of the digest: five hexadecimal digits are four letters.
_DIGEST = "sha1(coalesce(html, ''))"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr({_DIGEST}, {1 + 5 * (i // 4)}, 5))::BIGINT"
    f" >> {15 - 5 * (i % 4)}) & 31)::INTEGER, 1)"
    for i in range(32)
)
WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, {_BASE32} AS payload_digest FROM pages),
o AS (SELECT payload_digest, min(page_id) AS original FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM p JOIN o USING (payload_digest)
"""
_BLANK = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GROUPS = """
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM two UNION SELECT reach.id, two.b FROM reach JOIN two ON two.a = reach.other),
grp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_BLANK}, 0) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id AND 100 * least(nx.n, ny.n) >= 80 * greatest(nx.n, ny.n)
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))), {_GROUPS}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN grp ON id = d.doc_id
"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK}, 0) AS w FROM documents),
v AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS place FROM w),
k AS (SELECT doc_id, place, row_number() OVER (PARTITION BY array_to_string(w[place : place + 19], ' ') ORDER BY doc_id, place) > 1 AS late FROM v),
g AS (SELECT DISTINCT doc_id, unnest(range(place, place + 20)) AS pos FROM k WHERE late),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
r AS (SELECT e.doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY e.pos) FILTER (g.pos IS NULL) AS kept FROM e LEFT JOIN g USING (doc_id, pos) GROUP BY e.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}, 0) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, {_ALNUM}, 0) AS w FROM benchmark),
i AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS item_at FROM b WHERE len(w) > 0),
t AS (SELECT item_id, n, item_at, array_to_string(w[item_at : item_at + n - 1], ' ') AS k FROM i),
p AS (SELECT doc_id, w, sizes.n, unnest(range(1, len(w) - sizes.n + 2)) AS place FROM d, (SELECT DISTINCT n FROM t) sizes),
h AS (SELECT DISTINCT p.doc_id, p.place, p.n, t.item_id, t.item_at FROM (SELECT *, array_to_string(w[place : place + n - 1], ' ') AS k FROM p) p JOIN t USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + n)) AS pos FROM h) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id),
l AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, item_id, place - item_at ORDER BY place) AS island FROM h),
m AS (SELECT doc_id, min(place) - 1 AS place, max(place + n) - min(place) AS words FROM l GROUP BY doc_id, item_id, place - item_at, island),
x AS (SELECT doc_id, count(*) AS n_matches, max(words) AS longest_match, min(struct_pack(words := -words, place := place)).place AS longest_start FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_matches, 0) AS n_matches, coalesce(longest_match, 0) AS longest_match, longest_start
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN x USING (doc_id)
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9), {_GROUPS},
n AS (SELECT a AS id, count(*) AS n_links FROM two GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN grp ON grp.id = vec_id
"""

_FAILS = [f"f{x}" for x in "ABCDE"]
_CASE = lambda value: f"CASE filter {' '.join(f"WHEN '{x}' THEN {value.format(x)}" for x in 'ABCDE')} END"
AUDIT = f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_BLANK}, 0) AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, len(w) < 50 AS fA, 100 * len(list_distinct(w)) < 65 * len(w) AS fB,
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS fC, regexp_matches(text, '[#$%&*|]') AS fD,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS fE, coalesce(good, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic
  FROM t LEFT JOIN l USING (doc_id)),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5),
k AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[1 : step - 1] AS before FROM s),
c AS (SELECT part, {', '.join(_FAILS)}, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM d GROUP BY ALL),
m AS (SELECT part, filter_order, step, filter, n, n_good, n_toxic, {_CASE('f{0}')} AS fails,
    {' OR '.join(f"(contains(before, '{x}') AND f{x})" for x in 'ABCDE')} AS gone, {' + '.join(f'f{x}::INT' for x in 'ABCDE')} = 1 AS alone
  FROM c, k),
r AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails AND alone), 0)::BIGINT AS unique_fails, coalesce(sum(n_good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost,
    coalesce(sum(n_toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM r
"""
