"""DuckDB SQL with the results of the queries that SQL can express; brute force, not the operators' way."""

from __future__ import annotations

from lectern.llm import mixing as X
from lectern.llm import secret_scan as S
from lectern.llm import sharding as H

_ALLOW = " ".join(f"AND NOT regexp_matches(hit, '{p}')" for p in S.ALLOW_LIST)
_WEIGHTS = "[" + ", ".join(map(str, S.weight_table(S.WINDOW))) + "]"


def _found(name: str, pattern: str) -> str:
    """Matches with code point offsets, one row each."""
    p = pattern.replace("'", "''")
    return f"""
{name} AS (
  SELECT doc_id, i, hits[i] AS hit,
         list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS "start"
  FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits FROM docs), LATERAL unnest(range(1, len(hits) + 1)) AS u(i)
)"""


OP1 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_found("a0", S.ASSIGN)}, {_found("a1", S.ACCESS)}, {_found("a2", S.HEX)}, {_found("c", S.CANDIDATE)},
base AS (
  SELECT doc_id, "start", "start" + length(hit) AS "end", 0 AS ord, 'assign' AS kind FROM a0 WHERE length(regexp_extract(hit, '{S.ASSIGN.replace("'", "''")}', 2)) >= {S.ASSIGN_VALUE_MIN}
  UNION ALL SELECT doc_id, "start", "start" + length(hit), 1, 'access' FROM a1
  UNION ALL SELECT doc_id, "start", "start" + length(hit), 2, 'hex' FROM a2
),
windows AS (
  SELECT doc_id, i, "start", j, substr(hit, j + 1, {S.WINDOW}) AS w
  FROM (SELECT * FROM c WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') {_ALLOW}), LATERAL unnest(range(0, length(hit) - {S.WINDOW} + 1)) AS u(j)
),
scored AS (
  SELECT *, list_sum(list_transform(list_distinct(string_split(w, '')), lambda x: {_WEIGHTS}[length(w) - length(replace(w, x, '')) + 1])) AS total,
         length(regexp_replace(w, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS letters,
         regexp_full_match(w, '[0-9a-fA-F]+') AS hexes
  FROM windows
),
high AS (
  SELECT doc_id, i, "start" + j AS s, CASE WHEN lag(j) OVER (PARTITION BY doc_id, i ORDER BY j) >= j - {S.WINDOW} THEN 0 ELSE 1 END AS fresh
  FROM scored WHERE NOT regexp_matches(w, '{S.PLACEHOLDER}') AND digits >= 2 AND letters >= 1 AND total <= CASE WHEN hexes THEN {S.most_weight(S.WINDOW, S.MIN_BITS["hex"])} ELSE {S.most_weight(S.WINDOW, S.MIN_BITS["mixed"])} END
),
runs AS (SELECT doc_id, i, s, sum(fresh) OVER (PARTITION BY doc_id, i ORDER BY s) AS run FROM high),
extra AS (SELECT doc_id, min(s) AS "start", max(s) + {S.WINDOW} AS "end", 3 AS ord, 'entropy' AS kind FROM runs GROUP BY doc_id, i, run),
everything AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
said AS (
  SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
         string_agg(concat_ws(':', kind, "start", "end"), ',' ORDER BY "start", ord, "end") FILTER (WHERE ord < 3) AS base_said,
         string_agg(concat_ws(':', kind, "start", "end"), ',' ORDER BY "start", ord, "end") AS spans
  FROM everything GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base_said, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN said USING (doc_id)
"""

_CRC_STEP = "(CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END)"


def _u(shard: str) -> str:
    return f"(('0x' || substr(md5(doc_id::VARCHAR || ':' || {shard}), 1, {H._DIGITS}))::BIGINT::DOUBLE + 0.5) / {float(16**H._DIGITS)}"


OP4 = f"""
WITH RECURSIVE crc(k, i, c) AS (
  SELECT k, 0, k FROM (SELECT unnest(range(256)) AS k)
  UNION ALL SELECT k, i + 1, {_CRC_STEP.format(c="c")} FROM crc WHERE i < 8
),
tab AS MATERIALIZED (SELECT list(c ORDER BY k) AS t FROM crc WHERE i = 8),
texts AS (
  SELECT text, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
         lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS crc
  FROM (SELECT DISTINCT text FROM documents), tab
),
scored AS (
  SELECT doc_id, text, s, -ln({_u("s")}) AS score FROM documents, (SELECT unnest(range({H.SHARDS + 1})) AS s)
),
placed AS (
  SELECT doc_id, any_value(text) AS text, arg_min(s, score) FILTER (WHERE s < {H.SHARDS}) AS shard, arg_min(s, score) AS grown_shard FROM scored GROUP BY doc_id
),
sized AS (SELECT pow(2, greatest(0, ceil(log2(greatest(1, count(*)) / {H.SHARDS * H.SUB_ROWS}.0))))::BIGINT AS subs FROM documents)
SELECT doc_id, coalesce(octet_length(encode(placed.text)), 0)::BIGINT + {H.ROW_BYTES} AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % subs, doc_id) - 1 AS slot, grown_shard::INT AS grown_shard
FROM placed JOIN texts ON placed.text IS NOT DISTINCT FROM texts.text, sized
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, LATERAL unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0
),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM item_windows), LATERAL unnest(range(1, len(w) - n + 2)) AS u(i)
),
hits AS (SELECT doc_id, item_id, i, n FROM doc_windows JOIN item_windows USING (n, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), LATERAL unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM d, LATERAL unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"


def _leaf(text: str) -> str:
    said = [f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR)) || ':' || {x} END" for x in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(said)})"


def _nodes(name: str, leaves: str) -> str:
    """All nodes of the trees over `leaves` (part, idx, h), and of each node what stands beside it in its run."""
    return f"""
{name}_n(part, lvl, idx, h) AS (
  SELECT part, 0, idx, h FROM {leaves}
  UNION ALL SELECT part, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY part) AS c FROM {name}_n) WHERE c > 1 GROUP BY part, lvl, idx // 8
),
{name}_top AS (SELECT part, arg_max(h, lvl) AS h, max(lvl) AS tall FROM {name}_n GROUP BY part),
{name}_side AS (
  SELECT part, lvl, idx, coalesce(string_agg({name}_n.h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg({name}_n.h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}_n JOIN {name}_top USING (part) WHERE lvl < tall WINDOW w AS (PARTITION BY part, lvl, idx // 8 ORDER BY idx)
)"""


OP13 = f"""
WITH RECURSIVE crc(k, i, c) AS (
  SELECT k, 0, k FROM (SELECT unnest(range(256)) AS k)
  UNION ALL SELECT k, i + 1, {_CRC_STEP.format(c="c")} FROM crc WHERE i < 8
),
tab AS MATERIALIZED (SELECT list(c ORDER BY k) AS t FROM crc WHERE i = 8),
d AS (
  SELECT *, CASE WHEN {_CRC.format(x="doc_id::VARCHAR")} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS after FROM documents, tab
),
x AS MATERIALIZED (SELECT doc_id, lang, coalesce('=' || lang, '') AS part, {_leaf("text")} AS leaf, {_leaf("after")} AS changed FROM d),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM x),
low AS (SELECT part, pos AS idx, leaf AS h FROM p), {_nodes("a", "low")},
high AS (SELECT 1 AS part, row_number() OVER (ORDER BY part) - 1 AS idx, h, part AS name FROM a_top), {_nodes("b", "high")},
steps AS (
  SELECT p.part, p.pos, lvl AS step, l, r FROM p JOIN a_side s ON s.part = p.part AND s.idx = p.pos // pow(8, lvl)::BIGINT
  UNION ALL SELECT p.part, p.pos, 1000 + lvl, l, r FROM p JOIN high ON high.name = p.part JOIN b_side s ON s.idx = high.idx // pow(8, lvl)::BIGINT
),
paths AS (SELECT part, pos, sha256(string_agg(l || r, '' ORDER BY step)) AS proof, list({{'l': l, 'h': '', 'r': r}} ORDER BY step) AS path FROM steps GROUP BY part, pos),
out AS (
  SELECT doc_id, leaf, a_top.h AS subroot, (SELECT h FROM b_top) AS root, coalesce(proof, sha256('')) AS proof_sha256,
         list_reduce(list_concat([{{'l': '', 'h': changed, 'r': ''}}], coalesce(path, [])), lambda m, n: {{'l': '', 'h': sha256(n.l || m.h || n.r), 'r': ''}}).h AS folded_root
  FROM p JOIN a_top USING (part) LEFT JOIN paths USING (part, pos)
)
SELECT *, folded_root = root AS verified FROM out
"""

_SHARE = "1 + (1000000000::HUGEINT * ({c} + 1)) // {n}"

OP11 = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all({_LOW}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
),
tok AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
cnt AS (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sums USING (lang, source)),
p AS (
  SELECT lang, source, term, coalesce(cnt.c, 0) AS c, {_SHARE.format(c="coalesce(cnt.c, 0)", n="(groups.n + langs.v)")} AS p, {_SHARE.format(c="kept.c", n="(langs.n + langs.v)")} AS q
  FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN cnt USING (lang, source, term)
),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
said AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM said)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP12 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{X.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS seed
  FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [{", ".join(map(str, X.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(X.WEIGHTS)} + 1] AS weight FROM d GROUP BY source),
full_first AS (
  SELECT *, {X.PASSES} * source_size AS most, row_number() OVER w AS k, coalesce(sum({X.PASSES} * source_size) OVER before, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
  FROM s WINDOW w AS (ORDER BY source_size / weight, source), before AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (SELECT arg_min(({X.SHARE} * (SELECT sum(size) FROM d) - filled) / open, k) AS level FROM full_first WHERE most >= weight * ({X.SHARE} * (SELECT sum(size) FROM d) - filled) / open),
t AS (SELECT source, source_size, least(most::DOUBLE, weight * level)::DOUBLE AS target, floor(least(most::DOUBLE, weight * level) + 0.5)::BIGINT AS flow FROM full_first, level),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN flow // source_size ELSE 0 END AS passes, CASE WHEN source_size > 0 THEN flow % source_size ELSE 0 END AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY seed RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY d.source, seed) AS here
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (passes * size + CASE WHEN upto <= rest THEN size WHEN upto - here >= rest THEN 0 ELSE (2 * (rest - (upto - here)) * size + here) // (2 * here) END)::BIGINT AS taken FROM r
"""

ORACLE = {"op12_source_mix": OP12, "op11_source_divergence": OP11, "op13_merkle_manifest": OP13, "op5_warc_chunks": OP5, "op1_secret_scan": OP1, "op2_ngram_join": OP2, "op4_rendezvous_shards": OP4, "op8_decontaminate": OP8}
