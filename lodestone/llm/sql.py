"""DuckDB SQL that gives the same rows as the registered queries, where SQL can."""

OP5 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""

OP1 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS key, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT key, source, CAST(sum(size) AS DOUBLE) AS source_size, 2.0::DOUBLE * sum(size) AS lim,
               row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY key, source),
wt AS (SELECT *, ([3.0, 1.0, 2.0])[rank % 3 + 1]::DOUBLE AS w FROM per),
lv AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
         - coalesce(sum(lim) OVER (ORDER BY lim / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY lim / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
fin AS (SELECT (SELECT level FROM lv WHERE lim > level * w ORDER BY lim / w, rank LIMIT 1) AS final),
tg AS (SELECT key, source_size, rank, CASE WHEN final IS NULL OR lim <= final * w THEN lim ELSE final * w END AS target,
              least(4096, greatest(1, ceil(source_size / 65536)))::BIGINT AS n_shards FROM lv, fin),
seats AS (SELECT round(sum(target) / 32)::BIGINT AS n, max(source_size)::BIGINT AS m FROM tg),
quo AS (SELECT key, row_number() OVER (ORDER BY target / (2 * j - 1) DESC, rank) AS r
        FROM tg, seats, unnest(range(1, CAST(ceil(target / 32) AS BIGINT) + 3)) AS u(j) WHERE target > 0),
blk AS (SELECT key, count(*) AS blocks FROM quo, seats WHERE r <= n GROUP BY key),
dealt AS (SELECT doc_id, size, key, source_size, target, rank, coalesce(blocks, 0) AS blocks, md5('mix:' || doc_id) AS seeded,
                 CAST('0x' || substr(md5('mix:' || doc_id), 1, 8) AS BIGINT) % n_shards AS shard
          FROM sized JOIN tg USING (key) LEFT JOIN blk USING (key)),
sh AS (SELECT key, shard, CAST(sum(size) AS BIGINT) AS words, max(blocks) AS blocks FROM dealt GROUP BY key, shard),
sq AS (SELECT key, shard, row_number() OVER (PARTITION BY key ORDER BY words::DOUBLE / (2 * j - 1) DESC, shard) AS r, blocks
       FROM sh, unnest(range(1, CAST(ceil(2 * words / 32) AS BIGINT) + 4)) AS u(j) WHERE words > 0),
q AS (SELECT key, shard, count(*) AS quota FROM sq WHERE r <= blocks GROUP BY key, shard),
pos AS (SELECT doc_id, size, source_size, target, words, least(coalesce(quota, 0) * 32, 2 * words) AS words_taken,
               CAST(sum(size) OVER (PARTITION BY d.key, d.shard ORDER BY seeded, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS at_word
        FROM dealt d JOIN sh ON d.key = sh.key AND d.shard = sh.shard LEFT JOIN q ON d.key = q.key AND d.shard = q.shard)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(CASE WHEN words = 0 THEN 0 ELSE (words_taken // words) * size
            + greatest(0, least(size, words_taken - (words_taken // words) * words - at_word)) END AS BIGINT) AS taken
FROM pos
"""

ORACLES = {"op1_mixing": OP1, "op5_exact_dedup": OP5}

OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bm AS (SELECT item_id, w, least(len(w), 13) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS key FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bm)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS key FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, key)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP4 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(role) + length(text) + 4 * (length(role || text) - length(replace(role || text, '&', '')))
        + 3 * (length(role || text) - length(replace(role || text, '<', '')))
        + 5 * (length(role || text) - length(replace(role || text, '[', '')))
        + 8 * (length(role || text) - length(replace(role || text, chr(10), ''))) + 24 AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n) AS n FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM g
"""

ORACLES |= {"op4_chat_format": OP4, "op8_decontamination": OP8}

OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE first < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM f),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
wd AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM wd ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

ORACLES |= {"op3_substring_dedup": OP3}

OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c = x.n AND c = y.n),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT l.a, reached FROM r JOIN l ON l.b = r.node),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
q AS (SELECT a, min(b) AS rep FROM e GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(rep, doc_id)) AS rep_id, (SELECT min(reached) FROM r WHERE node = doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN k ON k.a = doc_id LEFT JOIN q ON q.a = doc_id
"""

ORACLES |= {"op10_jaccard_join": OP10}

# fixed values: the patterns of the four kinds, as they are given
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(v, '.'), lambda z: CASE WHEN length(ltrim(z, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(z, '0') AS INTEGER) END)) <= 255"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "length(n) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(n), i, 1) AS INTEGER) WHEN CAST(substr(reverse(n), i, 1) AS INTEGER) > 4 THEN 2 * CAST(substr(reverse(n), i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(reverse(n), i, 1) AS INTEGER) END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(n) BETWEEN 10 AND 15"),
)
_WORD = r"[\p{L}\p{M}\p{N}]+"


def _found(name: str, pattern: str) -> str:
    """i, v, s: each match of a pattern in t, and where it starts."""
    return f"""(SELECT doc_id, i, v, sum(gap) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (
  SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS v, unnest(list_transform(range(1, len(m) + 1), lambda k: length(b[k]) + CASE WHEN k > 1 THEN length(m[k - 1]) ELSE 0 END)) AS gap
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS b FROM d) WHERE len(m) > 0)) AS {name}"""


_BASE = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {o} AS o, CAST(s AS BIGINT) AS s, CAST(s AS BIGINT) + length(v) AS e, v FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS n FROM {_found(k, p)}) WHERE {test}" for o, (k, p, test) in enumerate(_KINDS))
OP9 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
total AS (SELECT CAST(count(*) AS DOUBLE) AS docs FROM d),
ok AS MATERIALIZED ({_BASE}),
ent AS (SELECT DISTINCT doc_id, kind || ':' || v AS entity FROM ok),
known AS (SELECT entity, count(*) AS de FROM ent JOIN d USING (doc_id) GROUP BY entity HAVING count(DISTINCT t) >= 3),
word AS MATERIALIZED (SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(s AS BIGINT) + length(v) AS e, lower(v) AS term FROM {_found('w', _WORD)}),
apart AS MATERIALIZED (SELECT * FROM word w WHERE NOT EXISTS (SELECT 1 FROM ok x WHERE x.doc_id = w.doc_id AND x.s < w.e AND w.s < x.e)),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM word GROUP BY term),
near AS (SELECT DISTINCT doc_id, term FROM apart WHERE doc_id IN (SELECT doc_id FROM ent)),
pair AS (SELECT term, entity, de, count(*) AS n FROM near JOIN ent USING (doc_id) JOIN known USING (entity) JOIN d USING (doc_id) GROUP BY term, entity, de HAVING count(DISTINCT t) >= 3),
told AS (SELECT DISTINCT term FROM pair JOIN df USING (term), total WHERE n / df >= 0.5 AND log2(docs / de) >= 6 AND log2((n / df) / (de / docs)) >= 6),
every AS (SELECT doc_id, kind, o, s, e FROM ok UNION ALL SELECT doc_id, 'term', 4, s, e FROM apart JOIN told USING (term)),
line AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) FILTER (o < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN line USING (doc_id)
"""

ORACLES |= {"op9_pii": OP9}

_CRC = "crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tbl FROM range(256) AS r(i))"


def _crc32(v: str) -> str:
    """crc32 of a number's decimal digits, byte by byte over the table `crc`."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({v} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"


OP11 = f"""
WITH {_CRC},
d AS (SELECT doc_id, coalesce('s' || source, 'n') AS k, lang, length(text) AS n, 60 * ((doc_id + {_crc32('doc_id')} % 10000) // 6) AS t FROM documents, crc),
w AS (SELECT doc_id, k, t, unnest([600, 43200]) AS w FROM d),
f AS (SELECT w.doc_id, w.w, w.t, count(d.doc_id) AS n_events, coalesce(sum(d.n), 0) AS s, count(DISTINCT d.lang) AS l, list_sort(list(d.n) FILTER (d.n IS NOT NULL)) AS h
      FROM w LEFT JOIN d ON w.k = d.k AND d.t >= w.t - w.w AND d.t < w.t GROUP BY ALL)
SELECT doc_id, CAST(w AS BIGINT) AS window_s, CAST(t AS BIGINT) AS event_s, n_events, CAST(s AS BIGINT) AS sum_chars, l AS n_langs,
       h[(len(h) + 1) // 2] AS median_chars, h[(90 * len(h) + 99) // 100] AS high_chars FROM f
"""

OP13 = f"""
WITH {_CRC},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, max(pos) AS n, {_crc32('conv_id')} % 4 AS h FROM t, crc GROUP BY conv_id, tbl),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
r AS (SELECT k.conv_id, t.pos, role, text FROM k JOIN t ON t.conv_id = k.conv_id - k.conv_id % 20 AND t.pos <= k.h
      UNION ALL SELECT k.conv_id, t.pos - h + taken, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos > k.h),
m AS (SELECT conv_id, pos AS depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, list(sha256(strlen(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r
      UNION ALL SELECT conv_id, 0, 0, [] FROM c),
l AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
             coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = (SELECT l.depth FROM l WHERE l.conv_id = m.conv_id)), '') AS ends FROM m GROUP BY path, depth),
ch AS (SELECT path[:-2] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (path)),
up AS (SELECT path[1:a] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM x) GROUP BY ALL)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN up USING (path) LEFT JOIN n p ON x.depth > 0 AND p.path = x.path[:-2]
"""

ORACLES |= {"op11_rolling": OP11, "op13_prefix_trie": OP13}
