"""DuckDB SQL of the queries, by the query's name in capitals."""

OP1_NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
    SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS spot FROM d UNION SELECT id, b FROM reach JOIN edge ON spot = a),
c AS (SELECT id, min(spot) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""

OP3_WARC_ROUND_TRIP = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p),
h AS (SELECT *, sha1(html) AS hex FROM f),
bits AS (
    SELECT page_id, first, html, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ('0b' || substr(b, 5 * i + 1, 5))::INT, 1), '' ORDER BY i) AS payload_digest
    FROM (SELECT *, array_to_string(list_transform(string_split(hex, ''),
        lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), '') AS b FROM h), range(32) AS t(i)
    GROUP BY ALL)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, NULL::VARCHAR AS error
FROM bits
"""

OP6_URL_FILTER = r"""
WITH c AS (
    SELECT page_id, nullif(regexp_replace(regexp_extract(lower(trim(url)),
               '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1), '\.+$', ''), '') AS host,
           DATE '2023-01-01' + (page_id * 7919 % 730)::INT AS day FROM pages),
log AS (
    SELECT CASE WHEN page_id % 4 = 0 THEN regexp_replace(host, '^[^.]+\.(.+\.)', '\1') ELSE host END AS domain,
           (page_id // 7) % 3 AS rank, DATE '2023-01-01' + (page_id * 104729 % 730)::INT AS since FROM c),
daily AS (SELECT domain, since, min(rank) AS rank FROM log WHERE domain IS NOT NULL GROUP BY ALL),
held AS (SELECT *, lead(since, 1, DATE '9999-12-31') OVER (PARTITION BY domain ORDER BY since) AS until FROM daily),
label AS (
    SELECT page_id, host, day, string_split(host, '.') AS parts, unnest(generate_series(1, len(string_split(host, '.')))) AS i
    FROM c WHERE host IS NOT NULL),
asked AS (SELECT *, array_to_string(parts[i:], '.') AS domain, len(parts) - i AS labels FROM label),
hit AS (
    SELECT page_id, CASE rank WHEN 0 THEN 'block' ELSE 'allow' END AS verdict, a.domain AS listed_domain, since AS listed_on
    FROM asked a JOIN held h ON a.domain = h.domain AND since <= day AND day < until AND rank < 2
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY labels DESC) = 1)
SELECT c.page_id, host, day AS fetched_on, coalesce(verdict, 'none') AS verdict, listed_domain, listed_on
FROM c LEFT JOIN hit USING (page_id)
"""

OP7_SUBSTRING_DEDUP = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
p AS (SELECT r, doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM d WHERE len(ws) >= 13),
win AS (SELECT r, doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM p),
again AS (SELECT r, i FROM win QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
gone AS (SELECT DISTINCT r, i + o AS k FROM again, range(13) AS t(o)),
word AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM d),
kept AS (
    SELECT r, string_agg(w, ' ' ORDER BY k) AS kept, count(*) AS n
    FROM word ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP9_QUALITY_RULES = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT r, ws, unnest(generate_series(1, greatest(len(ws) - 2, 0))) AS i FROM w),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM pos WHERE i <= len(ws) - 2),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS t(o) GROUP BY r),
split AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
line AS (
    SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw,
           length(line) AS chars, length(line) - length(translate(line, '|›»•·→', '')) AS separators
    FROM split),
judged AS (
    SELECT r, line, chars,
        NOT regexp_matches(line, '[.!?…:;。！？।॥۔؟]["''”’»)\]]*\s*$')
        AND NOT regexp_matches(line, '[.!?…。！？।॥۔؟]["''”’»)\]]*\s')
        OR (separators >= 3 AND separators > len(lw) * 0.1)
        OR regexp_matches(lower(line), 'accept cookies|all rights reserved|click here|cookie policy|enable javascript|log in to|lorem ipsum|privacy policy|sign up for|subscribe to our|terms of use|use of cookies')
            AND (len(lw) <= 40 OR length(line) - length(regexp_replace(lower(line), 'accept cookies|all rights reserved|click here|cookie policy|enable javascript|log in to|lorem ipsum|privacy policy|sign up for|subscribe to our|terms of use|use of cookies', '', 'g')) > length(line) * 0.1)
        OR length(line) - length(translate(line, '#*$%&|<>', '')) > len(lw) * 0.5
        OR (length(line) - length(replace(line, '!!', ''))) / 2 > len(lw) * 0.5
        OR (len(lw) >= 5 AND NOT regexp_matches(line, '\p{Ll}') AND regexp_matches(line, '\p{Lu}'))
        AS fails
    FROM line WHERE len(lw) > 0),
lines AS (
    SELECT r, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost, sum(chars) AS total
    FROM judged GROUP BY r),
counts AS (
    SELECT doc_id, len(ws) AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
           coalesce(dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
           coalesce(lost, 0) AS lost, coalesce(total, 0) AS total
    FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 * total AS kept
FROM counts
"""

OP10_CHAT_FORMAT = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
    SELECT *, length(role) + length(text) + length('<s>[INST][/INST]</s>') + 1
        + length(regexp_replace(role || chr(1) || text, '[^\\]', '', 'g'))
        + len(regexp_extract_all(role || chr(1) || text, '</?s>|\[/?INST\]|<</?SYS>>')) AS chars
    FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

# crc32(x) of a text, bit by bit
CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({x}))),
        lambda i: ('0x' || substr(hex(encode({x})), (2 * i + 1)::INT, 2))::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda a, z: xor(a >> 1, 3988292384 * (a & 1))))"""

# A recursion over places keeps the least (cost, audit) of every state. Two insertions lead from a
# state back to itself, so at most two stand before a row.
OP11_STRUCTURE_REPAIR = """
WITH RECURSIVE k AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(""" + CRC32.format(x="k0.name") + r""", 4294967295) % 20 AS kind
    FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations) k0),
r AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM k WHERE kind <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
           rtrim(text, E' \t\n\x0B\f\r') AS ended FROM r),
judged AS (
    SELECT *, left(role, 1) AS c,
           CASE WHEN ended = '' THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM placed),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM judged GROUP BY conv_id),
ins(f, t, m) AS (VALUES ('', '', 0), ('', 'u', 1), ('', 'a', 2), ('s', 's', 0), ('s', 'u', 1), ('s', 'a', 2),
                        ('u', 'u', 0), ('u', 'a', 1), ('u', 'u', 2), ('a', 'a', 0), ('a', 'u', 1), ('a', 'a', 2)),
edit(f, c, t, e, price) AS (
    SELECT f, c, CASE WHEN e = 'D' THEN f ELSE t END, e, CASE e WHEN 'K' THEN 0 WHEN 'R' THEN 1 ELSE 2 END
    FROM (VALUES ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) v(f, t), (VALUES ('s'), ('u'), ('a'), ('?')) w(c),
         (VALUES ('D'), ('K'), ('R')) x(e) WHERE e <> 'K' OR c = t
    UNION ALL SELECT '', 's', 's', 'K', 0),
-- every step puts edits, and roles of what stays, behind the best of the place before
path AS (
    SELECT conv_id, 0::BIGINT AS i, '' AS state, 0 AS cost, '' AS audit FROM counts
    UNION ALL
    SELECT conv_id, i, state, cost, audit FROM (
        SELECT p.conv_id, j.i, edit.t AS state,
               p.cost + 5 * ins.m + edit.price + CASE WHEN j.fault = 'truncated' AND e <> 'D' THEN 5 ELSE 0 END AS cost,
               p.audit || repeat('I', ins.m) || e AS audit
        FROM path p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1
        JOIN ins ON ins.f = p.state
        JOIN edit ON edit.f = ins.t AND edit.c = CASE WHEN j.c IN ('s', 'u', 'a') THEN j.c ELSE '?' END
                 AND (j.fault NOT IN ('blank', 'duplicate') OR e = 'D'))
    QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
best AS (
    SELECT p.conv_id, p.cost + 5 * m AS cost, p.audit || repeat('I', m) AS audit
    FROM path p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i
    JOIN ins ON ins.f = p.state AND ins.t IN ('', 'a')
    QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + 5 * m, p.audit || repeat('I', m)) = 1),
steps AS (
    SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM best),
said AS (
    SELECT *, substr(audit, p, 1) AS e, p - len(replace(left(audit, p), 'I', '')) AS skipped,
           len(regexp_replace(left(audit, p), 'D', '', 'g')) AS place FROM steps),
told AS (
    SELECT s.conv_id, s.place, CASE WHEN e = 'K' THEN j.role ELSE NULL END AS kept, CASE WHEN e = 'I' THEN '' ELSE j.text END AS text
    FROM said s LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.p - s.skipped WHERE e <> 'D'),
systems AS (SELECT conv_id, max(CASE WHEN place = 1 AND left(kept, 1) = 's' THEN 1 ELSE 0 END) AS s FROM told GROUP BY conv_id),
final AS (
    SELECT t.conv_id, sha256(string_agg(
        coalesce(kept, CASE WHEN (place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place)) AS h
    FROM told t JOIN systems y ON y.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY t.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP13_PREFIX_TRIE = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT conv_id, list(md5(octet_length(encode(role)) || ':' || role || text) ORDER BY turn NULLS FIRST, role, md5(text)) AS ks,
           list(octet_length(encode(text)) ORDER BY turn NULLS FIRST, role, md5(text)) AS bs
    FROM t GROUP BY conv_id),
asked AS (SELECT *, xor(""" + CRC32.format(x="conv_id::VARCHAR") + """, 4294967295) % 9 AS h FROM own),
built AS (
    SELECT a.conv_id, list_concat(coalesce(b.ks[1:h], []), a.ks[h + 1:]) AS ks, list_concat(coalesce(b.bs[1:h], []), a.bs[h + 1:]) AS bs
    FROM asked a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
p AS (
    SELECT conv_id, d, len(ks) = d AS ends, array_to_string(ks[1:d], '') AS node,
           CASE WHEN d > 0 THEN array_to_string(ks[1:d - 1], '') END AS parent, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b
    FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM built)),
n AS (
    SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           (count(*) - 1) * any_value(b) AS saved,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM p GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM n GROUP BY parent),
below AS (
    SELECT p.node, sum(n.saved) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
    FROM n LEFT JOIN k USING (node) JOIN p ON p.conv_id = n.conv_id AND p.d <= n.depth GROUP BY p.node)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN k USING (node) JOIN below USING (node) LEFT JOIN n up ON up.node = n.parent
"""

# the join of op1 at another similarity, without its last column
OP12_NGRAM_JOIN = OP1_NEAR_DUPLICATES.replace(">= 75 *", ">= 80 *").replace(", d.doc_id = component_id AS kept", "")
