"""The queries of this subpackage as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

JUMP = """
jumps(doc_id, shards, k, b, j) AS (
    SELECT doc_id, s.shards, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616
        ELSE coalesce(doc_id, 0)::HUGEINT END, -1::BIGINT, 0::BIGINT
    FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (8), (9)) s(shards)
    UNION ALL
    SELECT doc_id, shards, n, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((n // 8589934592)::DOUBLE + 1)))::BIGINT
    FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS n FROM jumps WHERE j < shards)
)"""

CHECKS: dict[str, str] = {}

CHECKS["op10_quality_rules"] = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        string_split(coalesce(text, ''), chr(10)) AS l
    FROM documents
), win AS (
    SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
    SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rep AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY doc_id
), b AS (
    SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
            - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words
    FROM d LEFT JOIN rep USING (doc_id)
), ln AS (
    SELECT doc_id, source, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS x
    FROM (SELECT doc_id, source, unnest(l) AS x FROM d)
), lh AS (
    SELECT doc_id, source, md5(x) AS h, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM ln WHERE x <> ''
), copy AS (
    SELECT doc_id, list(md5(trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'))) ORDER BY p)
        FILTER (trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) <> '') AS copy
    FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM d) GROUP BY doc_id
), held AS (SELECT d.doc_id, source, array_to_string(coalesce(copy, []), ',') AS copy FROM d JOIN copy USING (doc_id)),
holders AS (
    SELECT lh.source, h, count(DISTINCT copy) AS holders FROM lh JOIN held USING (doc_id) GROUP BY lh.source, h
), frequent AS (
    SELECT holders.source, h FROM holders
    JOIN (SELECT source, count(DISTINCT copy) AS n FROM held GROUP BY source) z ON holders.source IS NOT DISTINCT FROM z.source
    WHERE holders > 20 AND holders * 100 > n * 2
), lost AS (
    SELECT doc_id, sum(words) AS lost FROM lh SEMI JOIN frequent
        ON lh.source IS NOT DISTINCT FROM frequent.source AND lh.h = frequent.h GROUP BY doc_id
), v AS (
    SELECT b.*, coalesce(lost, 0)::BIGINT AS n_shared_words,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        100 * coalesce(lost, 0) > 70 * n_words AS depleted
    FROM b LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_shared_words, base_failed, depleted,
    NOT base_failed AND NOT depleted AS kept
FROM v
"""

# CRC-32 with one table step for each byte; the table comes from the polynomial by eight steps for each entry.
CRC = """
crc_table AS (
    SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1
        THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab FROM range(256) r(n)
),
crc AS (
    SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes),
        lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) AS text_crc32
    FROM (SELECT doc_id, octet_length(raw) + 1 AS size, list_transform(range(1, octet_length(raw) + 1),
        lambda i: ('0x' || substr(digits, 2 * i - 1, 2))::BIGINT) AS bytes
        FROM (SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS digits FROM documents)),
        crc_table
)"""

CHECKS["op5_sharding"] = f"""
WITH RECURSIVE {JUMP},
placed AS (SELECT doc_id, shards, max(b)::INTEGER AS shard FROM jumps WHERE j >= shards GROUP BY doc_id, shards),
{CRC}
SELECT d.doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, a.shard,
    row_number() OVER (PARTITION BY a.shard ORDER BY md5(d.doc_id::VARCHAR), d.doc_id) - 1 AS slot,
    g.shard AS grown_shard
FROM crc d JOIN placed a ON a.doc_id = d.doc_id AND a.shards = 8
JOIN placed g ON g.doc_id = d.doc_id AND g.shards = 9
"""

WORDS = r"""d AS (
    SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents
)"""

CHECKS["op1_substring_dedup"] = "WITH " + WORDS.format(text="coalesce(text, '')") + """,
win AS (
    SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), held AS (SELECT g, min(doc_id) AS first_doc FROM win GROUP BY g),
gone AS (
    SELECT DISTINCT win.doc_id, i + k AS p FROM win JOIN held USING (g), range(13) r(k) WHERE first_doc < win.doc_id
), word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (
    SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]


def escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


CHECKS["op2_chat_formatting"] = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), said AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(9 + length({escaped("role")}) + length(role) - length(replace(role, chr(10), '')) + length({escaped("text")}))
            AS formatted_chars
    FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    formatted_chars::BIGINT AS formatted_chars
FROM said
"""

CHECKS["op7_lm_scoring"] = "WITH " + WORDS.format(text="coalesce(text, '')") + """,
spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
gram AS (
    SELECT doc_id, p, w[p] AS g1, CASE WHEN p > 1 THEN w[p - 1] || ' ' || w[p] END AS g2,
        CASE WHEN p > 1 THEN w[p - 1] END AS h1, CASE WHEN p > 2 THEN w[p - 2] || ' ' || w[p - 1] || ' ' || w[p] END AS g3,
        CASE WHEN p > 2 THEN w[p - 2] || ' ' || w[p - 1] END AS h2
    FROM spot
), c1 AS (SELECT g1 AS g, count(*) AS n FROM gram GROUP BY 1), c2 AS (SELECT g2 AS g, count(*) AS n FROM gram GROUP BY 1),
c3 AS (SELECT g3 AS g, count(*) AS n FROM gram GROUP BY 1),
counted AS (
    SELECT doc_id, g2, g3, a.n AS n1, b.n AS n2, c.n AS n3, x.n AS m1, y.n AS m2
    FROM gram JOIN c1 a ON a.g = g1 LEFT JOIN c2 b ON b.g = g2 LEFT JOIN c3 c ON c.g = g3
    LEFT JOIN c1 x ON x.g = h1 LEFT JOIN c2 y ON y.g = h2
), scored AS (
    SELECT doc_id, CASE WHEN g3 IS NOT NULL AND n3 >= 2 THEN ln(n3 / m2)
        WHEN g2 IS NOT NULL AND n2 >= 2 THEN ln(n2 / m1) + CASE WHEN g3 IS NOT NULL THEN ln(0.4) ELSE 0 END
        ELSE ln(n1 / (SELECT count(*) FROM gram))
            + (CASE WHEN g2 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN g3 IS NOT NULL THEN 1 ELSE 0 END) * ln(0.4) END AS s,
        (g3 IS NOT NULL AND n3 < 2) OR (g3 IS NULL AND g2 IS NOT NULL AND n2 < 2) AS off
    FROM counted
), summed AS (SELECT doc_id, sum(s) AS s, count(*) FILTER (off) AS off FROM scored GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, round(coalesce(s, 0), 4) AS log_score, coalesce(off, 0) AS n_backed_off
FROM d LEFT JOIN summed USING (doc_id)
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHECKS["op9_ngram_jaccard"] = "WITH RECURSIVE " + WORDS.format(
    text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')") + """,
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(a, b) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reach.a, l.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = reach.b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(reach.b) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY ALL
"""

ASSIGN = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)"""
CHECKS["op11_secret_scans"] = """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), pattern(kind, name, p) AS (VALUES (0, 'assign', $ASSIGN), (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]{24,}'),
    (3, 'owned', '[A-Za-z0-9+/_=-]{20,}')
), listed AS (
    SELECT r, 0 AS kind, regexp_extract_all(t, $ASSIGN) AS hits, string_split_regex(t, $ASSIGN) AS gaps FROM d
    UNION ALL SELECT r, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
    UNION ALL SELECT r, 2, regexp_extract_all(t, '[0-9a-f]{24,}'), string_split_regex(t, '[0-9a-f]{24,}') FROM d
    UNION ALL SELECT r, 3, regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}'), string_split_regex(t, '[A-Za-z0-9+/_=-]{20,}') FROM d
), one AS (
    SELECT r, kind, hits[k] AS hit, list_sum(list_transform(gaps[1:k], lambda x: length(x)))
        + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM listed)
), valued AS (
    SELECT r, kind, s::BIGINT AS s, (s + length(hit))::BIGINT AS e,
        CASE WHEN kind = 0 THEN regexp_extract(hit, $ASSIGN, 2) ELSE hit END AS v, length(hit) AS n FROM one
), looked AS (
    SELECT *, length(regexp_replace(v, '[^0-9]', '', 'g')) >= 4 AND length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 4
        AND len(list_distinct(string_split(v, ''))) >= 10 AS random FROM valued
), base AS (SELECT * FROM looked WHERE (kind = 0 AND length(v) >= 6) OR (kind = 1 AND n >= 20) OR kind = 2),
spans AS (
    SELECT * FROM base
    UNION ALL
    SELECT * FROM looked o WHERE kind = 3 AND random
        AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = o.r AND b.s < o.e AND o.s < b.e)
), owners AS (
    SELECT v, count(DISTINCT coalesce(source, chr(0))) AS n_owners,
        count(DISTINCT (coalesce(source, chr(0)), coalesce(doc_id::VARCHAR, ''))) AS n_repositories
    FROM spans JOIN d USING (r) GROUP BY v
), judged AS (
    SELECT *, CASE WHEN n_owners > 2 OR n_repositories > 20 THEN 'example' WHEN random THEN 'live' ELSE 'unclear' END AS verdict
    FROM spans JOIN owners USING (v)
), summed AS (
    SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
        string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans,
        count(*) FILTER (kind = 3) AS n_added, count(*) FILTER (verdict = 'live') AS n_live,
        count(*) FILTER (verdict = 'example') AS n_example
    FROM judged JOIN pattern USING (kind) WHERE kind < 3 OR verdict = 'live' GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added,
    coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN summed USING (r)
""".replace("$ASSIGN", "'" + ASSIGN.replace("'", "''") + "'")

# The polynomial of CRC-32, eight steps for each of the digits of an id.
CHECKS["op12_prefix_trie"] = """
WITH turn AS (
    SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
        length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids, list(chars ORDER BY turn NULLS FIRST, id) AS chars
    FROM turn GROUP BY conv_id
), borrowed AS (
    SELECT conv_id, ids, chars, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda r, k: CASE WHEN r & 1 = 1
        THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))) % 6 AS h FROM own
), rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.ids, [])[1:h], o.ids[h + 1:]) AS ids,
        list_concat(coalesce(b.chars, [])[1:h], o.chars[h + 1:]) AS chars
    FROM borrowed o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), member AS (
    SELECT conv_id, d AS depth, md5(array_to_string(ids[1:d], ',')) AS node, chars[d] AS chars, d = len(ids) AS ends,
        CASE WHEN d > 0 THEN md5(array_to_string(ids[1:d - 1], ',')) END AS parent, ids[d] AS turn_id
    FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM rebuilt)
), node AS (
    SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
        (count(*) - 1) * coalesce(any_value(chars), 0) AS saved, any_value(turn_id) AS turn_id,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM member GROUP BY node, depth
), child AS (SELECT parent AS node, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY parent),
below AS (
    SELECT a.node, sum(n.saved)::BIGINT AS saved_tokens, count(*) FILTER (n.node NOT IN (SELECT node FROM child)) AS n_leaves
    FROM node n JOIN member a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, n_leaves, saved_tokens,
    n.ends_sha256, n.turn_id
FROM node n LEFT JOIN node p ON p.node = n.parent LEFT JOIN child c ON c.node = n.node JOIN below b ON b.node = n.node
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CHECKS["op13_ranked_search"] = f"""
WITH term AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS t FROM documents
), size AS (SELECT doc_id, count(*) AS n FROM term GROUP BY doc_id),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM size),
posting AS (SELECT t, doc_id, count(*) AS tf FROM term GROUP BY ALL),
weighted AS (
    SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, total
    GROUP BY t, big_n
), asked AS (
    SELECT item_id, t, count(*) AS q FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS t FROM benchmark
    ) GROUP BY ALL
), scored AS (
    SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
    FROM asked JOIN weighted USING (t) JOIN posting USING (t) JOIN size USING (doc_id), total GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
