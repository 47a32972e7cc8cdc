"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                AND list_cosine_similarity(a.e, b.e) >= 0.93
        ), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1
        ), r AS (SELECT a AS x, a AS y FROM n UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a
        ), c AS (SELECT x, min(y) AS m FROM r GROUP BY 1)
        SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN n ON vec_id = a LEFT JOIN c ON vec_id = x
    """,
    "op3_html_extraction": r"""
        WITH a AS (
            SELECT page_id, url, regexp_replace(regexp_replace(coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), ''),
                '<br>', ' ', 'g'), '</?b>', '', 'g') AS h FROM pages
        ), t AS (
            SELECT page_id, url, array_to_string(list_filter(list_transform(regexp_split_to_array(h, '</?(?:p|h1)>'),
                lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),
                    '&quot;?', '"', 'g'), '&#x27;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM a
        )
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
    """,
    "op5_chat_formatting": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok', 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok', 'assistant', '<|im_end|><|im_start|>assistant ok'
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(24 + length(regexp_replace(role, '<(\|+)', '<|\1', 'g')) + 5 * (length(role) - length(replace(role, chr(10), '')))
                + length(regexp_replace(text, '<(\|+)', '<|\1', 'g'))) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id
    """,
    "op6_warc": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > first_id THEN first_id END AS refers_to, true AS verified
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op8_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
            FROM d GROUP BY source
        ), r AS (
            SELECT *, 2 * source_size / weight AS ratio, 1.5 * (SELECT sum(source_size) FROM s) AS budget FROM s
        ), c AS (
            SELECT *, (budget - coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM r
        ), l AS (SELECT coalesce(arg_min(level, ratio) FILTER (WHERE level < ratio), max(ratio)) AS level FROM c
        ), t AS (
            SELECT source, source_size, least(2.0 * source_size, weight * l.level)::DOUBLE AS target FROM s, l
        ), n AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM s
        ), q AS (
            SELECT doc_id, nth, size, source_size, target,
                coalesce(sum(size) OVER (PARTITION BY nth ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN n ON d.source IS NOT DISTINCT FROM n.source
        ), w AS (
            SELECT nth, target, least(25, size - off) AS words, before + source_size * pass + off AS b
            FROM (SELECT *, unnest(range(0, size, 25)) AS off FROM q, (VALUES (0), (1)) AS p(pass) WHERE size > 0)
        ), o AS (
            SELECT nth, words, coalesce(sum(words) OVER (ORDER BY (b + words)::DOUBLE / target, nth, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
            FROM w
        ), k AS (SELECT nth, sum(greatest(0, least(words, (SELECT floor(max(budget)) FROM r) - spent))) AS served FROM o GROUP BY nth)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
            CAST(greatest(0, least(size, coalesce(served, 0) - before)) + greatest(0, least(size, coalesce(served, 0) - before - source_size)) AS BIGINT) AS taken
        FROM q LEFT JOIN k USING (nth)
    """,
    "op9_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), win AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT n FROM win
        ), docwin AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
        ), hit AS (
            SELECT doc_id, item_id, i, docwin.n AS n FROM docwin JOIN win USING (n, s)
        ), hw AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1
        ), it AS (
            SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS l
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
    "op11_line_dedup": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS doc, row_number() OVER () AS r,
                string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), l AS (
            SELECT doc_id, doc, r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d
        ), k AS (
            SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l
        ), f AS (
            SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc) >= 5
        ), m AS (
            SELECT k.*, coalesce(keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper, false) AS gone FROM k LEFT JOIN f USING (key)
        )
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY r
    """,
    "op12_source_divergence": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ), t AS (SELECT r, lang, source, unnest(w) AS term FROM d
        ), kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30
        ), l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1
        ), c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
        ), g AS (
            SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS n FROM d GROUP BY ALL
        ), p AS (
            SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.n + 5 * l.v)::HUGEINT AS p,
                1 + 1000000000::HUGEINT * (kept.n + 5) // (l.n + 5 * l.v)::HUGEINT AS q
            FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
        ), s AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
        ), u AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
            CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM u QUALIFY part = 'pair' OR rank <= 50
    """,
    "op13_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id AS c, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
                len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL
        ), o AS (
            SELECT c, list({'k': k, 'words': words} ORDER BY turn NULLS FIRST, k) AS x FROM t GROUP BY 1
        ), h AS (
            SELECT c, c - c % 20 AS b, x, xor(4294967295::BIGINT, list_reduce(
                list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda y: ascii(y)::BIGINT)),
                lambda s, y: list_reduce([xor(s, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda z, n: xor(z >> 1, 3988292384 * (z & 1))))) % 4 AS h FROM o
        ), r AS (
            SELECT h.c, list_concat(coalesce(o.x, [])[1:h.h], h.x[h.h + 1:]) AS x FROM h LEFT JOIN o ON o.c = h.b
        ), p AS (
            SELECT c, len(x) AS n, d, array_to_string(list_transform(x[1:d], lambda y: y.k), ' ') AS node,
                CASE WHEN d > 0 THEN array_to_string(list_transform(x[1:d - 1], lambda y: y.k), ' ') END AS parent,
                CASE WHEN d > 0 THEN x[d].words ELSE 0 END AS words
            FROM (SELECT *, unnest(range(0, len(x) + 1)) AS d FROM r)
        ), g AS (
            SELECT node, d, any_value(parent) AS parent, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(words) AS saved,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends FROM p GROUP BY node, d
        ), k AS (SELECT parent AS node, d - 1 AS d, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL
        ), q AS (
            SELECT a.node, a.d, sum(g.saved) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
            FROM g JOIN p a ON a.c = g.c AND a.d <= g.d LEFT JOIN k ON k.node = g.node AND k.d = g.d GROUP BY a.node, a.d
        )
        SELECT g.c AS conv_id, g.d AS depth, u.c AS parent_conv_id, g.n AS n_convs, coalesce(k.n, 0) AS n_children, q.leaves AS n_leaves,
            CAST(q.saved AS BIGINT) AS saved_tokens, g.ends AS ends_sha256
        FROM g JOIN q ON q.node = g.node AND q.d = g.d LEFT JOIN k ON k.node = g.node AND k.d = g.d LEFT JOIN g u ON u.node = g.parent AND u.d = g.d - 1
    """,
}
