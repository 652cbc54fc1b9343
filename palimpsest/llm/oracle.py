"""The opN_ queries as DuckDB SQL, where SQL can express them."""

WS = "[\\x20\\x09-\\x0D]"

SQL: dict[str, str] = {}

SQL["op10_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

SQL["op5_fair_mix"] = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS k,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, source_size * 3 / weight AS r FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3)::DOUBLE
        / (sum(weight) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM r),
t AS (SELECT source, source_size, least((source_size * 3)::DOUBLE, (SELECT arg_min(lev, r) FROM l WHERE lev <= r) * weight::DOUBLE) AS target FROM l),
f AS (SELECT d.*, t.source_size, t.target,
        sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS served
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, k, size, e, (e * source_size + served)::DOUBLE / target AS vft FROM f, (VALUES (0), (1), (2)) AS g(e)
      WHERE size > 0 AND target > 0),
g AS (SELECT doc_id, size, sum(size) OVER (ORDER BY vft, k, doc_id, e ROWS UNBOUNDED PRECEDING) AS run FROM c),
n AS (SELECT doc_id, count(*) AS copies FROM g WHERE run <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT f.doc_id, f.size, f.source_size::BIGINT AS source_size, f.target, (coalesce(n.copies, 0) * f.size)::BIGINT AS taken
FROM f LEFT JOIN n ON f.doc_id = n.doc_id
"""

SQL["op7_line_quality"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d)),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM u),
x AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS gap FROM v WHERE n > 1),
y AS (SELECT doc_id, sum(gap)::BIGINT AS rep FROM x GROUP BY doc_id),
z AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        list_filter(ls, lambda q: regexp_matches(q, '[^\x20\x09-\x0D]')) AS f, coalesce(rep, 0) AS n_repeat_words,
        length(regexp_replace(array_to_string(list_filter(ls, lambda q: NOT (
            (length(q) > 0 AND length(regexp_replace(q, '[^\p{L}\p{N}\s]+', '', 'g')) < 0.75 * length(q))
            OR regexp_matches(q, '( [|»›·•>] [^|»›·•>]*){3}')
            OR regexp_matches(q, '(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie|click here|subscribe (now|to)|sign up|log ?in|share this|read more|enable javascript|licensed under|copyright|©)'))), ''), '[\x20\x09-\x0D]+', '', 'g')) AS kept_chars
      FROM d LEFT JOIN y USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, (len(f) - len(list_distinct(f)))::BIGINT AS n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND CASE WHEN word_chars > 0 THEN 1 - kept_chars::DOUBLE / word_chars ELSE 0 END <= 0.5 AS kept
FROM z
"""

SQL["op9_reply_trees"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, replace(replace(replace(text, '\', '\s'), '<', '\l'), '"', '\q') AS et,
        replace(replace(replace(role, '\', '\s'), '<', '\l'), '"', '\q') AS er FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(22 + length(er) + length(et))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL["op3_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d)),
v AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM u) WHERE n > 1),
x AS (SELECT DISTINCT r, i + o AS i FROM v, range(0, 35) AS t(o)),
k AS (SELECT d.r, e.i, d.w[e.i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS i) AS e
      WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.r = d.r AND x.i = e.i)),
s AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM k GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r)
"""
