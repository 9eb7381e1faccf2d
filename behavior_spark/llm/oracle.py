"""SQL (DuckDB dialect) for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
lines AS (SELECT doc_id, text, w, len(w) AS n,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
windows AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS s FROM d, unnest(range(1, len(w) - 1)) AS t(p)),
repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS k FROM windows) WHERE k > 1),
covered AS (SELECT doc_id, count(DISTINCT p + o) AS c FROM repeated, range(3) AS r(o) GROUP BY doc_id),
measured AS (SELECT lines.doc_id, n, w, l, len(l) AS nl, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(c, 0) AS n_repeat_words FROM lines LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n < 50 OR 100 * n_repeat_words > 50 * n AS base_failed FROM measured)
SELECT doc_id, n AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars BETWEEN 2 * n AND 14 * n AND 10 * n_symbols <= 3 * n AND 2 * n_dup_lines <= nl
    AND 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) >= 6 * n
    AND NOT (nl > 3 AND 10 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 5 * nl)
    AND NOT (nl > 3 AND 10 * len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(- |\* |•)'))) > 9 * nl) AS kept
FROM judged"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(p)),
repeats AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p + o AS pos FROM repeats, range(20) AS r(o)),
words AS (SELECT doc_id, pos, w[pos] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(pos)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS s FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""

COLLOCATIONS = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
d AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM d GROUP BY lang),
f AS (SELECT lang, array_to_string(w[p : p + k - 1], ' ') AS phrase, k, count(*) AS f
    FROM d, unnest(range(1, 6)) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(p) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k AS m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS x
    WHERE x.lang = c.lang AND x.m > c.m AND x.a >= c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT kept.lang, kept.phrase, a, t.k AS k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM kept, unnest(range(1, m)) AS t(k), f AS l, f AS r, total
    WHERE l.lang = kept.lang AND l.phrase = array_to_string(kept.w[1 : t.k], ' ') AND r.lang = kept.lang
    AND r.phrase = array_to_string(kept.w[t.k + 1 :], ' ') AND total.lang = kept.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000"""
