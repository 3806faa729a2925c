"""DuckDB SQL for the training-data queries that SQL can express."""

_LOWER = ("translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER.format('text')}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

# The clamped sources are those before the first one (by cap per weight) that holds its share.
MIXING = f"""
WITH d AS (SELECT doc_id, source, coalesce(len({_WORDS.format('text')}), 0) AS size,
                  md5('42:' || doc_id) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
c AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(3 * source_size) OVER before, 0) AS clamped,
             sum(weight) OVER (ORDER BY 3.0 * source_size / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
      FROM w WINDOW before AS (ORDER BY 3.0 * source_size / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (total - clamped) * weight > 3 * source_size * open_weight AS over FROM c),
o AS (SELECT min(CASE WHEN NOT over THEN 3.0 * source_size / weight END) AS level FROM f),
p AS (SELECT first(clamped ORDER BY 3.0 * source_size / weight, i) AS clamped, first(open_weight ORDER BY 3.0 * source_size / weight, i) AS open_weight
      FROM f, o WHERE 3.0 * source_size / weight >= level),
t AS (SELECT source, source_size,
             CASE WHEN level IS NULL OR 3.0 * source_size / weight < level THEN 3.0 * source_size
                  ELSE CAST((total - p.clamped) * weight AS DOUBLE) / p.open_weight END::DOUBLE AS target
      FROM f, o, p),
r AS (SELECT doc_id, size, d.source, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
                 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - ahead)) END AS BIGINT) AS taken
FROM r
"""

# Lines are compared as normalised text here; the operator compares their hashes.
QUALITY = fr"""
WITH d AS (SELECT doc_id, coalesce('h' || source, 'null') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, {_WORDS.format('t')} AS ws FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
gg AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS win FROM g),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM gg) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
ls AS (SELECT doc_id, host, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM ls GROUP BY 1),
norm AS (SELECT doc_id, host, trim(regexp_replace({_LOWER.format('l')}, '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
                len({_WORDS.format('l')}) AS n FROM ls),
reps AS (SELECT host, t, min(doc_id) AS doc_id FROM d GROUP BY 1, 2),
hosts AS (SELECT host, count(*) AS host_docs FROM reps GROUP BY 1),
df AS (SELECT n.host, line, count(DISTINCT n.doc_id) AS df FROM norm n JOIN reps r ON n.doc_id = r.doc_id GROUP BY 1, 2),
common AS (SELECT df.host, line FROM df JOIN hosts USING (host) WHERE df > 100 OR (df > 20 AND df > 0.1 * host_docs)),
rem AS (SELECT doc_id, sum(n) AS removed_words FROM norm JOIN common USING (host, line) GROUP BY 1),
b AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
      FROM d JOIN w USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rem USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - removed_words < 0.3 * n_words) AS kept
FROM b
"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
         SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
         UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
