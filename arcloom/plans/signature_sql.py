"""SQL that takes signatures apart by their definition, for comparison."""

#: A signature taken apart character by character: parameters end at commas outside of all brackets, types lose their arguments, names and packages.
SIGNATURES = """
ch AS (SELECT m, i, m[i] AS c FROM (SELECT DISTINCT m FROM names) t, (SELECT unnest(range(1, 400)) AS i) r WHERE i <= length(m)),
op AS (SELECT m, min(CASE WHEN c = '(' THEN i END) AS o, max(CASE WHEN c = ')' THEN i END) AS z FROM ch GROUP BY m),
dp AS (SELECT ch.m, i, c, sum(CASE WHEN c = '<' THEN 1 WHEN c = '>' THEN -1 ELSE 0 END) OVER w AS ang, sum(CASE WHEN c IN ('(', '[') THEN 1 WHEN c IN (')', ']') THEN -1 ELSE 0 END) OVER w AS par
  FROM ch JOIN op ON op.m = ch.m AND i > o AND i < z WINDOW w AS (PARTITION BY ch.m ORDER BY i)),
pn AS (SELECT *, sum(CASE WHEN c = ',' AND ang = 0 AND par = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY i) AS k FROM dp),
pa AS (SELECT m, k, trim(string_agg(c, '' ORDER BY i)) AS p FROM pn WHERE ang = 0 AND c <> '>' AND NOT (c = ',' AND par = 0) GROUP BY m, k),
ty AS (SELECT m, string_agg(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '^(?:final\\s+|@\\w+(?:\\([^)]*\\))?\\s+)+', ''), '\\s+\\w+$', ''), '\\s+', '', 'g'), '^(?:\\w+\\.)+(\\w)', '\\1'), ',' ORDER BY k) AS types FROM pa WHERE p <> '' GROUP BY m),
hd AS (SELECT m, trim(split_part(m, '(', 1)) AS h FROM (SELECT DISTINCT m FROM names)),
cs AS (SELECT m, CASE WHEN contains(h, '.') THEN regexp_extract(h, '^(.*)\\.[^.]*$', 1) END AS cls, regexp_extract(h, '([^.]*)$', 1) AS short FROM hd),
nm AS (SELECT cs.m, cls, CASE WHEN short = '<init>' THEN regexp_extract(cls, '([^.]*)$', 1) ELSE short END AS method, coalesce(types, '') AS types FROM cs LEFT JOIN ty ON ty.m = cs.m),
sg AS (SELECT m, cls, method, coalesce(cls || '.', '') || method || '(' || types || ')' AS normalised FROM nm)"""
