WITH named AS (
  SELECT page_id,
    CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages
),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
outcomes AS (
  SELECT n.host, m.bad FROM named n LEFT JOIN marks m ON m.doc_id = try_cast(nullif(regexp_extract(n.path, '/([0-9]{1,18})[^/0-9]*/?$', 1), '') AS BIGINT)
),
hosts AS (
  SELECT host AS unit, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
    CASE WHEN (regexp_full_match(list_extract(string_split(host, '.'), -1), '[a-z]{2}') AND list_extract(string_split(host, '.'), -2) IN ('ac', 'co', 'com', 'edu', 'gob', 'gov', 'gouv', 'govt', 'info', 'mil', 'ne', 'net', 'nom', 'or', 'org', 'sch'))
      THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS parent,
    CASE WHEN (regexp_full_match(list_extract(string_split(host, '.'), -1), '[a-z]{2}') AND list_extract(string_split(host, '.'), -2) IN ('ac', 'co', 'com', 'edu', 'gob', 'gov', 'gouv', 'govt', 'info', 'mil', 'ne', 'net', 'nom', 'or', 'org', 'sch'))
      THEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') ELSE list_extract(string_split(host, '.'), -1) END AS suffix
  FROM outcomes GROUP BY host
),
domains AS (SELECT parent AS unit, suffix AS parent, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix AS unit, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1),
whole AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n)::DOUBLE ELSE 0.0 END AS rate FROM suffixes),
root AS (SELECT sum(n) AS n, sum(bad) AS bad, 2.0::DOUBLE AS strength, any_value(rate) AS prior FROM suffixes, whole),
s0 AS (
  SELECT u.*, p.n - u.n + p.strength AS made_of, (p.bad - u.bad + p.strength * p.prior) / (p.n - u.n + p.strength) AS prior FROM suffixes u JOIN root p ON true
),
sk AS (
  SELECT CASE WHEN spread > 0 THEN least(1000.0::DOUBLE, greatest(2.0::DOUBLE, expected / spread - 1)) ELSE 1000.0 END AS k
  FROM (SELECT (sum(n * (bad / n::DOUBLE - prior) ** 2) - sum(prior * (1 - prior))) / sum(n) AS spread, sum(n * prior * (1 - prior)) / sum(n) AS expected FROM s0 WHERE n > 0)
),
s1 AS (SELECT *, least(k, made_of) AS strength, (bad + least(k, made_of) * prior) / (n + least(k, made_of)) AS mean FROM s0, sk),
d0 AS (
  SELECT u.*, p.n - u.n + p.strength AS made_of, (p.bad - u.bad + p.strength * p.prior) / (p.n - u.n + p.strength) AS prior FROM domains u JOIN s1 p ON p.unit = u.parent
),
dk AS (
  SELECT CASE WHEN spread > 0 THEN least(1000.0::DOUBLE, greatest(2.0::DOUBLE, expected / spread - 1)) ELSE 1000.0 END AS k
  FROM (SELECT (sum(n * (bad / n::DOUBLE - prior) ** 2) - sum(prior * (1 - prior))) / sum(n) AS spread, sum(n * prior * (1 - prior)) / sum(n) AS expected FROM d0 WHERE n > 0)
),
d1 AS (SELECT *, least(k, made_of) AS strength, (bad + least(k, made_of) * prior) / (n + least(k, made_of)) AS mean FROM d0, dk),
h0 AS (
  SELECT u.*, p.n - u.n + p.strength AS made_of, (p.bad - u.bad + p.strength * p.prior) / (p.n - u.n + p.strength) AS prior FROM hosts u JOIN d1 p ON p.unit = u.parent
),
hk AS (
  SELECT CASE WHEN spread > 0 THEN least(1000.0::DOUBLE, greatest(2.0::DOUBLE, expected / spread - 1)) ELSE 1000.0 END AS k
  FROM (SELECT (sum(n * (bad / n::DOUBLE - prior) ** 2) - sum(prior * (1 - prior))) / sum(n) AS spread, sum(n * prior * (1 - prior)) / sum(n) AS expected FROM h0 WHERE n > 0)
),
h1 AS (SELECT *, least(k, made_of) AS strength, (bad + least(k, made_of) * prior) / (n + least(k, made_of)) AS mean FROM h0, hk),
hb AS (SELECT unit, n, bad, mean, bad + strength * prior AS a, n - bad + strength - strength * prior AS b FROM h1),
h2 AS (
  SELECT *, CASE WHEN a > 0 AND b > 0 THEN greatest(0.0, a / (a + b) + sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    * (-1.645::DOUBLE + (1.645::DOUBLE ** 2 - 1) / 6 * 2 * (b - a) * sqrt(a + b + 1) / ((a + b + 2) * sqrt(a * b)))) ELSE a / (a + b) END AS low FROM hb
),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM named
)
SELECT r.page_id, r.host, r.path, r.rule,
  CASE WHEN r.rule = 'example.com/en/7' THEN 'allow' WHEN r.rule IS NOT NULL THEN 'block'
    WHEN w.rate > 0 AND h.low * (1 - w.rate) > 1.5::DOUBLE * w.rate * (1 - h.low) THEN 'block' ELSE 'allow' END AS verdict,
  CAST(h.n AS BIGINT) AS host_n, CAST(h.bad AS BIGINT) AS host_bad, round(h.mean, 6) AS bad_rate
FROM ruled r JOIN h2 h ON h.unit = r.host, whole w
