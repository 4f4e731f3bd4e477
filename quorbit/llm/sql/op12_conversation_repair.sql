-- The damage, the faults of each row, the cheapest edits as one step for each row, and what they leave.
WITH RECURSIVE ids AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
keyed AS (
    SELECT i.k, c.turn, coalesce(c.role, ' ') AS role, coalesce(c.text, ' ') AS text, coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(c.turn::VARCHAR, ' ') AS name
    FROM conversations c JOIN ids i ON i.conv_id IS NOT DISTINCT FROM c.conv_id
),
-- CRC-32, bit by bit
kinds AS (
    SELECT *, xor(list_reduce(
        list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT),
        lambda c, b: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind
    FROM keyed
),
damaged AS (
    SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM kinds, range(2) AS r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS n FROM damaged),
judged AS (
    SELECT *, substr(role, 1, 1) AS initial,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
            WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY n) > 1 THEN 'd'
            WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) IN ('.', '!', '?') THEN '.' ELSE 't' END AS fault
    FROM placed
),
faulty AS (SELECT *, fault NOT IN ('b', 'd') AS good, (fault = 't')::INT AS more FROM judged),
sizes AS (SELECT i.k, count(f.n) AS rows FROM ids i LEFT JOIN faulty f USING (k) GROUP BY i.k),
-- w0 to w3: cost and labels of the cheapest edits so far that end at the start, behind s, behind u, behind ua
steps AS (
    SELECT k, 0::BIGINT AS n, {'c': 0::BIGINT, 'l': ''} AS w0, {'c': 1000000000::BIGINT, 'l': ''} AS w1, {'c': 1000000000::BIGINT, 'l': ''} AS w2, {'c': 1000000000::BIGINT, 'l': ''} AS w3 FROM ids
    UNION ALL
    SELECT k, n,
        {'c': b0.c + 3, 'l': b0.l || 'D'},
        least({'c': b1.c + 3, 'l': b1.l || 'D'}, {'c': CASE WHEN good AND initial = 's' THEN b0.c + more ELSE 1000000000 END, 'l': b0.l || 'K'}),
        least({'c': b2.c + 3, 'l': b2.l || 'D'},
            {'c': CASE WHEN good THEN o.c + more + (CASE WHEN initial = 'u' THEN 0 ELSE 2 END) ELSE 1000000000 END, 'l': o.l || (CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END)}),
        least({'c': b3.c + 3, 'l': b3.l || 'D'},
            {'c': CASE WHEN good THEN b2.c + more + (CASE WHEN initial = 'a' THEN 0 ELSE 2 END) ELSE 1000000000 END, 'l': b2.l || (CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END)})
    FROM (
        SELECT *, least(b0, b1, b3) AS o FROM (
            SELECT s.k, f.n, f.good, f.more, f.initial, w0 AS b0, w1 AS b1,
                least(w2, {'c': w0.c + 2, 'l': w0.l || 'I'}, {'c': w1.c + 2, 'l': w1.l || 'I'}, {'c': w3.c + 2, 'l': w3.l || 'I'}) AS b2,
                least(w3, {'c': w2.c + 2, 'l': w2.l || 'I'}, {'c': w0.c + 4, 'l': w0.l || 'II'}, {'c': w1.c + 4, 'l': w1.l || 'II'}) AS b3
            FROM steps s JOIN faulty f ON f.k = s.k AND f.n = s.n + 1
        )
    )
),
best AS (
    SELECT k, least(w0, w3, {'c': w2.c + 2, 'l': w2.l || 'I'}, {'c': w1.c + 4, 'l': w1.l || 'II'}) AS w FROM steps JOIN sizes USING (k) WHERE n = rows
),
letters AS (
    SELECT k, p, w.l[p] AS letter, length(replace(substr(w.l, 1, p), 'I', '')) AS n, length(replace(substr(w.l, 1, p - 1), 'D', '')) AS seq, length(replace(w.l, 'D', '')) % 2 AS system
    FROM best, range(1, length(w.l) + 1) AS r(p)
),
texts AS (
    SELECT l.k, string_agg(CASE WHEN letter = 'K' THEN f.role WHEN (seq - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p) AS repaired
    FROM letters l LEFT JOIN faulty f ON f.k = l.k AND f.n = l.n WHERE letter <> 'D' GROUP BY l.k
),
next AS (SELECT *, lead(initial) OVER (PARTITION BY k ORDER BY n) AS after FROM faulty),
facts AS (
    SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (after IS NOT NULL AND initial || after NOT IN ('su', 'ua', 'au')) AS illegal
    FROM next GROUP BY k
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    w.c AS cost, w.l AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ids LEFT JOIN facts USING (k) LEFT JOIN best USING (k) LEFT JOIN texts USING (k)
