-- Whole numbers in doubles: exact below 2^53, which these vectors are far under.
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS place, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (
    SELECT place, p AS part, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS t(p)
),
book0 AS MATERIALIZED (SELECT part, place - 1 AS entry, x AS c FROM parts WHERE place <= 256),
near0 AS MATERIALIZED (
    SELECT part, place, min({'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': entry}) AS best
    FROM parts JOIN book0 USING (part) GROUP BY part, place
),
sums1 AS (
    SELECT part, best.e AS entry, i, floor(sum(x[i]) / count(*)) AS c
    FROM near0 JOIN parts USING (part, place), range(1, 257) AS t(i) WHERE i <= len(x) GROUP BY part, best.e, i
),
book1 AS MATERIALIZED (
    SELECT part, entry, coalesce(any_value(s.c), any_value(b.c)) AS c
    FROM book0 b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS c FROM sums1 GROUP BY part, entry) s USING (part, entry) GROUP BY part, entry
),
near1 AS MATERIALIZED (
    SELECT part, place, min({'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': entry}) AS best
    FROM parts JOIN book1 USING (part) GROUP BY part, place
),
sums2 AS (
    SELECT part, best.e AS entry, i, floor(sum(x[i]) / count(*)) AS c
    FROM near1 JOIN parts USING (part, place), range(1, 257) AS t(i) WHERE i <= len(x) GROUP BY part, best.e, i
),
book2 AS MATERIALIZED (
    SELECT part, entry, coalesce(any_value(s.c), any_value(b.c)) AS c
    FROM book1 b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS c FROM sums2 GROUP BY part, entry) s USING (part, entry) GROUP BY part, entry
),
near2 AS MATERIALIZED (
    SELECT part, place, min({'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': entry}) AS best
    FROM parts JOIN book2 USING (part) GROUP BY part, place
),
sums3 AS (
    SELECT part, best.e AS entry, i, floor(sum(x[i]) / count(*)) AS c
    FROM near2 JOIN parts USING (part, place), range(1, 257) AS t(i) WHERE i <= len(x) GROUP BY part, best.e, i
),
book3 AS MATERIALIZED (
    SELECT part, entry, coalesce(any_value(s.c), any_value(b.c)) AS c
    FROM book2 b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS c FROM sums3 GROUP BY part, entry) s USING (part, entry) GROUP BY part, entry
),
near3 AS MATERIALIZED (
    SELECT part, place, min({'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': entry}) AS best
    FROM parts JOIN book3 USING (part) GROUP BY part, place
),
sums4 AS (
    SELECT part, best.e AS entry, i, floor(sum(x[i]) / count(*)) AS c
    FROM near3 JOIN parts USING (part, place), range(1, 257) AS t(i) WHERE i <= len(x) GROUP BY part, best.e, i
),
book4 AS MATERIALIZED (
    SELECT part, entry, coalesce(any_value(s.c), any_value(b.c)) AS c
    FROM book3 b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS c FROM sums4 GROUP BY part, entry) s USING (part, entry) GROUP BY part, entry
),
near4 AS MATERIALIZED (
    SELECT part, place, min({'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': entry}) AS best
    FROM parts JOIN book4 USING (part) GROUP BY part, place
),
coded AS (
    SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
    FROM near4 JOIN kept USING (place) GROUP BY place, vec_id, label
),
digest AS (
    SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda x: x::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book4
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
