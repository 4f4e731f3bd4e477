WITH texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
full_lines AS (
  SELECT doc_id, text, i, trim(translate(lines[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) AS s
  FROM texts, LATERAL (SELECT unnest(generate_series(1, len(lines))) AS i)
),
held AS (SELECT doc_id, text, i, s, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS j FROM (SELECT DISTINCT * FROM full_lines WHERE s <> '')),
windows AS (
  SELECT a.doc_id, a.text, a.i AS first_line, c.i AS last_line, a.s || chr(10) || b.s || chr(10) || c.s AS w
  FROM held a JOIN held b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.text = b.text AND b.j = a.j + 1
    JOIN held c ON a.doc_id IS NOT DISTINCT FROM c.doc_id AND a.text = c.text AND c.j = a.j + 2
),
ordered AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, first_line) AS n FROM windows),
gone AS (SELECT DISTINCT doc_id, text, unnest(generate_series(first_line, last_line)) AS i FROM ordered WHERE n > 1),
sets AS (SELECT doc_id, text, list(i) AS gone FROM gone GROUP BY doc_id, text)
SELECT t.doc_id, CAST(coalesce(len(t.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(s.gone), 0) AS BIGINT) AS n_removed,
  md5(array_to_string(list_transform(list_filter(generate_series(1, len(t.lines)), lambda i: s.gone IS NULL OR NOT list_contains(s.gone, i)), lambda i: t.lines[i]), chr(10))) AS text_md5
FROM texts t LEFT JOIN sets s ON s.doc_id IS NOT DISTINCT FROM t.doc_id AND s.text = t.text
