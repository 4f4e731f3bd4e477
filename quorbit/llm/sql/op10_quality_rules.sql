WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
),
lined AS (
  SELECT *, list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS with_word,
    list_filter(lines, lambda l: NOT regexp_matches(l, '[^\x20\x09-\x0D]') OR (
      (len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda w: w <> '')) < 12 OR regexp_matches(l, '[.!?…:;。！？]'))
      AND length(regexp_replace(l, '[^#*$%&]+', '', 'g')) <= 0.05::DOUBLE * length(l)
      AND length(regexp_replace(l, '[^!?]+', '', 'g')) <= len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda w: w <> '')) * 0.2::DOUBLE * 2
      AND (length(regexp_replace(l, '[^|»•·]+', '', 'g')) < 3 OR length(regexp_replace(l, '[^|»•·]+', '', 'g')) < len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda w: w <> '')) * 0.15::DOUBLE)
      AND NOT (len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda w: w <> '')) <= 40 AND regexp_matches(lower(l), 'all rights reserved|terms of (use|service)|privacy policy|cookie policy|use of cookies|enable javascript|sign up|log ?in to|subscribe to|click here|copyright ?(\(c\)|©|\d{4})|licensed under (the|a) |released under (the|a) .{0,30}licen[cs]e|spdx-license'))
    )) AS clean
  FROM texts
),
spans AS (
  SELECT doc_id, text, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT DISTINCT doc_id, text, words FROM lined), LATERAL (SELECT unnest(generate_series(1, len(words) - 2)) AS i)
),
again AS (SELECT doc_id, text, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, text, w) AS n FROM spans) WHERE n > 1),
covered AS (SELECT doc_id, text, count(DISTINCT p) AS n FROM (SELECT doc_id, text, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id, text),
counted AS (
  SELECT l.doc_id, CAST(len(l.words) AS BIGINT) AS n_words, CAST(length(array_to_string(l.words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(l.text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l.with_word) - len(list_distinct(l.with_word)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(regexp_replace(array_to_string(l.clean, ''), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS kept_chars
  FROM lined l LEFT JOIN covered c ON c.doc_id IS NOT DISTINCT FROM l.doc_id AND c.text = l.text
),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN 1 - kept_chars / word_chars::DOUBLE ELSE 0.0 END AS lost FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 AS kept, kept_chars, round(lost, 6) AS lost FROM judged
