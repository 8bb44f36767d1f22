"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from tequant.llm.quality import BITS

_W = r"'[^\x20\x09-\x0D]+'"
_FAILS = {
    "few_words": "n_words < 50",
    "repeats_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "capitals": "2 * n_upper > word_chars",
    "separators": "20 * n_bare > n_words AND n_bare > 2",
    "shouts": "3 * n_marks > n_words AND n_marks > 5",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 1",
}

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT r, doc_id, t, regexp_extract_all(t, {_W}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
 g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
 c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
 p AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY r),
 m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
   CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
   len(list_filter(w, lambda x: x IN ('|', '-', '*', '•', '/', '=', '~'))) AS n_bare, length(t) - length(replace(t, '!', '')) AS n_marks
  FROM w LEFT JOIN p USING (r)),
 f AS (SELECT *, CAST({" + ".join(f"CASE WHEN {_FAILS[k]} THEN {b} ELSE 0 END" for k, b in BITS.items())} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""

URLS = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
 h AS (SELECT page_id, coalesce(translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(x, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
 u AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS u(v, rh, rp)),
 j AS (SELECT h.*, v, rh || rp AS rule, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh) + length(rp) DESC NULLS LAST, v DESC) AS k
  FROM h LEFT JOIN u ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE k = 1
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
 u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, [CAST('0x' || substr(s, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS h FROM d),
 f AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
 c AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m WHEN 'spm' THEN '<S>' || z || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""

COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
 g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
 f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
 n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
 x AS (SELECT lang, phrase, a, n, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM f JOIN n USING (lang) WHERE k > 1),
 s AS (SELECT x.lang, x.phrase, x.a, n, j, l.a AS l, r.a AS r, CAST((CAST(1000 AS HUGEINT) * x.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[:j], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[j + 1:], ' ')),
 c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
 o AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.lang = c.lang AND y.phrase <> c.phrase AND contains(' ' || y.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * y.a >= 100 * c.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {"op3_quality_rules": QUALITY, "op9_url_filter": URLS, "op12_fill_in_middle": FILL_IN_MIDDLE, "op13_collocations": COLLOCATIONS}
