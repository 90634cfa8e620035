"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from takerank.llm import licenses, quality, secrets

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

_STOCK = "list_sum(list_transform([" + ", ".join(f"'{p}'" for p in quality.BOILERPLATE) + "], lambda p: CASE WHEN contains(lower(x), p) THEN len(p) ELSE 0 END))"
_WORDS_OF = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, {_WORDS_OF.format('t')} AS words, string_split(t, chr(10)) AS lines FROM t
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS h FROM w WHERE len(words) >= 8
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) > 1 AS again FROM windows
), gaps AS (
  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS covers FROM twice WHERE again
), repeats AS (
  SELECT doc_id, sum(covers)::BIGINT AS n_repeat_words FROM gaps GROUP BY doc_id
), l AS (
  SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS x FROM w
), lw AS (
  SELECT doc_id, i, x, {_WORDS_OF.format('x')} AS words FROM l
), lm AS (
  SELECT *, len(words) AS n, len(array_to_string(words, '')) AS solid, row_number() OVER (PARTITION BY doc_id, x ORDER BY i) > 1 AS again,
    len(list_filter(words, lambda v: regexp_matches(v, '{quality.LOUD_END}'))) AS loud,
    len(list_filter(words, lambda v: regexp_matches(v, '{quality.SEPARATOR}'))) AS separators,
    len(regexp_extract_all(x, '{quality.SYMBOLS}')) AS symbols,
    len(list_filter(range(2, len(words) + 1), lambda j: words[j] = words[j - 1])) AS same
  FROM lw
), judged AS (
  SELECT *, n > 0 AND (again OR 2 * loud >= n OR 5 * symbols >= solid OR (n >= 10 AND NOT regexp_matches(x, '[.,;:!?…。、！？，]'))
    OR 3 * separators >= n OR (separators >= 2 AND n - separators <= 3 * (separators + 1)) OR (n >= 4 AND 3 * same >= 2 * n)
    OR (stock > 0 AND 100 * stock >= 10 * len(x))) AS bad
  FROM (SELECT *, {_STOCK} AS stock FROM lm)
), lost AS (
  SELECT doc_id, count(*) FILTER (n > 0 AND again) AS n_dup_lines, coalesce(sum(solid) FILTER (bad), 0) AS lost_chars,
    coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT bad), '') AS clean
  FROM judged GROUP BY doc_id
), m AS (
  SELECT doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(t, '{quality.SYMBOLS}')) AS n_symbols,
    n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost_chars, clean
  FROM w JOIN lost USING (doc_id) LEFT JOIN repeats USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  lost_chars::BIGINT AS lost_chars, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words AND 100 * lost_chars <= 40 * word_chars AS kept, len(clean)::BIGINT AS clean_chars, sha256(clean) AS clean_sha256
FROM m
"""

_EACH = " UNION ALL ".join(
    f"""SELECT doc_id, {i} AS place, '{r.kind}' AS kind, unnest(regexp_extract_all(t, $p${r.pattern}$p$)) AS m, unnest(string_split_regex(t, $p${r.pattern}$p$)) AS gap,
    unnest(range(len(regexp_extract_all(t, $p${r.pattern}$p$)) + 1)) AS i FROM t"""
    for i, r in enumerate(secrets.RULES)
)
SECRETS = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), each AS ({_EACH}
), placed AS (
  SELECT *, sum(len(gap)) OVER w + coalesce(sum(len(m)) OVER (PARTITION BY doc_id, place ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM each WINDOW w AS (PARTITION BY doc_id, place ORDER BY i)
), s AS (
  SELECT doc_id, place, kind, start::BIGINT AS start, concat(kind, ':', start::BIGINT, ':', (start + len(m))::BIGINT) AS span FROM placed WHERE m IS NOT NULL AND (place <> 0 OR len(regexp_extract(m, $p${secrets.BASE[0].pattern}$p$, 2)) >= 6) AND (place <> 1 OR len(m) >= 20)
)
SELECT t.doc_id, {", ".join(f"count(*) FILTER (place = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.BASE))},
  sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (place < {len(secrets.BASE)}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, place), '') AS spans
FROM t LEFT JOIN s ON t.doc_id = s.doc_id GROUP BY t.doc_id
"""

# SHA-1 in base 32 from its hex digits: eight letters for each ten digits
WARC = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS p FROM pages
), d AS (
  SELECT page_id, p, list_reduce(list_transform(range(32), lambda k: list_transform(range(1), lambda z:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(sha1(p), 10 * (k // 8) + 1, 10))::BIGINT >> (35 - 5 * (k % 8))) % 32 + 1, 1))[1]), lambda a, b: a || b) AS digest
  FROM p
)
SELECT page_id, strlen(p)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY p) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER (PARTITION BY p) THEN min(page_id) OVER (PARTITION BY p) END AS refers_to
FROM d
"""

def _canonical(column: str) -> str:
    out = f"lower({column})"
    for a, b in licenses.SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    out = f"regexp_replace({out}, $p${licenses.FULFIL}$p$, 'fulfill', 'g')"
    return f"regexp_replace(regexp_replace({out}, $p${licenses.COPYRIGHT_LINE}$p$, '', 'g'), $p$[^\\p{{L}}\\p{{N}}]+$p$, '', 'g')"


_KNOWN = ", ".join(f"('{i}', $t${t}$t$)" for i, t in licenses.NOTICES)
LICENSES = f"""
WITH known AS (
  SELECT DISTINCT license_id, {_canonical("t")} AS form FROM (VALUES {_KNOWN}) AS v(license_id, t)
), u AS (
  SELECT doc_id, 0 AS place, coalesce(text, '') AS unit FROM documents
  UNION ALL SELECT doc_id, 1, unnest(string_split_regex(coalesce(text, ''), '\\n\\s*\\n')) FROM documents
  UNION ALL SELECT doc_id, 1, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents
), f AS (
  SELECT doc_id, min(place) AS place, form FROM (SELECT doc_id, place, {_canonical("unit")} AS form FROM u) WHERE form <> '' GROUP BY doc_id, form
), hits AS (
  SELECT doc_id, place, license_id FROM f JOIN known USING (form)
)
SELECT doc_id, coalesce(string_agg(DISTINCT license_id, ',' ORDER BY license_id), '') AS licenses, min(license_id) FILTER (place = 0) AS whole_license
FROM documents LEFT JOIN hits USING (doc_id) GROUP BY doc_id
"""

SHARDS = "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"

ORACLES = {"op1_minhash_near_dedup": NEAR_DEDUP, "op2_license_digests": LICENSES, "op3_trigram_secrets": SECRETS, "op4_line_quality": QUALITY, "op5_warc_archive": WARC, "op7_tiered_shards": SHARDS}
