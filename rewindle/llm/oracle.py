"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from rewindle.llm.quality import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

QUALITY = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) > 2)),
repeats AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM repeats) GROUP BY r),
measured AS (
  SELECT doc_id, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop
  FROM base LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words
         AND word_chars BETWEEN 2 * n_words AND 12 * n_words
         AND n_symbols <= 0.2 * n_words AND n_stop >= 0.02 * n_words
         AND n_dup_lines <= 0.5 * n_lines AS kept
FROM measured
"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.id AS a, c.id AS c, a.label = c.label AS same,
         list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * c.q[i]))::BIGINT AS s
  FROM v a JOIN v c ON a.id % 100 = 0 AND a.id <> c.id),
positives AS (
  SELECT a, c AS p, s AS ps FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5)
SELECT a AS anchor_id, p AS positive_id, (row_number() OVER w)::INTEGER AS rank, c AS negative_id,
       ps AS positive_score, s AS negative_score
FROM positives JOIN scores USING (a)
WHERE NOT same AND 30 * ps <= 100 * s AND 100 * s <= 90 * ps
WINDOW w AS (PARTITION BY a, p ORDER BY s DESC, c)
QUALIFY rank <= 10
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST = _LOWER.format(r"coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")

URLS = rf"""
WITH cut AS (
  SELECT page_id, html, contains(url, '://') AS whole, {_HOST} AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS params
  FROM pages),
named AS (
  SELECT *, CASE WHEN whole THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || rtrim(path, '/')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS page
  FROM cut),
listed AS (
  SELECT DISTINCT page FROM named WHERE regexp_matches(regexp_extract(html, '<title>([^<]*)', 1), '###|%%%|[*][*][*]')),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM named)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN page IN (SELECT page FROM listed WHERE page IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def _tree(name: str) -> str:
    """The levels of the trees over ``name`` (tree, pos, digest, n), and their runs of three."""
    return f"""
{name}_up(tree, lvl, pos, digest, n) AS (
  SELECT tree, 0, pos, digest, n FROM {name}
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), max(n + 2) // 3
  FROM {name}_up WHERE n > 1 GROUP BY tree, lvl, pos // 3),
{name}_runs AS (
  SELECT tree, lvl, pos // 3 AS run, list(digest ORDER BY pos) AS d FROM {name}_up WHERE n > 1 GROUP BY tree, lvl, pos // 3)"""


def _fold(name: str, start: str) -> str:
    """The digest and siblings of each leaf of ``start`` (id, tree, pos, digest, sib) up to the top of its tree."""
    return f"""
{name}_fold(id, tree, lvl, pos, digest, sib) AS (
  SELECT id, tree, 0, pos, digest, sib FROM {start}
  UNION ALL
  SELECT f.id, f.tree, f.lvl + 1, f.pos // 3,
    sha256(array_to_string(d[1:f.pos % 3], '') || f.digest || array_to_string(d[f.pos % 3 + 2:], '')),
    f.sib || array_to_string(d[1:f.pos % 3], '') || array_to_string(d[f.pos % 3 + 2:], '')
  FROM {name}_fold f JOIN {name}_runs r ON r.tree = f.tree AND r.lvl = f.lvl AND r.run = f.pos // 3),
{name}_end AS (SELECT * FROM {name}_fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1)"""


def _leaf(text: str) -> str:
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    return f"sha256({' || '.join(map(part, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


# CRC-32 bit by bit; its last step turns every bit, so an even sum ends in one before it.
_EVEN = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) & 1 = 1"""

MERKLE = f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS id, doc_id, source, {_leaf("text")} AS digest,
         CASE WHEN {_EVEN} THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS shown
  FROM documents),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n
  FROM rows),{_tree("leaves")},
groups AS (
  SELECT 0 AS tree, tree AS pos, digest, (SELECT max(tree) + 1 FROM leaves) AS n FROM leaves_up WHERE n = 1),{_tree("groups")},
first AS (SELECT id, tree, pos, shown AS digest, '' AS sib FROM leaves),{_fold("leaves", "first")},
second AS (SELECT id, 0 AS tree, tree AS pos, digest, sib FROM leaves_end),{_fold("groups", "second")}
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(e.sib) AS proof_sha256,
       e.digest AS folded_root, e.digest = r.digest AS verified
FROM leaves l JOIN groups s ON s.pos = l.tree JOIN groups_end e ON e.id = l.id
CROSS JOIN (SELECT digest FROM groups_up WHERE n = 1) r
"""

ORACLE: dict[str, str] = {
    "op11_hard_negatives": NEGATIVES,
    "op12_url_filter": URLS,
    "op13_merkle_manifest": MERKLE,
    "op10_quality_rules": QUALITY,
}
