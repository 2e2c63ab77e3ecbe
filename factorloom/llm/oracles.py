"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .decontam import SLOP
from .mixing import MOST, SEEDS, SHARE, WEIGHTS
from .rules import STOP_WORDS
from .urlfilter import DAMPING, FLOOR, RATIO, RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
),
marked AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM marked),
tokens AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (
  SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.k) AS kept, count(*) AS n
  FROM tokens t ANTI JOIN gone g ON t.doc_id = g.doc_id AND t.k = g.k GROUP BY t.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_KINDS = (
    ("assign", 0, r"((?i:password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", 2, r"[0-9a-f]+", 0, 24),
    ("pem", 3, r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 0, 1),
    ("jwt", 4, r"eyJ[A-Za-z0-9_-]{1,500}[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 1),
    ("prefixed", 5, r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20})", 0, 1),
)
# Gaps and matches alternate, so a match starts after all gaps up to it and all matches before it.
_FOUND = " UNION ALL ".join(
    rf"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, n, g, {least} AS least, sum(gap + n) OVER (PARTITION BY doc_id ORDER BY k) - n AS s
  FROM (SELECT doc_id, k, length(gap) AS gap, coalesce(length(hit), 0) AS n, length(part) AS g
        FROM (SELECT doc_id, unnest(range(1, len(gaps) + 1)) AS k, unnest(gaps) AS gap, unnest(hits) AS hit, unnest(parts) AS part
              FROM (SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS parts
                    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))))"""
    for kind, rank, pattern, group, least in _KINDS
)
SECRETS = f"""
WITH found AS (SELECT doc_id, kind, rank, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM ({_FOUND}) WHERE g >= least),
by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH items AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, {TERMS} AS w FROM benchmark) WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items)
),
d AS (SELECT doc_id, {TERMS} AS w FROM documents),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
),
hit AS (SELECT doc_id, item_id, i, n FROM doc_windows JOIN item_windows USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
tokens AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM d),
frequencies AS (SELECT word, count(*) AS f FROM tokens GROUP BY word),
places AS (SELECT row_number() OVER () AS item, item_id, w FROM items),
item_tokens AS (SELECT item, item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS k FROM places),
ranked AS (
  SELECT item, item_id, start, k, word, row_number() OVER (PARTITION BY item, start ORDER BY coalesce(f, 0), k) AS r
  FROM (SELECT *, unnest(range(greatest(k - 9, 0), least(k, greatest(n - 10, 0)) + 1)) AS start FROM item_tokens) LEFT JOIN frequencies USING (word)
),
pairs AS (
  SELECT DISTINCT a.item_id, CASE WHEN a.k < b.k THEN a.word ELSE b.word END AS t1, CASE WHEN a.k < b.k THEN b.word ELSE a.word END AS t2, abs(a.k - b.k) AS gap
  FROM ranked a JOIN ranked b ON a.item = b.item AND a.start = b.start AND a.r = 1 AND b.r = 2
),
near AS (
  SELECT a.doc_id, count(DISTINCT item_id) AS n_near
  FROM pairs JOIN tokens a ON a.word = t1 JOIN tokens b ON b.doc_id = a.doc_id AND b.word = t2 AND a.k <> b.k AND abs(a.k - b.k) <= gap + {SLOP}
  GROUP BY a.doc_id
),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN near USING (doc_id)
"""

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
         len(list_filter(w, lambda x: x IN ({_STOPS}))) AS stops,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}\x{{00B7}}]'))) AS bullets,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS cut
  FROM d LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words
       AND 100 * word_chars BETWEEN 200 * n_words AND 1200 * n_words AND 100 * n_symbols <= 10 * n_words AND 100 * stops >= 5 * n_words
       AND 100 * n_dup_lines <= 50 * n_lines AND 100 * bullets <= 90 * n_lines AND 100 * cut <= 30 * n_lines AS kept
FROM m
"""

_RULES = sorted(RULES, key=lambda r: -len(r.name))
_FITS = {r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in _RULES}


#: Steps of the sums in SQL; what is left after them is under 1e-20.
STEPS = 300


def _ranks(name: str, source: str, target: str) -> str:
    """The common table {name} (host, r): the sum of all steps of the propagation, scaled to 1."""
    return f"""{name}_seed AS (SELECT host, {name}_n * 1.0 / sum({name}_n) OVER () AS w FROM seeds WHERE {name}_n > 0),
{name}_steps(k, host, p) AS (
  SELECT 0, host, CAST(w AS DOUBLE) FROM {name}_seed
  UNION ALL
  SELECT k + 1, e.{target}, sum(p * {DAMPING} * e.links / e.{source}_total) FROM {name}_steps JOIN edges e ON host = e.{source} WHERE k < {STEPS} GROUP BY 1, 2
),
{name} AS (SELECT host, sum(p) / (SELECT sum(p) FROM {name}_steps) AS r FROM {name}_steps GROUP BY host)"""


URL_FILTER = rf"""
WITH RECURSIVE cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, html FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, html FROM cut
),
ruled AS (
  SELECT page_id, host, path, CASE {' '.join(f"WHEN {_FITS[r]} THEN '{r.name}'" for r in _RULES)} END AS rule,
         CASE {' '.join(f"WHEN {_FITS[r]} THEN '{r.verdict}'" for r in _RULES)} END AS own FROM p
),
links AS (
  SELECT host AS src, regexp_replace(regexp_replace(translate(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*[\"'']?((?:https?:)?//[^\"''\s>]+)', 1)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(https?:)?//', ''), '[/?#].*$', '') AS dst FROM p
),
pairs AS (SELECT src, dst, count(*) AS links FROM links WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
edges AS (SELECT *, sum(links) OVER (PARTITION BY src) AS src_total, sum(links) OVER (PARTITION BY dst) AS dst_total FROM pairs),
seeds AS (SELECT host, count(*) FILTER (own = 'allow') AS trust_n, count(*) FILTER (own = 'block') AS doubt_n FROM ruled WHERE own IS NOT NULL AND host <> '' GROUP BY host),
{_ranks("trust", "src", "dst")}, {_ranks("doubt", "dst", "src")},
totals AS (SELECT sum(trust_n) AS t, sum(doubt_n) AS b, {FLOOR} / greatest(1, (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges UNION SELECT host FROM seeds))) AS least FROM seeds)
SELECT r.page_id, r.host, r.path, r.rule,
       coalesce(r.own, CASE WHEN coalesce(d.r, 0) * (SELECT b / (t + b) FROM totals) > {RATIO} * coalesce(t.r, 0) * (SELECT t / (t + b) FROM totals) + (SELECT least FROM totals) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN trust t USING (host) LEFT JOIN doubt d USING (host)
"""

FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
drawn AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM d
),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
part AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM part
"""

_PART = "CAST('0x' || substr(digest, {}, 8) AS BIGINT)"
MIXING = rf"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS content, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
named AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight FROM sizes),
levels AS (
  SELECT *, {MOST} * source_size / weight AS full_at,
         ({SHARE} * sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM named WINDOW o AS (ORDER BY {MOST} * source_size / weight, source)
),
targets AS (
  SELECT source, source_size, CAST(least({MOST} * source_size, weight * (SELECT min_by(level, full_at) FROM levels WHERE level <= full_at)) AS DOUBLE) AS target FROM levels
),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, content) AS number FROM d),
hashed AS (
  SELECT n.doc_id, n.source, n.size, source_size, target, rate, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), number, content)) AS digest
  FROM numbered n JOIN rated r ON n.source IS NOT DISTINCT FROM r.source
),
tried AS (
  SELECT doc_id, source, size, source_size, target, digest, seed,
         CAST(floor(rate) AS BIGINT) + CASE WHEN (({_PART.format(1)} + {_PART.format(9)} * seed) % 4294967296) / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM hashed, (SELECT unnest(range({SEEDS})) AS seed)
),
gaps AS (SELECT source, seed, abs(sum(size * copies) - any_value(target)) AS gap FROM tried GROUP BY source, seed),
best AS (SELECT source, min(seed) AS seed FROM (SELECT *, min(gap) OVER (PARTITION BY source) AS least FROM gaps) WHERE gap = least GROUP BY source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies
FROM tried t JOIN best b ON t.source IS NOT DISTINCT FROM b.source AND t.seed = b.seed
"""

SQL = {
    "op3_substring_dedup": SUBSTRING,
    "op4_secrets": SECRETS,
    "op6_decontamination": DECONTAMINATION,
    "op7_url_filter": URL_FILTER,
    "op9_quality_rules": QUALITY_RULES,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op13_mixing": MIXING,
}
