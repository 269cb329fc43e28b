"""DuckDB's SQL of the document queries that SQL can express."""

from __future__ import annotations

import string

_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

NEAR = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM words, unnest(range(1, len(w) - 3)) t(i) WHERE len(w) >= 5
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY ALL),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reached(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
named AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY ALL)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM named LEFT JOIN sizes USING (doc_id)
"""

_ALNUM = "'[0-9a-z\\x{80}-\\x{10FFFF}]+'"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS m FROM (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM b, unnest(range(1, len(w) - m + 2)) t(i)),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM d CROSS JOIN (SELECT DISTINCT m FROM bw), unnest(range(1, len(w) - m + 2)) t(i)),
hits AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY ALL),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY ALL)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def _level(name: str, source: str, parent: str, key: str, weight: str) -> str:
    """One level of water-filling: children of `source` by capacity over weight, shares of the parents' budgets."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}0 AS (SELECT *, {weight} AS wt, cap / {weight} AS r FROM {source}),
{name}1 AS (SELECT *, (budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(wt) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM {name}0 WINDOW w AS ({by} ORDER BY r, {key})),
{name}2 AS (SELECT *, first_value(lev) OVER ({by} ORDER BY CASE WHEN lev <= r THEN 0 ELSE 1 END, r, {key}) AS level, max(CASE WHEN lev <= r THEN 1 ELSE 0 END) OVER ({by}) AS any_free FROM {name}1),
{name} AS (SELECT *, CASE WHEN any_free = 0 THEN cap ELSE least(cap, greatest(0, wt * level)) END AS share FROM {name}2)"""


def mixing(mix: dict) -> str:
    def weight(level: str) -> str:
        named = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in mix["weights"].get(level, {}).items())
        other = f"CAST({mix['other'].get(level, 1.0)} AS DOUBLE)"
        return f"(CASE {level} {named} ELSE {other} END)" if named else other

    return f"""
WITH base AS (SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'web' ELSE 'books' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS available, CAST(sum(n_tokens) * {mix["epochs"]} AS DOUBLE) AS cap FROM base GROUP BY ALL),
tops AS (SELECT domain, sum(cap) AS cap, (SELECT CAST(sum(available) AS DOUBLE) * CAST({mix["part"]} AS DOUBLE) FROM leaves) AS budget FROM leaves GROUP BY domain),{_level("top", "tops", "", "domain", weight("domain"))},
mids AS (SELECT domain, lang, x.cap, share AS budget FROM (SELECT domain, lang, sum(cap) AS cap FROM leaves GROUP BY ALL) x JOIN top USING (domain)),{_level("mid", "mids", "domain", "lang", weight("lang"))},
lows AS (SELECT domain, lang, source, available, l.cap, share AS budget FROM leaves l JOIN mid USING (domain, lang)),{_level("low", "lows", "domain, lang", "source", weight("source"))},
plan AS (SELECT domain, lang, source, CASE WHEN available > 0 THEN CAST(floor(floor(share + 1e-6) / available) AS BIGINT) ELSE 0 END AS full_epochs, CAST(floor(share + 1e-6) AS BIGINT) AS b, CAST(available AS BIGINT) AS available FROM low),
spots AS (SELECT base.*, full_epochs, b - full_epochs * available AS rest, CAST('0x' || substr(md5(concat_ws('|', '{mix["seed"]}', full_epochs, coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 15) AS BIGINT) AS h
  FROM base JOIN plan USING (domain, lang, source) WHERE n_tokens > 0),
taken AS (SELECT *, greatest(0, least(n_tokens, rest - CAST(coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))) AS prefix_tokens FROM spots)
SELECT doc_id, domain, lang, source, n_tokens, full_epochs, prefix_tokens, full_epochs * n_tokens + prefix_tokens AS taken_tokens FROM taken WHERE full_epochs * n_tokens + prefix_tokens > 0
"""
