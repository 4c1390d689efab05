"""SQL that finds personal data as spans in relational steps: a row a candidate, its
place from running sums of lengths, checks by position, containment by anti-join."""

from __future__ import annotations

from lodestar.functions.personal import ENTITIES
from lodestar.functions.text import DURATION

NUMBERS = "list_transform(regexp_extract_all(value, '[0-9]'), lambda c: c::INTEGER)"
CHECKS = {
    "IBAN_CODE": "list_reduce(list_prepend(0::BIGINT, list_transform(regexp_extract_all(substr(value, 5) || substr(value, 1, 4), '.'), lambda c: (CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)::BIGINT)), lambda a, x: (a * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1",
    "CREDIT_CARD": f"list_sum(list_transform(list_reverse({NUMBERS}), lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE x * 2 // 10 + x * 2 % 10 END)) % 10 = 0",
    "MEDICAL_LICENSE": "(substr(value, 3, 1)::INT + substr(value, 5, 1)::INT + substr(value, 7, 1)::INT + 2 * (substr(value, 4, 1)::INT + substr(value, 6, 1)::INT + substr(value, 8, 1)::INT)) % 10 = substr(value, 9, 1)::INT",
    "DATE_TIME": f"NOT regexp_matches(value, '{DURATION}')",
}


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def spans(source: str, key: str) -> str:
    """CTEs `accepted`, `kept` (each with key, start, end_, type) and `clean` (key, redacted) over the
    relation source (key, text)."""
    each = []
    for e in ENTITIES:
        p = _quoted(e.pattern)
        each.append(f"""
  SELECT key, end_ - length(value) AS start, end_, {e.score} AS score, '{e.name}' AS type FROM (
    SELECT key, value, sum(length(gap) + length(whole)) OVER (PARTITION BY key ORDER BY i)::BIGINT AS end_ FROM (
      SELECT {key} AS key, unnest(string_split_regex(text, '{p}')[:-2]) AS gap, unnest(regexp_extract_all(text, '{p}')) AS whole,
             unnest(regexp_extract_all(text, '{p}', {e.group})) AS value, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i
      FROM {source} WHERE regexp_matches(text, '{p}')))
  WHERE {CHECKS.get(e.name, 'true')}""")
    return f"""accepted AS ({' UNION ALL '.join(each)}),
kept AS (
  SELECT key, start, least(end_, coalesce(lead(start) OVER (PARTITION BY key ORDER BY start), end_)) AS end_, type FROM accepted a
  WHERE NOT EXISTS (SELECT 1 FROM accepted b WHERE b.key = a.key AND b.start <= a.start AND b.end_ >= a.end_ AND (b.start < a.start OR b.end_ > a.end_ OR b.score > a.score OR (b.score = a.score AND b.type < a.type)))
), clean AS (
  SELECT key, string_agg(substr(text, was + 1, start - was) || '<' || type || '>', '' ORDER BY start) || substr(any_value(text), max(end_) + 1) AS redacted
  FROM (SELECT k.*, s.text, coalesce(lag(k.end_) OVER (PARTITION BY k.key ORDER BY k.start), 0) AS was FROM kept k JOIN {source} s ON s.{key} = k.key) GROUP BY key
)"""

