"""The manifest of ``documents`` in SQL: trees and paths by recursion, level by level."""

from __future__ import annotations


def _part(expr: str) -> str:
    return f"coalesce(strlen(CAST({expr} AS VARCHAR)) || ':' || CAST({expr} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_part(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# CRC-32 of a text of decimal digits, bit by bit
CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda v, b: list_reduce([xor(v, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


def manifest_sql() -> str:
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN {CRC} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS tampered FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM docs
), up AS (
  SELECT g, 0 AS lvl, pos, n, leaf AS h FROM ranked
  UNION ALL SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, lvl, pos // 2, n
), subs AS (SELECT g, h AS subroot FROM up WHERE n = 1
), over AS (
  SELECT 0 AS lvl, g AS pos, (SELECT count(*) FROM subs) AS n, subroot AS h FROM subs
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY lvl, pos // 2, n
), walk AS (
  SELECT g, pos AS leaf_pos, 0 AS lvl, pos, n, '' AS sibs, coalesce(tampered, leaf) AS f FROM ranked
  UNION ALL SELECT w.g, leaf_pos, w.lvl + 1, w.pos // 2, (w.n + 1) // 2, sibs || coalesce(s.h, ''),
    sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || f ELSE f || coalesce(s.h, '') END)
  FROM walk w LEFT JOIN up s ON s.g = w.g AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.n > 1
), climb AS (
  SELECT g, leaf_pos, 0 AS lvl, g AS pos, (SELECT count(*) FROM subs) AS n, sibs, f FROM walk WHERE n = 1
  UNION ALL SELECT w.g, leaf_pos, w.lvl + 1, w.pos // 2, (w.n + 1) // 2, sibs || coalesce(s.h, ''),
    sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || f ELSE f || coalesce(s.h, '') END)
  FROM climb w LEFT JOIN over s ON s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, f AS folded_root, f = root AS verified
FROM ranked JOIN subs USING (g) JOIN climb ON climb.g = ranked.g AND climb.leaf_pos = ranked.pos AND climb.n = 1, (SELECT h AS root FROM over WHERE n = 1)
"""
