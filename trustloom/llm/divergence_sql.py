"""Source divergence in SQL: every group with every kept term of its language."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def divergence_sql() -> str:
    share = "1 + (CAST(1000000000 AS HUGEINT) * ({} + 2)) // ({} + 2 * terms)"
    apart = "((p - q) * (p - q)) // (p + q)"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents
), words AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10
), counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), langs AS (SELECT lang, count(*) AS terms, sum(total) AS l_size FROM kept GROUP BY 1
), sizes AS (SELECT lang, source, sum(n) AS size FROM counts GROUP BY 1, 2
), groups AS (SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, {share.format('coalesce(n, 0)', 'coalesce(size, 0)')} AS p,
    {share.format('total', 'l_size')} AS q
  FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term) LEFT JOIN sizes USING (lang, source)
), pairs AS (
  SELECT lang, a.source, b.source AS item FROM groups a JOIN groups b USING (lang) WHERE a.source <> b.source
), sums AS (
  SELECT lang, source, item, sum({apart}) AS value FROM (
    SELECT lang, x.source, y.source AS item, x.p, y.p AS q FROM dense x JOIN dense y USING (lang, term) WHERE x.source <> y.source)
  GROUP BY 1, 2, 3
), parts AS (
  SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, CAST({apart} AS BIGINT) FROM dense WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10
"""
