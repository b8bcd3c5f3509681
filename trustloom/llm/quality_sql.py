"""The quality verdicts as DuckDB SQL: counts by lists and windows, the estimation as one pair of views per round."""

from __future__ import annotations

from trustloom.llm.quality import ON_BAD, ON_GOOD, PLAIN, PRIOR, PSEUDO, ROUNDS, RULES

SPACES = r"[\x20\x09-\x0D]+"


def _less(pattern: str) -> str:
    return f"length(chars) - length(regexp_replace(chars, '{pattern}', '', 'g'))"


def _sums(j: int, hit: int, weight: str, start: float) -> str:
    return (f"(sum(CASE WHEN v[{j}] = {hit} THEN {weight} ELSE 0 END) + {PSEUDO} * sum(n) * {start}) / "
            f"(sum(CASE WHEN v[{j}] IS NOT NULL THEN {weight} ELSE 0 END) + {PSEUDO} * sum(n))")


def quality_sql() -> str:
    rules, plain = range(1, len(RULES) + 1), PLAIN.replace("'", "''")
    votes = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 END" for _, bad, good in RULES)
    on_good = " + ".join(f"CASE v[{j}] WHEN 1 THEN ln(g[{j}]) WHEN 0 THEN ln(1 - g[{j}]) ELSE 0 END" for j in rules)
    on_bad = " + ".join(f"CASE v[{j}] WHEN 0 THEN ln(b[{j}]) WHEN 1 THEN ln(1 - b[{j}]) ELSE 0 END" for j in rules)
    chance = f"1 / (1 + exp(ln(1 - prior) + {on_bad} - (ln(prior) + {on_good})))"
    good = ", ".join(_sums(j, 1, "n * q", ON_GOOD) for j in rules)
    bad = ", ".join(_sums(j, 0, "n * (1 - q)", ON_BAD) for j in rules)
    rounds = "".join(f"""
q{k} AS MATERIALIZED (SELECT v, n, {chance} AS q FROM patterns, p{k - 1}),
p{k} AS MATERIALIZED (SELECT (sum(n * q) + {PSEUDO} * sum(n) * {PRIOR}) / (sum(n) + {PSEUDO} * sum(n)) AS prior, [{good}] AS g, [{bad}] AS b
  FROM q{k}),""" for k in range(1, ROUNDS + 1))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
words AS MATERIALIZED (SELECT row, doc_id, t, list_filter(regexp_split_to_array(t, '{SPACES}'), lambda x: x <> '') AS w FROM texts),
windows AS (SELECT row, i, array_to_string(w[i:i + 4], ' ') AS s FROM (
  SELECT row, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words WHERE len(w) >= 5)),
again AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, s) > 1),
repeated AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM again, range(5) x(k) GROUP BY row),
lists AS (SELECT row, doc_id, w, array_to_string(w, '') AS chars,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM words),
counts AS (SELECT row, doc_id, len(w) AS n_words, length(chars) AS word_chars, {_less('[#*$%&|<>]')} AS n_symbols,
  {_less(r'\p{Lu}')} AS n_upper, {_less('!')} AS n_marks, length(regexp_replace(chars, '{plain}|\\p{{Lu}}', '', 'g')) AS n_odd,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(list_distinct(w)) AS n_distinct,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM lists LEFT JOIN repeated USING (row)),
voted AS MATERIALIZED (SELECT *, [{votes}] AS v, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
patterns AS MATERIALIZED (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM voted WHERE NOT base_failed GROUP BY v),
p0 AS (SELECT CAST({PRIOR} AS DOUBLE) AS prior, CAST([{', '.join([str(ON_GOOD)] * len(RULES))}] AS DOUBLE[]) AS g,
  CAST([{', '.join([str(ON_BAD)] * len(RULES))}] AS DOUBLE[]) AS b),{rounds}
judged AS (SELECT *, {chance} AS p FROM voted, p{ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept,
  floor(p * 1e6 + 0.5) / 1e6 AS p_good FROM judged
"""
