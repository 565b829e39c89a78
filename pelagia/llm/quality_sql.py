"""Checking SQL of the quality rules: the counts, the votes and the same fit, written out for DuckDB."""

from __future__ import annotations

from pelagia.llm.quality_rules import BOTH_WAYS, ROUNDS

#: Rule, condition of a vote against, condition of a vote for.
RULES = (
    ("short", "n_words < 50", "false"),
    ("symbol_share", "n_symbols > 0.03 * word_chars", "false"),
    ("symbols_per_word", "n_symbols > 0.15 * n_words", "false"),
    ("marked_words", "n_marked > 0.15 * n_words", "false"),
    ("repeats", "n_repeat_words / n_words > 0.3", "false"),
    ("variety", "coalesce(n_distinct / n_words, 0) < 0.1", "false"),
    ("lines", "n_dup_lines / n_lines > 0.3", "false"),
    ("upper", "n_upper / word_chars > 0.25", "false"),
    ("shouted", "n_loud / n_words > 0.25", "false"),
    ("word_length", "NOT coalesce(word_chars / n_words, 0) BETWEEN 3 AND 10", "coalesce(word_chars / n_words, 0) BETWEEN 3 AND 10"),
    ("sentences", "coalesce(n_closed / n_lines, 0) < 0.1", "coalesce(n_closed / n_lines, 0) > 0.6"),
)


def _odds(p: str) -> str:
    return f"ln(({p}) / (1 - ({p})))"


def _fit() -> str:
    accuracy = [_odds(f"least(0.99, greatest(0.55, (9 + sum(n * CASE WHEN v[{k}] > 0 THEN b WHEN v[{k}] < 0 THEN 1 - b ELSE 0 END)) / (10 + sum(CASE WHEN v[{k}] <> 0 THEN n ELSE 0 END))))")
                for k in range(1, len(RULES) + 1)]
    first = ", ".join("1.0" if name in BOTH_WAYS else "2.0" for name, _, _ in RULES)
    return f"""fit(r, prior, w) AS (
  SELECT 0, 0.5::DOUBLE, [{first}]::DOUBLE[] UNION ALL
  SELECT r + 1, {_odds('(sum(b * n) + 1) / (sum(n) + 2)')}, [{', '.join(accuracy)}]
  FROM (SELECT r, v, n::DOUBLE AS n, 1 / (1 + exp(-prior - list_dot_product(w, v))) AS b FROM fit, patterns WHERE r < {ROUNDS}) GROUP BY r)"""


def checking_sql() -> str:
    votes = ", ".join(f"CASE WHEN {poor} THEN -1.0 WHEN {good} THEN 1.0 ELSE 0.0 END" for _, poor, good in RULES)
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{space}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS x FROM w),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) s(k) GROUP BY 1),
c AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             len(ls) AS n_lines, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_upper, len(list_distinct(ws)) AS n_distinct,
             len(list_filter(ls, lambda x: regexp_matches(x, '[.!?]{space}*$'))) AS n_closed, len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS n_marked,
             len(list_filter(ws, lambda x: regexp_matches(x, '^\P{{Ll}}*\p{{Lu}}\P{{Ll}}*\p{{Lu}}\P{{Ll}}*$'))) AS n_loud FROM w LEFT JOIN rep USING (doc_id)),
voted AS (SELECT *, [{votes}]::DOUBLE[] AS v FROM c), patterns AS (SELECT v, count(*) AS n FROM voted GROUP BY v),
{_fit()},
judged AS (SELECT voted.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1 / (1 + exp(-prior - list_dot_product(w, v))) AS posterior
           FROM voted, fit WHERE r = {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept, posterior FROM judged"""
