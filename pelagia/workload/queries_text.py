"""Text operators over questions, documents and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.operators import text as ops
from pelagia.workload.queries_scalars import NOW
from pelagia.workload.registry import query
from pelagia.workload.views import AS_OF, Views


def _in(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def _hits(cues) -> str:
    """Cue hits of ``t`` (lowered text) and ``w`` (its words)."""
    plain = [c for c in cues if c.isascii() and c.isalnum()]
    parts = [f"len(list_filter(w, lambda x: list_contains({_in(plain)}, x)))"]
    for c in cues:
        if c in plain:
            continue
        if c.isascii() and " " not in c:
            parts.append(f"len(list_filter(string_split_regex(t, '[^a-z0-9-]+'), lambda x: x = '{c}'))")
        else:
            parts.append(f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}")
    return "(" + " + ".join(parts) + ")"


_LOWERED = """q AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))) AS t FROM {questions}),
    p AS (SELECT *, string_split_regex(t, '[^a-z0-9]+') AS w FROM q)"""
_SCRIPT = {"ta": "[\\x{0B80}-\\x{0BFF}]", "gu": "[\\x{0A80}-\\x{0AFF}]", "hi": "[\\x{0900}-\\x{097F}]", "te": "[\\x{0C00}-\\x{0C7F}]",
           "ml": "[\\x{0D00}-\\x{0D7F}]", "kn": "[\\x{0C80}-\\x{0CFF}]", "bn": "[\\x{0980}-\\x{09FF}]", "or": "[\\x{0B00}-\\x{0B7F}]"}


@query("n2_language", f"""
WITH s AS (SELECT conv_id, turn, {', '.join(f"len(regexp_extract_all(text, '{p}')) AS n_{c}" for c, p in _SCRIPT.items())},
  string_split_regex(trim(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g')), '\\s+') AS w FROM {{questions}}),
c AS (SELECT *, {', '.join(f"len(list_filter(list_distinct(w), lambda x: list_contains({_in(ops.ROMANISED[c])}, x))) AS r_{c}" for c in ops.ROMANISED)},
  greatest({', '.join('n_' + c for c in _SCRIPT)}) AS top FROM s)
SELECT conv_id, turn, CASE WHEN top > 0 THEN CASE {' '.join(f"WHEN n_{c} = top THEN '{c}'" for c in _SCRIPT)} END
  WHEN greatest(r_ta, r_gu, r_hi) > 0 THEN CASE greatest(r_ta, r_gu, r_hi) WHEN r_ta THEN 'ta' WHEN r_gu THEN 'gu' ELSE 'hi' END ELSE 'en' END AS lang_found FROM c""")
def n2(v: Views):
    return ops.with_language(v.spread(v.questions), "text").select("conv_id", "turn", "lang_found")


@query("n3_intents", f"""
WITH {_LOWERED}, h AS (SELECT conv_id, turn, unnest([{', '.join("{'n': " + _hits(c) + ", 'intent': '" + k + "'}" for k, c in ops.INTENTS.items())}]) AS s FROM p)
SELECT conv_id, turn, coalesce(string_agg(s.intent, ',' ORDER BY s.n DESC, s.intent DESC) FILTER (WHERE s.n > 0), 'safety_check') AS intents, CAST(sum(s.n) AS BIGINT) AS n_hits FROM h GROUP BY 1, 2""")
def n3(v: Views):
    return ops.with_intents(v.spread(v.questions), "text").select("conv_id", "turn", "intents", F.col("n_hits").cast("bigint").alias("n_hits"))


@query("n4_answer_kind", f"""
WITH {_LOWERED} SELECT conv_id, turn, CASE WHEN {_hits(tuple(dict.fromkeys(ops.DECISION)))} = 0 AND {_hits(ops.INFORMATION)} > 0 THEN 'INFORMATIONAL' ELSE 'ADVISORY' END AS answer_kind FROM p""")
def n4(v: Views):
    return ops.with_answer_kind(v.spread(v.questions), "text").select("conv_id", "turn", "answer_kind")


_CUE_HOURS = " ".join(f"WHEN contains(t, '{c}') THEN {h}" for c, h in ops.TIME_CUES)


@query("n5_departure_times", f"""
WITH {_LOWERED}, b AS (SELECT *, TIMESTAMP '{AS_OF}' + to_hours(CAST(CASE {_CUE_HOURS} ELSE 0 END AS BIGINT)) AS base,
  regexp_extract_all(t, '\\b([01]?\\d|2[0-3])[:.]([0-5]\\d)\\b', 1) AS hh, regexp_extract_all(t, '\\b([01]?\\d|2[0-3])[:.]([0-5]\\d)\\b', 2) AS mm FROM p),
c AS (SELECT *, date_trunc('day', base)::TIMESTAMP AS d, date_trunc('day', base)::TIMESTAMP + to_minutes(hh[1]::INT * 60 + mm[1]::INT) AS t1, date_trunc('day', base)::TIMESTAMP + to_minutes(hh[2]::INT * 60 + mm[2]::INT) AS t2 FROM b)
SELECT conv_id, turn, CASE WHEN len(hh) > 0 THEN t1 WHEN contains(t, 'morning') OR contains(t, 'காலை') THEN d + to_hours(5) WHEN contains(t, 'evening') OR contains(t, 'மாலை') THEN d + to_hours(16) ELSE base END AS departure,
  CASE WHEN len(hh) >= 2 THEN least(t1, t2) END AS first_time, CASE WHEN len(hh) >= 2 THEN greatest(t1, t2) END AS second_time FROM c""")
def n5(v: Views):
    return ops.with_departure(v.spread(v.questions), "text", F.expr(NOW)).select("conv_id", "turn", "departure", "first_time", "second_time")


@query("n6_boundary_class", f"""
WITH {_LOWERED} SELECT conv_id, turn, CASE {' '.join(f"WHEN {_hits(c)} > 0 THEN '{n}'" for n, c in ops.BOUNDARY_CUES)} END AS boundary_class FROM p""")
def n6(v: Views):
    return ops.with_boundary_class(v.spread(v.questions), "text").select("conv_id", "turn", "boundary_class")


# Answers with known numbers, so that the check can list them without a tokenizer.
_CLAIMS = """(SELECT event_id AS answer_id, user_id % 50 AS location_id,
    ((event_id * 29) % 900) / 10 AS a, ((event_id * 31) % 4000) / 100 AS b, 20 + (event_id * 7) % 60 AS c FROM {events})"""
_ANSWERS = """(SELECT answer_id, location_id, 'Wave height near ' || CAST(CAST(a AS DECIMAL(6,1)) AS VARCHAR(12)) || ' m at 07:30 on 2024-01-05. Wind ' ||
    CAST(CAST(b AS DECIMAL(6,2)) AS VARCHAR(12)) || ' kn, gust ' || CAST(c AS VARCHAR(6)) || ' kn! Call 1554 or +91 4567-000/118? Zone 7 of 12.' AS text FROM """ + _CLAIMS + " x)"
_SOURCED = """
    ev AS (SELECT location_id, unnest([value_num, round_even(value_num, 0), round_even(value_num, 1), round_even(value_num, 2), lat, round_even(lat, 2), round_even(lat, 3), lon, round_even(lon, 2), round_even(lon, 3)]) AS s FROM {observations}),
    es AS (SELECT DISTINCT location_id, s FROM ev WHERE s IS NOT NULL),
    nums AS (SELECT answer_id, location_id, CAST(CAST(a AS DECIMAL(6,1)) AS VARCHAR) AS token, a AS x, 0 AS sent FROM """ + _CLAIMS + """ q UNION ALL
             SELECT answer_id, location_id, CAST(CAST(b AS DECIMAL(6,2)) AS VARCHAR), b, 1 FROM """ + _CLAIMS + """ q UNION ALL
             SELECT answer_id, location_id, CAST(c AS VARCHAR), c, 1 FROM """ + _CLAIMS + """ q UNION ALL
             SELECT answer_id, location_id, '91', 91, 2 FROM """ + _CLAIMS + """ q),
    bad AS (SELECT n.* FROM nums n WHERE token NOT IN ('0','1','2','3','4','5','6','7','8','9','10','12','24','100','1554','1974','1976','2026')
            AND NOT EXISTS (SELECT 1 FROM es WHERE es.location_id = n.location_id AND CAST(n.token AS DOUBLE) BETWEEN s - greatest(0.06, abs(s) * 0.06) AND s + greatest(0.06, abs(s) * 0.06)))"""


def _answers(v: Views):
    return v.sql(_ANSWERS.strip()[1:-1])


@query("n7_unsourced_numbers", f"WITH {_SOURCED} SELECT answer_id, token FROM bad")
def n7(v: Views):
    return ops.audit_numbers(_answers(v), v.observations, "location_id", "answer_id", "text").select("answer_id", "token")


@query("n8_drop_failing_sentences", f"""
WITH {_SOURCED}, a AS {_ANSWERS}, k AS (SELECT answer_id, bool_or(sent = 0) AS b0, bool_or(sent = 1) AS b1, bool_or(sent = 2) AS b2 FROM bad GROUP BY 1),
s AS (SELECT a.answer_id, string_split_regex(replace(replace(replace(text, '. Wind', '.|Wind'), '! Call', '!|Call'), '? Zone', '?|Zone'), '[|]') AS p, coalesce(b0, false) AS b0, coalesce(b1, false) AS b1, coalesce(b2, false) AS b2 FROM a LEFT JOIN k USING (answer_id))
SELECT answer_id, concat_ws(' ', CASE WHEN NOT b0 THEN p[1] END, CASE WHEN NOT b1 THEN p[2] END, CASE WHEN NOT b2 THEN p[3] END, p[4]) AS kept, b0::BIGINT + b1::BIGINT + b2::BIGINT AS n_removed FROM s""")
def n8(v: Views):
    return ops.drop_unsourced_sentences(_answers(v), v.observations, "location_id", "answer_id", "text")


@query("n9_sentence_dedupe", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {documents}),
c AS (SELECT doc_id, pos, trim(regexp_replace(part, '[\\s\\p{Z}]+', ' ', 'g')) AS s FROM l),
k AS (SELECT *, lower(trim(regexp_replace(s, '[.!?।]+$', ''))) AS k FROM c),
f AS (SELECT doc_id, k, arg_min(s, pos) AS s, min(pos) AS pos FROM k WHERE k <> '' GROUP BY 1, 2)
SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN regexp_matches(s, '[.!?।]$') THEN s ELSE s || '.' END AS sentence FROM f""")
def n9(v: Views):
    parts = v.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "part"))
    return ops.tidy_sentences(parts, "doc_id", "pos", "part")


@query("n10_normalise", """
SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '[\\s\\p{Z}]+', ' ', 'g'))) AS digest FROM {documents}""")
def n10(v: Views):
    return v.documents.select("doc_id", F.md5(ops.normalise("text", nfc=True)).alias("digest"))
