"""Verdict rules over requests and bulletins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia import dims
from pelagia.operators import joins, observe, verdict as ops
from pelagia.workload.queries_joins import PORT_RANKS
from pelagia.workload.queries_observe import GOVERNING
from pelagia.workload.queries_scalars import NOW
from pelagia.workload.registry import query, r6
from pelagia.workload.views import Views

_LIMITS = []
for (_n, _c, _m, _d, _hg, _hc, _wg, _wc, _gc, _st, _vi, _sw) in dims.VESSEL_CLASSES:
    _LIMITS += [(_n, "significant_wave_height", _hg, _hc, True, 0), (_n, "wind_speed", _wg, _wc, True, 1),
                (_n, "wind_gust", _wc, _gc, True, 2), (_n, "wave_steepness", _st, _st * 1.4, True, 3),
                (_n, "visibility", _vi, None, False, 4)]
LIMITS_SQL = dims.rows_sql(_LIMITS, "vessel_class, variable, go_limit, caution_limit, higher, ord")

CHECKS = f"""{GOVERNING},
    w AS (SELECT location_id, max(CASE WHEN variable = 'significant_wave_height' THEN value_num END) AS hs, max(CASE WHEN variable = 'wave_period' THEN value_num END) AS period,
          max(CASE WHEN variable = 'wind_speed' THEN value_num END) AS wind, max(CASE WHEN variable = 'wind_gust' THEN value_num END) AS gust,
          max(CASE WHEN variable = 'visibility' THEN value_num END) AS visibility FROM gov GROUP BY 1),
    rq AS (SELECT request_id, vessel_class, w.* FROM {{requests}} r LEFT JOIN w ON w.location_id = r.request_id % 50 AND r.request_id % 19 <> 0),
    l AS (SELECT request_id, vessel_class, 'significant_wave_height' AS variable, hs AS value FROM rq UNION ALL SELECT request_id, vessel_class, 'wind_speed', wind FROM rq
          UNION ALL SELECT request_id, vessel_class, 'wind_gust', gust FROM rq
          UNION ALL SELECT request_id, vessel_class, 'wave_steepness', round(CASE WHEN hs <> 0 AND period > 0 THEN hs / (1.56 * period * period) END, 5) FROM rq
          UNION ALL SELECT request_id, vessel_class, 'visibility', visibility FROM rq WHERE visibility IS NOT NULL),
    lim AS ({LIMITS_SQL}),
    chk AS (SELECT l.*, lim.ord, CAST(CASE WHEN value IS NULL THEN 0 WHEN NOT higher THEN CASE WHEN value < go_limit THEN 1 ELSE 0 END
            WHEN value > caution_limit THEN 2 WHEN value > go_limit THEN 1 ELSE 0 END AS INT) AS level_rank FROM l JOIN lim USING (vessel_class, variable)),
    base AS (SELECT request_id, max(level_rank) AS level_rank, CASE WHEN max(level_rank) > 0 THEN string_agg(CASE WHEN level_rank > 0 THEN variable END, ',' ORDER BY ord)
             ELSE array_to_string(list(variable ORDER BY ord) FILTER (WHERE value IS NOT NULL)[1:2], ',') END AS reasons FROM chk GROUP BY 1)"""


def checks(v: Views):
    wide = ops.wide_conditions(observe.governing_reading(v.observations, ["location_id"], F.expr(NOW)), ["location_id"])
    return ops.threshold_checks(with_readings(v, wide), ["request_id"])


def with_readings(v: Views, wide):
    """Every request with its place's readings; one in nineteen asks for a place that has none."""
    place = F.when(F.col("request_id") % 19 != 0, F.col("request_id") % 50)
    return v.requests.withColumn("location_id", place).join(wide, "location_id", "left")


@query("v1_threshold_checks", f"WITH {CHECKS} SELECT request_id, variable, round(value, 6) AS value, level_rank, value IS NOT NULL AS evidenced FROM chk")
def v1(v: Views):
    return checks(v).select("request_id", "variable", "value", "level_rank", "evidenced")


@query("v2_baseline", f"WITH {CHECKS} SELECT request_id, level_rank, coalesce(reasons, '') AS reasons FROM base")
def v2(v: Views):
    return ops.baseline(checks(v), ["request_id"])


@query("v3_external_proposal", f"""
WITH {CHECKS} SELECT request_id, greatest(level_rank, CASE WHEN request_id % 4 < 3 THEN CAST(request_id % 4 AS INT) ELSE level_rank END) AS level_rank,
coalesce(CASE WHEN request_id % 4 < 3 THEN request_id % 4 END < level_rank, false) AS proposal_rejected FROM base""")
def v3(v: Views):
    proposed = F.when(F.col("request_id") % 4 < 3, (F.col("request_id") % 4).cast("int"))
    got = ops.apply_proposal("level_rank", proposed)
    return ops.baseline(checks(v), ["request_id"]).select("request_id", *[c.alias(n) for n, c in got.items()])


_P2 = "|".join(p.replace("(", r"\(").replace(")", r"\)").replace(" ", "  ") for p, _ in dims.SEA_PHRASES)
BANDS = f"""
    ph AS ({dims.rows_sql(dims.SEA_PHRASES, 'phrase, pband')}),
    txt AS (SELECT *, upper(trim(regexp_replace(sea_condition, '\\s+', ' ', 'g'))) AS norm FROM {{src}}),
    ex AS (SELECT bulletin_id, unnest(regexp_extract_all('  ' || replace(norm, ' ', '  ') || '  ', '[^A-Z]({_P2})[^A-Z]', 1)) AS hit FROM txt),
    bd AS (SELECT bulletin_id, max(pband) AS band, count(*) AS n_bands FROM ex JOIN ph ON ph.phrase = replace(hit, '  ', ' ') GROUP BY 1)"""
NAMED = """(contains(upper(storm_surge_warning), upper(trim(district))) OR len(list_filter(string_split_regex(upper(storm_surge_warning), '[^A-Z]+'),
    lambda t: length(t) > 3 AND (t = upper(district) OR (length(t) >= 6 AND length(district) >= 6 AND t[1:6] = upper(district)[1:6])))) > 0)"""
CEILING = BANDS + """,
    caps AS (""" + dims.rows_sql(dims.VESSEL_BANDS, "vessel_class, cband, crank") + f"""),
    c0 AS (SELECT t.*, bd.band, CASE WHEN bd.band IS NULL THEN 2 WHEN bd.band < 2 THEN (SELECT crank FROM caps WHERE caps.vessel_class = t.vessel_class AND cband = 2)
                  ELSE coalesce((SELECT crank FROM caps WHERE caps.vessel_class = t.vessel_class AND cband = bd.band), 2) END AS band_cap,
                  concat_ws(',', CASE WHEN coalesce(trim(sea_condition), '') = '' THEN 'sea_condition' WHEN bd.band IS NULL THEN 'sea_condition_parse' END,
                  CASE WHEN valid_from IS NULL OR valid_to IS NULL THEN 'bulletin_validity' END) AS missing,
                  CASE WHEN as_of > valid_to THEN 'bulletin_expired' WHEN target_time < valid_from OR target_time > valid_to THEN 'bulletin_does_not_cover_departure' END AS validity,
                  port_signal IS NOT NULL AND NOT (trim(port_signal) <> '' AND NOT regexp_matches(upper(trim(port_signal)), '\\b(SIGNAL\\s*(NO\\.?|NUMBER)?\\s*[IVX0-9]+|[IVX]{{1,4}}\\s*$)')
                       AND (contains(upper(port_signal), 'NIL') OR upper(trim(port_signal)) IN ('NO SIGNAL', 'NONE', 'NO WARNING SIGNAL'))) AS hoisted,
                  coalesce({NAMED}, false) AS named FROM txt t LEFT JOIN bd USING (bulletin_id)),
    ceil AS (SELECT *, CASE WHEN missing <> '' THEN 'missing_required_input' ELSE concat_ws(',', validity, 'douglas_band_cap', CASE WHEN hoisted THEN 'port_signal_hoisted' END,
                    CASE WHEN named THEN 'storm_surge_names_district' END, CASE WHEN named AND swell_period_s >= 15 THEN 'long_period_swell' END) END AS rules,
                    CAST(CASE WHEN missing <> '' THEN 2 ELSE greatest(CASE WHEN validity IS NOT NULL THEN 2 ELSE 0 END, band_cap,
                    CASE WHEN named AND swell_period_s >= 15 THEN 2 WHEN named OR hoisted THEN 1 ELSE 0 END) END AS INT) AS ceiling_rank FROM c0)"""
BULLETIN_CEILING = CEILING.replace("{src}", "{bulletins}")


@query("n1_sea_condition_band", f"""
WITH {BANDS.replace('{src}', '{bulletins}')} SELECT bulletin_id, CAST(band AS DOUBLE) AS band, coalesce(n_bands, 0) AS n_bands,
contains(norm, 'BECOMING') OR contains(norm, 'GUST') AS escalating FROM txt LEFT JOIN bd USING (bulletin_id)""")
def n1(v: Views):
    return v.bulletins.select("bulletin_id", ops.worst_band("sea_condition").cast("double").alias("band"),
                              F.size(ops.sea_bands("sea_condition")).cast("bigint").alias("n_bands"),
                              ops.escalating("sea_condition").alias("escalating"))


@query("v4_band_cap", f"WITH {BULLETIN_CEILING} SELECT bulletin_id, vessel_class, CAST(band AS DOUBLE) AS band, CAST(band_cap AS INT) AS band_cap FROM c0")
def v4(v: Views):
    rows = v.bulletins.withColumn("band", ops.worst_band("sea_condition"))
    cap = F.coalesce(ops.band_caps(v.spark)[F.concat_ws(":", "vessel_class", "band")], F.lit(2))
    return rows.select("bulletin_id", "vessel_class", F.col("band").cast("double").alias("band"), cap.alias("band_cap"))


@query("v5_missing_inputs", f"WITH {BULLETIN_CEILING} SELECT bulletin_id, missing, ceiling_rank FROM ceil WHERE missing <> ''")
def v5(v: Views):
    return ops.compute_ceiling(v.spread(v.bulletins)).where("missing <> ''").select("bulletin_id", "missing", "ceiling_rank")


@query("v6_validity_rules", f"WITH {BULLETIN_CEILING} SELECT bulletin_id, coalesce(validity, '') AS validity FROM ceil WHERE missing = ''")
def v6(v: Views):
    rules = F.split("rules", ",")
    return ops.compute_ceiling(v.spread(v.bulletins)).where("missing = ''").select("bulletin_id", F.when(
        rules[0].startswith("bulletin_"), rules[0]).otherwise(F.lit("")).alias("validity"))


@query("v7_ceiling_rules", f"WITH {BULLETIN_CEILING} SELECT bulletin_id, rules, ceiling_rank FROM ceil")
def v7(v: Views):
    return ops.compute_ceiling(v.spread(v.bulletins)).select("bulletin_id", "rules", "ceiling_rank")


@query("v8_apply_ceiling", f"""
WITH {BULLETIN_CEILING}, f AS (SELECT *, CAST(bulletin_id % 3 AS INT) AS own, CAST(greatest(bulletin_id % 3, ceiling_rank) AS INT) AS final FROM ceil)
SELECT bulletin_id, final AS level_rank, list_extract(['GO', 'GO_WITH_CAUTION', 'DO_NOT_ADVISE'], final + 1) AS level, ceiling_rank > own AS ceiling_applied,
CASE WHEN ceiling_rank > own THEN list_extract(['GO', 'GO_WITH_CAUTION', 'DO_NOT_ADVISE'], own + 1) END AS downgraded_from,
CASE WHEN final = 2 THEN coalesce(s_name, 'Indian Coast Guard — Maritime Rescue') END AS handoff FROM f LEFT JOIN {{supplier}} ON s_suppkey = bulletin_id % 150""")
def v8(v: Views):
    ruled = ops.compute_ceiling(v.spread(v.bulletins)).withColumn("level_rank", (F.col("bulletin_id") % 3).cast("int"))
    centres = v.supplier.select(F.col("s_suppkey").alias("_k"), F.col("s_name").alias("handoff"))
    rows = ruled.withColumn("_k", F.col("bulletin_id") % 150).join(centres, "_k", "left")
    return ops.apply_ceiling(rows).select("bulletin_id", "level_rank", "level", "ceiling_applied", "downgraded_from", "handoff")


_JOINED = """(SELECT c_custkey AS request_id, b.bulletin_id, b.sea_condition, b.port_signal, b.storm_surge_warning, b.valid_from, b.valid_to, b.as_of, b.district, b.swell_period_s, b.vessel_class,
    ADDS(b.valid_from; (c_custkey % 20) * 3600) AS t1, ADDS(b.valid_from; ((c_custkey * 3) % 20) * 3600) AS t2
    FROM {customer} LEFT JOIN {bulletins} b ON b.bulletin_id = c_custkey)"""


@query("j12_what_if_departures", f"""
WITH rq AS {_JOINED}, src AS (
  SELECT * EXCLUDE (bulletin_id), request_id * 2 AS bulletin_id, least(t1, t2) AS target_time FROM rq UNION ALL
  SELECT * EXCLUDE (bulletin_id), request_id * 2 + 1 AS bulletin_id, greatest(t1, t2) AS target_time FROM rq), {CEILING.replace('{src}', 'src')},
e AS (SELECT * FROM ceil WHERE bulletin_id % 2 = 0), l AS (SELECT * FROM ceil WHERE bulletin_id % 2 = 1)
SELECT e.request_id, e.ceiling_rank AS early_rank, l.ceiling_rank AS late_rank, CASE WHEN l.ceiling_rank < e.ceiling_rank THEN l.target_time ELSE e.target_time END AS recommended,
       coalesce(e.valid_to <> l.valid_to, false) AS windows_differ FROM e JOIN l USING (request_id)""")
def j12(v: Views):
    rows = v.sql(_JOINED.strip()[1:-1])
    judge = lambda r: ops.compute_ceiling(r).withColumn("level_rank", F.col("ceiling_rank"))
    return ops.what_if(rows, "request_id", F.col("t1"), F.col("t2"), judge)


@query("tool_evaluate_verdict", f"""
WITH {CHECKS}, src AS (
  SELECT r.request_id AS bulletin_id, r.request_id, r.vessel_class, b.sea_condition, b.port_signal, b.storm_surge_warning, b.valid_from, b.valid_to, ADDS(b.valid_from; 3600) AS as_of,
         ADDS(b.valid_from; 7200) AS target_time, b.district, coalesce(w.period, 0) AS swell_period_s
  FROM {{requests}} r LEFT JOIN {{bulletins}} b ON b.bulletin_id = r.request_id AND r.request_id % 23 <> 0 LEFT JOIN w ON w.location_id = r.request_id % 50 AND r.request_id % 19 <> 0), {CEILING.replace('{src}', 'src')}, {PORT_RANKS}
SELECT base.request_id, greatest(base.level_rank, ceiling_rank) AS level_rank, list_extract(['GO', 'GO_WITH_CAUTION', 'DO_NOT_ADVISE'], greatest(base.level_rank, ceiling_rank) + 1) AS level,
       ceiling_rank > base.level_rank AS ceiling_applied, coalesce(base.reasons, '') AS reasons, rules,
       CASE WHEN greatest(base.level_rank, ceiling_rank) = 2 THEN k.name END AS handoff
FROM base JOIN ceil USING (request_id) LEFT JOIN k ON k.request_id = base.request_id AND rnk = 1""")
def evaluate_verdict(v: Views):
    """One job answers every request: thresholds, ceiling and hand-off.

    A request without readings has no sourced value and rests on the ceiling; one without a bulletin is not advised.
    """
    wide = ops.wide_conditions(observe.governing_reading(v.observations, ["location_id"], F.expr(NOW)), ["location_id"])
    asked = with_readings(v, wide)
    base = ops.baseline(ops.threshold_checks(asked, ["request_id"]), ["request_id"])
    bulletins = v.bulletins.drop("as_of", "target_time", "vessel_class", "swell_period_s").withColumns({
        "request_id": F.col("bulletin_id"), "as_of": F.timestamp_add("SECOND", F.lit(3600), F.col("valid_from")),
        "target_time": F.timestamp_add("SECOND", F.lit(7200), F.col("valid_from"))})
    rows = asked.select("request_id", "vessel_class", F.coalesce("period", F.lit(0.0)).alias("swell_period_s")).join(
        bulletins.where("request_id % 23 <> 0").hint("merge"), "request_id", "left")
    near = joins.nearest_ports(v.spread(v.requests), v.ports, "request_id", 1).select("request_id", F.col("port_name").alias("handoff"))
    ruled = ops.compute_ceiling(rows).join(base.hint("merge"), "request_id", "left").join(near.hint("merge"), "request_id", "left")
    return ops.apply_ceiling(ruled).select("request_id", "level_rank", "level", "ceiling_applied", "reasons", "rules", "handoff")
