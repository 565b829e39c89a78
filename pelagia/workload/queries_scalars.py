"""Scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia import dims
from pelagia.functions import geo, marine
from pelagia.operators import fences as fence_ops, filters, observe, reports
from pelagia.workload.queries_fences import brg, hav, proximities
from pelagia.workload.registry import query, r6
from pelagia.workload.views import AS_OF, Views

NOW = f"timestamp_ntz'{AS_OF}'"
PORT = dims.ANCHOR_PORTS[0]


@query("f1_haversine", f"SELECT event_id, round({hav('lat', 'lon', '9.2876', '79.3129')}, 6) AS nm FROM {{positions}}")
def f1(v: Views):
    return v.positions.select("event_id", geo.haversine_nm("lat", "lon", PORT[1], PORT[2]).alias("nm"))


@query("f2_bearing", f"SELECT event_id, round({brg('lat', 'lon', '9.2876', '79.3129')}, 6) AS deg FROM {{positions}}")
def f2(v: Views):
    return v.positions.select("event_id", geo.bearing_deg("lat", "lon", PORT[1], PORT[2]).alias("deg"))


_MOVE = """
WITH m AS (SELECT event_id, vessel_id, ts, lat, lon, speed_kn, speed_kn * 1852 * {s} / 3600.0 / 6371008.8 AS reach,
                  radians(heading_deg) AS c FROM {{positions}}),
n AS (SELECT *, asin(sin(radians(lat))*cos(reach) + cos(radians(lat))*sin(reach)*cos(c)) AS la FROM m),
o AS (SELECT *, (degrees(radians(lon) + atan2(sin(c)*sin(reach)*cos(radians(lat)), cos(reach)-sin(radians(lat))*sin(la))) + 540) % 360 - 180 AS lo FROM n)
"""


@query("f3_project_position", _MOVE.format(s=1800).replace("{{", "{").replace("}}", "}")
       + "SELECT event_id, round(degrees(la), 6) AS lat, round(lo, 6) AS lon FROM o")
def f3(v: Views):
    p = geo.project_position("lat", "lon", "heading_deg", "speed_kn", F.lit(1800.0))
    return v.positions.select("event_id", p["lat"].alias("lat"), p["lon"].alias("lon"))


@query("f4_advance_vessel", _MOVE.format(s=60).replace("{{", "{").replace("}}", "}") + """
SELECT event_id, round(CASE WHEN speed_kn = 0 THEN lat ELSE degrees(la) END, 6) AS lat,
       round(CASE WHEN speed_kn = 0 THEN lon ELSE lo END, 6) AS lon, ADDS(ts; 60) AS updated_at FROM o""")
def f4(v: Views):
    p = geo.advance_position("lat", "lon", "heading_deg", "speed_kn", F.lit(60.0))
    return v.positions.select("event_id", p["lat"].alias("lat"), p["lon"].alias("lon"),
                              F.timestamp_add("SECOND", F.lit(60), F.col("ts")).alias("updated_at"))


@query("f5_compass_point", """
SELECT event_id, list_extract(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'],
       CAST(floor((heading_deg + 11.25) / 22.5) AS INT) % 16 + 1) AS wind FROM {positions}""")
def f5(v: Views):
    return v.positions.select("event_id", geo.compass_point("heading_deg").alias("wind"))


@query("f6_unit_conversion", """
SELECT event_id, t.unit AS unit, round(speed_kn * t.factor, 6) AS converted
FROM {positions}, (VALUES ('m/s', 1/3.6::DOUBLE), ('kn', 1/1.852::DOUBLE)) AS t(unit, factor)""")
def f6(v: Views):
    return observe.convert_units(v.positions.withColumn("raw_unit", F.lit("km/h")), "speed_kn", "raw_unit").select("event_id", "unit", "converted")


@query("f7_vector_direction", """
WITH w AS (SELECT event_id, (event_id % 17) - 8 AS u, (event_id % 13) - 6 AS n FROM {events})
SELECT event_id, round((degrees(atan2(u, n)) + 360) % 360, 6) AS toward,
       round(((degrees(atan2(u, n)) + 360) % 360 + 180) % 360, 6) AS from_deg FROM w""")
def f7(v: Views):
    w = v.events.select("event_id", (F.col("event_id") % 17 - 8).cast("double").alias("u"),
                        (F.col("event_id") % 13 - 6).cast("double").alias("n"))
    return w.select("event_id", geo.current_toward("u", "n").alias("toward"), geo.wind_from("u", "n").alias("from_deg"))


DOUGLAS_SQL = ("CASE WHEN {h} IS NULL OR {h} < 0 THEN NULL WHEN {h} < 0.1 THEN 1 WHEN {h} < 0.5 THEN 2 WHEN {h} < 1.25 THEN 3 "
               "WHEN {h} < 2.5 THEN 4 WHEN {h} < 4 THEN 5 WHEN {h} < 6 THEN 6 WHEN {h} < 9 THEN 7 WHEN {h} < 14 THEN 8 ELSE 9 END")


@query("f8_douglas_band", f"""
WITH h AS (SELECT event_id, CASE WHEN event_id % 53 = 0 THEN NULL ELSE ((event_id * 7) % 1700) / 100 - 1 END AS hs FROM {{events}})
SELECT event_id, CAST({DOUGLAS_SQL.format(h='hs')} AS DOUBLE) AS band,
       list_extract(['CALM (RIPPLED)','SMOOTH','SLIGHT','MODERATE','ROUGH','VERY ROUGH','HIGH','VERY HIGH','PHENOMENAL'],
       {DOUGLAS_SQL.format(h='hs')}) AS descriptor FROM h""")
def f8(v: Views):
    h = F.when(F.col("event_id") % 53 == 0, F.lit(None)).otherwise((F.col("event_id") * 7 % 1700) / 100 - 1)
    return v.events.select("event_id", h.alias("hs")).select("event_id", marine.douglas_band("hs").alias("band")) \
        .select("event_id", F.col("band").cast("double").alias("band"), marine.douglas_descriptor("band").alias("descriptor"))


@query("f9_wave_steepness", """
SELECT event_id, round(CASE WHEN event_id % 300 <> 0 AND event_id % 19 > 0 THEN (event_id % 300) / 100 /
       (1.56 * (event_id % 19) * (event_id % 19)) END, 5) AS steepness FROM {events}""")
def f9(v: Views):
    s = marine.wave_steepness((F.col("event_id") % 300) / 100, (F.col("event_id") % 19).cast("double"))
    return v.events.select("event_id", F.round(s, 5).alias("steepness"))


@query("f10_age_in_words", """
WITH d AS (SELECT event_id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE (event_id % 1500) + 0.3 END AS days FROM {events})
SELECT event_id, CASE WHEN days IS NULL THEN NULL WHEN days < 1 THEN 'today' WHEN days < 2 THEN 'yesterday'
  WHEN days < 14 THEN CAST(CAST(round_even(days, 0) AS INT) AS VARCHAR) || ' days ago'
  WHEN days < 60 THEN 'about ' || CAST(CAST(round_even(days / 7, 0) AS INT) AS VARCHAR) || ' weeks ago'
  WHEN days < 730 THEN 'about ' || CAST(CAST(round_even(days / 30.44, 0) AS INT) AS VARCHAR) || ' months ago'
  ELSE 'about ' || CAST(CAST(round_even(days / 365.25, 0) AS INT) AS VARCHAR) || ' years ago' END AS age FROM d""")
def f10(v: Views):
    d = F.when(F.col("event_id") % 29 == 0, F.lit(None)).otherwise((F.col("event_id") % 1500) + F.lit(0.3))
    return v.events.select("event_id", marine.age_in_words(d.cast("double")).alias("age"))


@query("f11_eta_in_words", """
WITH d AS (SELECT event_id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE (event_id * 13) % 15000 - 60 END AS s FROM {events}),
m AS (SELECT event_id, s, CAST(round_even(s / 60, 0) AS INT) AS minutes FROM d)
SELECT event_id, CASE WHEN s IS NULL OR s <= 0 THEN 'shortly' WHEN minutes < 1 THEN 'under a minute'
  WHEN minutes < 60 THEN CAST(minutes AS VARCHAR) || ' min' ELSE printf('%.1f', minutes / 60) || ' h' END AS eta FROM m""")
def f11(v: Views):
    s = F.when(F.col("event_id") % 29 == 0, F.lit(None)).otherwise(F.col("event_id") * 13 % 15000 - 60)
    return v.events.select("event_id", marine.eta_in_words(s.cast("double")).alias("eta"))


FRESHNESS_SQL = ("CASE WHEN valid_to IS NOT NULL AND {now} > valid_to THEN 'expired' "
                 "WHEN date_diff('microsecond', coalesce(issued_at, acquired_at), {now}) // 1000000 <= 0.25 * span THEN 'live' "
                 "WHEN date_diff('microsecond', coalesce(issued_at, acquired_at), {now}) // 1000000 <= 0.75 * span THEN 'recent' ELSE 'stale' END")
SPAN_SQL = ("greatest(60, CASE WHEN valid_from IS NOT NULL AND valid_to IS NOT NULL "
            "THEN date_diff('microsecond', valid_from, valid_to) // 1000000 ELSE 43200 END)")


@query("f12_freshness_grade", f"""
WITH s AS (SELECT *, {SPAN_SQL} AS span FROM {{observations}})
SELECT obs_id, {FRESHNESS_SQL.format(now=f"TIMESTAMP '{AS_OF}'")} AS freshness FROM s""")
def f12(v: Views):
    return v.observations.select("obs_id", marine.freshness_grade(
        F.expr(NOW), "acquired_at", "issued_at", "valid_from", "valid_to").alias("freshness"))


@query("f13_provenance_id", """
SELECT obs_id, source_id || '@' || strftime(coalesce(issued_at, acquired_at), '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(coalesce(issued_at, acquired_at)) % 1000000 <> 0 THEN strftime(coalesce(issued_at, acquired_at), '.%f') ELSE '' END || '+00:00' AS provenance_id
FROM {observations}""")
def f13(v: Views):
    return v.observations.select("obs_id", marine.provenance_id("source_id", "issued_at", "acquired_at").alias("provenance_id"))


@query("f14_display_value", """
WITH o AS (SELECT obs_id, unit, CASE WHEN value_num IS NOT NULL AND obs_id % 4 = 0 THEN CAST(obs_id % 4000 AS DOUBLE) / 8
  WHEN value_num IS NOT NULL AND obs_id % 4 = 1 THEN CAST(obs_id % 9000 AS DOUBLE) / 1000 ELSE value_num END AS value_num FROM {observations})
SELECT obs_id, CASE WHEN value_num IS NULL THEN 'NIL' ELSE printf('%.2f', value_num) || ' ' || unit END AS display FROM o""")
def f14(v: Views):
    """A quarter of the values are eighths (exact ties), a quarter thousandths (beside a tie)."""
    k = F.col("obs_id")
    value = F.when(F.col("value_num").isNotNull() & (k % 4 == 0), (k % 4000).cast("double") / 8).when(
        F.col("value_num").isNotNull() & (k % 4 == 1), (k % 9000).cast("double") / 1000).otherwise(F.col("value_num"))
    return v.observations.select("obs_id", marine.display_value(value, F.lit("NIL"), "unit").alias("display"))


@query("f16_shallow_penalty", """
WITH d AS (SELECT event_id, CASE WHEN event_id % 31 = 0 THEN NULL ELSE (event_id % 120) / 10 END AS depth FROM {events})
SELECT event_id, round(CASE WHEN depth IS NULL THEN 0 WHEN depth < 2.4 THEN 1 ELSE greatest(0, least(1, (2.4 + 5 - depth) / 5)) END, 6) AS penalty,
       coalesce(depth < 1.2, false) AS blocked FROM d""")
def f16(v: Views):
    d = F.when(F.col("event_id") % 31 == 0, F.lit(None)).otherwise((F.col("event_id") % 120) / 10)
    return v.events.select("event_id", marine.shallow_penalty(d, 1.2).alias("penalty"), marine.too_shallow(d, 1.2).alias("blocked"))


@query("f17_boundary_penalty", """
WITH d AS (SELECT event_id, CASE WHEN event_id % 31 = 0 THEN NULL ELSE (event_id % 500) / 100 END AS nm FROM {events})
SELECT event_id, round(CASE WHEN nm IS NULL THEN 0 ELSE greatest(0, least(1, (3.0 - nm) / (3.0 - 0.3))) END, 6) AS penalty,
       coalesce(nm <= 0.3, false) AS blocked FROM d""")
def f17(v: Views):
    d = F.when(F.col("event_id") % 31 == 0, F.lit(None)).otherwise((F.col("event_id") % 500) / 100)
    return v.events.select("event_id", marine.boundary_penalty(d).alias("penalty"), marine.too_close(d).alias("blocked"))


@query("f18_adverse_current", """
SELECT event_id, round(CASE WHEN event_id % 31 = 0 THEN 0 ELSE
       1.5 * greatest(0, -(speed_kn * cos(radians((event_id * 17) % 360 - heading_deg)))) / 3 END, 6) AS rate FROM {positions}""")
def f18(v: Views):
    speed = F.when(F.col("event_id") % 31 == 0, F.lit(None)).otherwise(F.col("speed_kn"))
    return v.positions.select("event_id", marine.adverse_current(
        speed, (F.col("event_id") * 17 % 360).cast("double"), "heading_deg").alias("rate"))


@query("f20_message_template", f"""
WITH copy AS ({dims.rows_sql(dims.ALERT_COPY, 'fence_class, lvl, copy')}), titles AS ({dims.rows_sql([(r[0], r[6]) for r in dims.FENCE_CLASSES], 'fence_class, title')}),
x AS (SELECT event_id, vessel_id, speed_kn, heading_deg,
             list_extract(['INFO','WARN','CRITICAL','BREACH'], CAST(event_id % 4 AS INT) + 1) AS lvl,
             list_extract(['IMBL_HISTORIC_WATERS','IMBL_MARITIME_BOUNDARY','MPA','ECO_SENSITIVE','USER_DEFINED','HAZARD_EXCLUSION'], CAST(event_id % 6 AS INT) + 1) AS fence_class
      FROM {{positions}})
SELECT event_id, replace(replace(replace(copy, '{{name}}', CASE WHEN event_id % 5 = 0 THEN title ELSE 'Fence ' || CAST(vessel_id AS VARCHAR) END), '{{distance}}',
       CASE WHEN event_id % 9 = 0 THEN '?' ELSE printf('%.1f', (event_id % 800) / 20) END), '{{eta}}', 'shortly') AS body
FROM x JOIN copy ON copy.fence_class = x.fence_class AND copy.lvl = CASE x.lvl WHEN 'INFO' THEN 'WARN' ELSE x.lvl END JOIN titles ON titles.fence_class = x.fence_class""")
def f20(v: Views):
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % n).cast("int") + 1)
    rows = v.positions.withColumns({
        "lvl": pick(("INFO", "WARN", "CRITICAL", "BREACH"), 4), "fence_class": pick([r[0] for r in dims.FENCE_CLASSES], 6)})
    rows = reports.with_copy(rows, "fence_class", "lvl")
    distance = F.when(F.col("event_id") % 9 != 0, (F.col("event_id") % 800) / F.lit(20))
    name = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Fence "), F.col("vessel_id").cast("string")))
    return rows.select("event_id", marine.fill_message("copy", name, distance, F.lit("shortly"), "title").alias("body"))


@query("f21_local_clock", """
SELECT event_id, strftime(ts + INTERVAL '330 minutes', '%H:%M on %a %-d %b') || ' IST' AS clock FROM {events}""")
def f21(v: Views):
    return v.events.select("event_id", marine.local_clock("ts").alias("clock"))


@query("f22_json_row", """
SELECT '{"source_id":"' || source_id || '","variable":"' || variable || '","where":{"location_id":' || location_id || ',"unit":"' || unit || '"}}' AS body, obs_id
FROM {observations}""")
def f22(v: Views):
    body = F.to_json(F.struct("source_id", "variable", F.struct("location_id", "unit").alias("where")))
    return v.observations.select("obs_id", body.alias("body"))


@query("p1_point_in_bbox", """
SELECT event_id, coalesce(lat BETWEEN 8 AND 10 AND lon BETWEEN 78.5 AND 80, false) AS inside FROM {cyclones} c JOIN
(SELECT o_orderkey AS event_id2, o_orderkey AS event_id FROM {orders}) o ON c.episode_id = o.event_id2""".replace("SELECT event_id, coalesce", "SELECT o.event_id AS event_id, coalesce"))
def p1(v: Views):
    return v.cyclones.select(F.col("episode_id").alias("event_id"),
                             filters.in_bbox("lat", "lon", (78.5, 8.0, 80.0, 10.0)).alias("inside"))


@query("p2_current_events", """
SELECT event_id, episode_id, alert_level FROM {cyclones}
WHERE is_current AND coalesce(lat BETWEEN 3 AND 15.9 AND lon BETWEEN 73 AND 85.6, false)""")
def p2(v: Views):
    return filters.current_events(v.cyclones).select("event_id", "episode_id", "alert_level")


_BOX = (78.4, 8.4, 79.5, 9.6)


@query("p3_feature_in_bbox", """
WITH known AS (SELECT seq, layer_id, CASE WHEN seq % 11 <> 0 THEN minx END AS minx, miny, maxx, maxy FROM {features}),
hit AS (SELECT *, minx <= 79.5 AND maxx >= 78.4 AND miny <= 9.6 AND maxy >= 8.4 AS h FROM known)
SELECT 'keep' AS mode, seq FROM hit WHERE coalesce(h, true) UNION ALL SELECT 'drop', seq FROM hit WHERE coalesce(h, false)""")
def p3(v: Views):
    known = v.features.withColumn("minx", F.when(F.col("seq") % 11 != 0, F.col("minx")))
    return filters.feature_in_bbox(known, "envelope_keep_unknown", _BOX).select(F.lit("keep").alias("mode"), "seq").unionByName(
        filters.feature_in_bbox(known, "envelope_drop_unknown", _BOX).select(F.lit("drop").alias("mode"), "seq"))


@query("p3_segments_in_bbox", """
WITH e AS (SELECT layer, fkey, min(least(x1,x2)) AS a, min(least(y1,y2)) AS b, max(greatest(x1,x2)) AS c, max(greatest(y1,y2)) AS d
           FROM {fence_segments} GROUP BY 1, 2),
pieces AS (SELECT layer, fkey, is_polygon, x1, y1, x2, y2, k / 2000.0 AS t FROM {fence_segments}, range(0, 2001) r(k)),
touched AS (SELECT layer, fkey FROM pieces WHERE x1+t*(x2-x1) BETWEEN 78.4 AND 79.5 AND y1+t*(y2-y1) BETWEEN 8.4 AND 9.6 GROUP BY 1, 2)
SELECT 'vertex_or_envelope' AS mode, layer, fkey FROM e WHERE a <= 79.5 AND c >= 78.4 AND b <= 9.6 AND d >= 8.4
UNION ALL SELECT 'exact', layer, fkey FROM touched""")
def p3s(v: Views):
    pick = lambda m: filters.segments_in_bbox(v.fence_segments, m, _BOX).select(F.lit(m).alias("mode"), "layer", "fkey")
    return pick("vertex_or_envelope").unionByName(pick("exact"))


@query("p4_district_filter", "SELECT port_id FROM {ports} WHERE lower(trim(district)) = 'nation_7'")
def p4(v: Views):
    return v.ports.where(filters.same_name("district", F.lit(" Nation_7 "))).select("port_id")


@query("p5_advisory_currency", f"""
WITH a AS (SELECT event_id, CASE WHEN event_id % 23 <> 0 THEN DAY_OF(ts) END AS d FROM {{events}}),
g AS (SELECT event_id, CASE WHEN d IS NOT NULL THEN greatest(0, date_diff('second', d, TIMESTAMP '{AS_OF}') / 86400) END AS age FROM a)
SELECT event_id, round(age, 6) AS age_days, coalesce(age <= 7, false) AS is_current FROM g""")
def p5(v: Views):
    d = F.when(F.col("event_id") % 23 != 0, F.date_trunc("DAY", "ts").cast("timestamp_ntz"))
    return v.events.select("event_id", filters.advisory_age_days(d, F.expr(NOW)).alias("age_days")).withColumn(
        "is_current", filters.advisory_is_current("age_days"))


@query("p6_block_selection", """
WITH b AS (SELECT o_custkey AS office, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'South Coast' WHEN 1 THEN 'NORTH COAST' WHEN 2 THEN ' east coast' ELSE 'Islands' END AS block FROM {orders}),
r AS (SELECT office, lower(trim(block)) AS block, CASE lower(trim(block)) WHEN 'south coast' THEN 0 WHEN 'north coast' THEN 1 WHEN 'east coast' THEN 2 END AS pref FROM b)
SELECT office, min(pref) AS pref, min(pref) = 0 AS matched_exactly FROM r WHERE pref IS NOT NULL GROUP BY office""")
def p6(v: Views):
    names = F.element_at(F.array(*[F.lit(n) for n in ("South Coast", "NORTH COAST", " east coast", "Islands")]),
                         (F.col("o_orderkey") % 4).cast("int") + 1)
    blocks = v.orders.select(F.col("o_custkey").alias("office"), names.alias("block"))
    wanted = dims.table(v.spark, (("South Coast", 0), ("North Coast", 1), ("East Coast", 2)), "block, pref")
    return filters.pick_block(blocks, ["office"], wanted).select("office", "pref", "matched_exactly")


@query("p7_grid_subset", f"SELECT slice, i, j, {r6('value')} FROM {{grid_cells}} WHERE lat BETWEEN 8.5 AND 9.75 AND lon BETWEEN 78.25 AND 79.5")
def p7(v: Views):
    return v.grid_cells.where(filters.in_bbox("lat", "lon", (78.25, 8.5, 79.5, 9.75))).select("slice", "i", "j", "value")


@query("p8_coverage_clamp", """
WITH w AS (SELECT o_orderkey, o_orderdate AS s, ADDS(o_orderdate; ((o_orderkey * 13) % 5000) * 86400) AS e FROM {orders})
SELECT o_orderkey, 'clamp' AS mode, greatest(s, TS(1996-01-01 00:00:00)) AS win_start, least(e, TS(2001-12-31 00:00:00)) AS win_end,
       s < TS(1996-01-01 00:00:00) OR e > TS(2001-12-31 00:00:00) AS moved FROM w
UNION ALL SELECT o_orderkey, 'collapse', CASE WHEN e < TS(1996-01-01 00:00:00) THEN TS(1996-01-01 00:00:00) WHEN s > TS(2001-12-31 00:00:00) THEN TS(2001-12-31 00:00:00) ELSE greatest(s, TS(1996-01-01 00:00:00)) END,
       CASE WHEN e < TS(1996-01-01 00:00:00) THEN TS(1996-01-01 00:00:00) WHEN s > TS(2001-12-31 00:00:00) THEN TS(2001-12-31 00:00:00) ELSE least(e, TS(2001-12-31 00:00:00)) END,
       s < TS(1996-01-01 00:00:00) OR e > TS(2001-12-31 00:00:00) FROM w
UNION ALL SELECT o_orderkey, 'oldest', s, CASE WHEN date_diff('second', s, e) > 285120000 THEN ADDS(s; 285120000) ELSE e END, date_diff('second', s, e) > 285120000 FROM w
UNION ALL SELECT o_orderkey, 'newest', CASE WHEN date_diff('second', s, e) > 285120000 THEN ADDS(e; -285120000) ELSE s END, e, date_diff('second', s, e) > 285120000 FROM w""")
def p8(v: Views):
    w = v.orders.select("o_orderkey", F.col("o_orderdate").alias("s"), F.timestamp_add(
        "SECOND", (F.col("o_orderkey") * 13 % 5000) * 86400, F.col("o_orderdate")).alias("e"))
    lo, hi = F.expr("timestamp_ntz'1996-01-01 00:00:00'"), F.expr("timestamp_ntz'2001-12-31 00:00:00'")
    modes = {"clamp": filters.clamp_window("s", "e", lo, hi), "collapse": filters.collapse_window("s", "e", lo, hi),
             "oldest": filters.cap_span("s", "e", "oldest", filters.MAX_SPAN_DAYS), "newest": filters.cap_span("s", "e", "newest", filters.MAX_SPAN_DAYS)}
    variants = F.array(*[F.struct(F.lit(m).alias("mode"), c["win_start"].alias("win_start"), c["win_end"].alias("win_end"),
                                  c.get("clamped", c.get("capped")).alias("moved")) for m, c in modes.items()])
    return w.select("o_orderkey", F.inline(variants))


@query("p9_missing_value", """
WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' NULL' WHEN 2 THEN 'nan' WHEN 3 THEN 'n/a' ELSE ' ' || CAST(event_id AS VARCHAR(20)) || '.5 ' END AS raw FROM {events})
SELECT event_id, CASE WHEN event_id % 6 >= 4 THEN event_id + 0.5::DOUBLE END AS value FROM t""")
def p9(v: Views):
    k = F.col("event_id") % 6
    raw = F.when(k == 0, "").when(k == 1, " NULL").when(k == 2, "nan").when(k == 3, "n/a").otherwise(
        F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".5 ")))
    return v.events.select("event_id", filters.numeric_or_null(raw).alias("value"))


@query("p10_threshold_mask", """
SELECT obs_id, coalesce(value_num > 20, false) AS gt, coalesce(value_num >= 20, false) AS ge,
       coalesce(value_num < 20, false) AS lt, coalesce(value_num <= 20, false) AS le FROM {observations}""")
def p10(v: Views):
    ops = {"gt": ">", "ge": ">=", "lt": "<", "le": "<="}
    return v.observations.select("obs_id", *[filters.threshold_mask("value_num", o, 20.0).alias(n) for n, o in ops.items()])


@query("p12_decision_still_valid", f"SELECT obs_id, coalesce(valid_to > TIMESTAMP '{AS_OF}', false) AS usable FROM {{observations}}")
def p12(v: Views):
    return v.observations.select("obs_id", filters.still_valid("valid_to", F.expr(NOW)).alias("usable"))


@query("p13_class_alias", f"""
WITH w AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN ' imbl' WHEN 1 THEN 'Mpa' WHEN 2 THEN 'hazard_exclusion' ELSE 'reef' END AS wanted FROM {{supplier}}),
a AS ({dims.rows_sql(dims.CLASS_ALIASES, 'alias, fence_class')})
SELECT s_suppkey, wanted, fence_class FROM w LEFT JOIN a ON upper(trim(wanted)) = alias""")
def p13(v: Views):
    words = F.element_at(F.array(*[F.lit(w) for w in (" imbl", "Mpa", "hazard_exclusion", "reef")]), (F.col("s_suppkey") % 4).cast("int") + 1)
    return fence_ops.resolve_classes(v.supplier.select("s_suppkey", words.alias("wanted"))).select("s_suppkey", "wanted", "fence_class")


@query("p14_fence_legend", f"""
WITH c AS ({dims.rows_sql(dims.FENCE_CLASSES, dims.FENCE_COLUMNS)}), n AS (SELECT layer, count(*) AS n FROM {{fences}} GROUP BY 1)
SELECT fence_class, class_order, severity, warn_nm, critical_nm, colour, title, severity IN ('legal_hard', 'hazard') AS blocks_routing,
       coalesce(n, 0) AS features FROM c LEFT JOIN n ON n.layer = c.fence_class""")
def p14(v: Views):
    counts = v.fences.groupBy(F.col("layer").alias("fence_class")).agg(F.count(F.lit(1)).alias("n"))
    return fence_ops.fence_legend(v.spark).join(counts, "fence_class", "left") \
        .withColumn("features", F.coalesce("n", F.lit(0).cast("bigint"))).drop("n")


@query("p15_reference_listing", f"""
WITH c AS ({dims.rows_sql(dims.VESSEL_CLASSES, dims.VESSEL_COLUMNS)})
SELECT vessel_class, cruise_kn, max_kn, min_depth_m, count(r.request_id) AS n_requests
FROM c LEFT JOIN {{requests}} r USING (vessel_class) GROUP BY ALL""")
def p15(v: Views):
    used = v.requests.groupBy("vessel_class").agg(F.count(F.lit(1)).alias("n"))
    return dims.vessel_classes(v.spark).join(used, "vessel_class", "left").select(
        "vessel_class", "cruise_kn", "max_kn", "min_depth_m", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_requests"))
