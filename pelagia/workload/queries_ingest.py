"""Ingest jobs over raw rows rendered from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pelagia import dims
from pelagia.session import shared_folder
from pelagia.sources import ingest as src
from pelagia.workload.queries_fences import hav
from pelagia.workload.registry import query, r6
from pelagia.workload.views import AS_OF, Views

NOW = f"timestamp_ntz'{AS_OF}'"


@query("s1_hourly_json", """
WITH e AS (SELECT user_id, date_trunc('minute', ts) AS valid_time, event_type, CASE WHEN event_id % 13 <> 0 THEN value END AS raw_value FROM {events})
SELECT user_id, valid_time, CASE event_type WHEN 'click' THEN 'significant_wave_height' WHEN 'view' THEN 'wind_speed' WHEN 'purchase' THEN 'wave_period' WHEN 'signup' THEN 'visibility' ELSE 'current_speed' END AS variable,
       CASE event_type WHEN 'click' THEN 'm' WHEN 'view' THEN 'kn' WHEN 'purchase' THEN 's' WHEN 'signup' THEN 'm' ELSE 'm/s' END AS unit,
       CASE event_type WHEN 'click' THEN 'metre' WHEN 'view' THEN 'km/h' WHEN 'purchase' THEN 's' WHEN 'signup' THEN 'm' ELSE 'km/h' END AS raw_unit,
       round(raw_value * CASE event_type WHEN 'view' THEN 1 / 1.852::DOUBLE WHEN 'error' THEN 1 / 3.6::DOUBLE ELSE 1 END, 6) AS value_num,
       CASE WHEN user_id % 7 = 0 THEN 0 ELSE round(1852 * """ + hav("(9 + (user_id % 50) / 100)", "(79 + (user_id % 40) / 100)", "9.3", "79.3") + """, 1) END AS grid_distance_m
FROM e WHERE raw_value IS NOT NULL""")
def s1(v: Views):
    raw = v.events
    value = F.when(F.col("event_id") % 13 != 0, F.col("value"))
    column = lambda kind: F.to_json(F.transform("_h", lambda h: F.when(h["event_type"] == kind, h["v"])))
    rows = raw.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", value.alias("v")))).alias("_h"))
    times = F.to_json(F.transform("_h", lambda h: F.date_format(h["ts"], "yyyy-MM-dd'T'HH:mm")))
    body = F.concat(F.lit('{"latitude":9.3,"longitude":79.3,"hourly":{"time":'), times, F.lit(',"wave_height":'), column("click"),
                    F.lit(',"wind_speed_10m":'), column("view"), F.lit(',"ocean_current_velocity":'), column("error"), F.lit(',"wave_period":'), column("purchase"), F.lit(',"visibility":'), column("signup"),
                    F.lit('},"hourly_units":{"wave_height":"metre","wind_speed_10m":"km/h"}}'))
    asked = lambda base, n: F.when(F.col("user_id") % 7 != 0, F.lit(base) + F.col("user_id") % n / F.lit(100))  # noqa: E731  one in seven asks for no point
    return src.ingest_hourly_json(rows.select("user_id", asked(9, 50).alias("lat"), asked(79, 40).alias("lon"), body.alias("value")), lat="lat", lon="lon").select(
        "user_id", "valid_time", "variable", "unit", "raw_unit", "value_num", "grid_distance_m")


@query("s2_geojson_segments", f"SELECT layer, fkey, part, ring, seq, {r6('x1', 'y1', 'x2', 'y2')}, is_polygon FROM {{fence_segments}} "
       "UNION ALL SELECT 'port', CAST(port_id AS INT), 0, 0, 0, round(lon, 6), round(lat, 6), round(lon, 6), round(lat, 6), false FROM {ports}")
def s2(v: Views):
    x, y = F.col("x0"), F.col("y0")
    at = lambda dx, dy: F.array(x + F.lit(dx) / 10, y + F.lit(dy) / 10)
    ring = F.to_json(F.array(F.array(at(0, 0), at(2, 0), at(2, 2), at(0, 2), at(0, 0))))
    line = F.to_json(F.array(F.array(x, y), F.array(x + F.lit(3) / 10, y + F.lit(15) / 100)))
    shape = F.when(F.col("is_polygon"), F.concat(F.lit('"Polygon","coordinates":'), ring)).otherwise(
        F.concat(F.lit('"LineString","coordinates":'), line))
    head, tail = F.lit('{"type":"Feature","geometry":{"type":'), F.lit('},"properties":{"kind":"test"}}')
    fences = v.fences.select("layer", "fkey", F.concat(head, shape, tail).alias("value"))
    ports = v.ports.select(F.lit("port").alias("layer"), F.col("port_id").cast("int").alias("fkey"), F.concat(
        head, F.lit('"Point","coordinates":'), F.to_json(F.array("lon", "lat")), tail).alias("value"))
    # fences land as one collection per layer with keys on the features, ports as single features
    keyed = fences.select("layer", F.concat(F.lit('{"feature_key":"'), F.col("fkey").cast("string"), F.lit('","source_id":"s","acquired_at":"2026-09-01T10:00:00.5+00:00",'),
                                            F.expr("substring(value, 2)")).alias("value"))
    files = keyed.groupBy("layer").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    lines = src.ingest_geojson(files)[1].withColumn("fkey", F.col("feature_key").cast("int"))
    columns = ["layer", "fkey", "part", "ring", "seq", "x1", "y1", "x2", "y2", "is_polygon"]
    return lines.select(*columns).unionByName(src.ingest_geojson(ports)[1].select(*columns))


@query("s3_two_header_csv", """
WITH e AS (SELECT user_id, event_id, date_trunc('second', ts) AS valid_time FROM {events})
SELECT user_id, valid_time, CAST(10 * (event_id % 7) AS DOUBLE) AS depth, 'TEMP' AS variable, 'degC' AS unit, round((event_id % 300) / 10, 6) AS value_num, round(CASE WHEN event_id % 5 <> 0 THEN (event_id % 10) / 100 END, 6) AS relative_error FROM e WHERE event_id % 4 <> 0
UNION ALL SELECT user_id, valid_time, CAST(10 * (event_id % 7) AS DOUBLE), 'SAL', 'psu', round(30 + (event_id % 50) / 10, 6), NULL FROM e WHERE event_id % 3 <> 0""")
def s3(v: Views):
    k = F.col("event_id")
    text = lambda cond, c: F.when(cond, c.cast("string")).otherwise(F.lit("NaN"))
    data = v.events.select("user_id", F.concat_ws(
        ",", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), (10 * (k % 7)).cast("double").cast("string"), F.lit("9.5"), F.lit("79.5"),
        text(k % 4 != 0, (k % 300) / 10), text(k % 5 != 0, (k % 10) / 100), text(k % 3 != 0, 30 + (k % 50) / 10)).alias("value"))
    # half of the files have the columns in another order
    other = F.col("user_id") % 2 == 1
    swapped = F.regexp_replace("value", "^([^,]*),([^,]*),([^,]*),([^,]*),([^,]*),([^,]*),([^,]*)$", "$1,$4,$3,$2,$7,$5,$6")
    data = data.select("user_id", F.when(other, swapped).otherwise(F.col("value")).alias("value"))
    heads = v.events.select("user_id").distinct().select("user_id", F.explode(F.when(
        other, F.array(F.lit("time,longitude,latitude,ZAX,SAL,TEMP,TERR"), F.lit("UTC,degrees_east,degrees_north,meter,psu,degC,1"))).otherwise(F.array(
            F.lit("time,ZAX,latitude,longitude,TEMP,TERR,SAL"), F.lit("UTC,meter,degrees_north,degrees_east,degC,1,psu")))).alias("value"))
    return src.ingest_griddap_csv(heads.unionByName(data), {"TEMP": "TERR", "SAL": "SERR"}).select(
        "user_id", "valid_time", "depth", "variable", "unit", "value_num", "relative_error")


@query("s4_catalog_dates", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'chl' ELSE 'WAVES_coast' END AS product, CAST(CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) + 3 ELSE CAST(ts AS DATE) END AS TIMESTAMP) AS file_date FROM {events} WHERE event_id % 3 <> 2""")
def s4(v: Views):
    day = lambda n: F.date_format(F.date_add(F.to_date("ts"), n), "yyyyMMdd")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("VIIRS-SNPP-Roll-"), day(0), F.lit("-"), day(3), F.lit("-4KM-PICountries-CHL.nc"))) \
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("WAVES_coast_"), day(0), F.lit(".nc"))).otherwise(F.lit("readme.txt"))
    lines = v.events.select("event_id", F.concat(F.lit('<dataset name="'), name, F.lit('" urlPath="osf/'), name, F.lit('"/>')).alias("value"))
    return src.catalog_dates(lines).select("event_id", "product", F.col("file_date").cast("timestamp_ntz").alias("file_date"))


@query("s5_bulletin_html", """
SELECT bulletin_id, 'Block ' || CAST(block_id AS VARCHAR) AS block, trim(regexp_replace(sea_condition, '\\s+', ' ', 'g')) AS sea_condition, port_signal, district AS remark_text,
       valid_from, valid_to FROM {bulletins}
UNION ALL SELECT bulletin_id, 'Second block', 'SLIGHT', NULL, NULL, valid_from, valid_to FROM {bulletins}""")
def s5(v: Views):
    row = lambda label, c: F.coalesce(F.concat(F.lit(f"<tr>\n <td class='td-1'>{label}</td> <td >"), c, F.lit("</td></tr>")), F.lit(""))
    valid = F.coalesce(F.concat(
        F.lit("<p>Bulletin Valid for 12 hrs from "), F.date_format("valid_from", "HH"), F.lit(" UTC of "), F.date_format("valid_from", "yyyy-MM-dd"),
        F.lit(" \n\t to "), F.date_format("valid_to", "HH"), F.lit(" UTC of "), F.date_format("valid_to", "yyyy-MM-dd"), F.lit("</p>")), F.lit(""))
    html = F.concat(F.lit("<html>"), valid, F.lit("<table><tr><td>Synoptic Situation</td><td>NIL</td></tr></table><table class='tr '><caption class='c'>\n Block&nbsp;"),
                    F.col("block_id").cast("string"), F.lit(" </caption>"), row("Sea Condition", F.col("sea_condition")), row("Port Signal", F.col("port_signal")),
                    row("Remark Text", F.col("district")), F.lit("</table><table><caption>Second block</caption><tr><td>Sea  Condition</td><td>SLIGHT</td></tr></table></html>"))
    got = src.parse_bulletins(v.spread(v.bulletins).select("bulletin_id", html.alias("html")))
    return got.select("bulletin_id", "block", F.col("fields")["sea_condition"].alias("sea_condition"), F.col("fields")["port_signal"].alias("port_signal"),
                      F.col("fields")["remark_text"].alias("remark_text"), "valid_from", "valid_to")


@query("s6_district_warnings", """
WITH b AS (SELECT event_id, CAST(ts AS DATE)::TIMESTAMP AS d, (event_id * 7) % 24 AS h, (event_id * 11) % 60 AS m, (event_id * 5) % 24 AS vh, ts FROM {events}),
i AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN ts ELSE d + to_minutes(h * 60 + m - 330) END AS issued_at, d + to_minutes(vh * 60 - 330) AS u FROM b)
SELECT event_id, issued_at, CASE WHEN u <= issued_at THEN u + to_hours(24) ELSE u END AS valid_to,
       CASE WHEN event_id % 4 = 0 THEN 'Thunder' WHEN event_id % 4 = 1 THEN 'Wet roads' ELSE 'NIL' END AS value_text,
       list_extract(['green', 'yellow', 'orange', 'red'], CAST(event_id % 5 AS INT) + 1) AS colour FROM i""")
def s6(v: Views):
    k = F.col("event_id")
    rows = v.events.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        F.when(k % 9 != 0, ((k * 7 % 24) * 100 + k * 11 % 60).cast("string")).otherwise("late").alias("toi"),
        (k * 5 % 24 * 100).cast("string").alias("vupto"), F.when(k % 4 == 0, " Thunder ").otherwise("").alias("message"),
        F.when(k % 4 == 1, "Wet roads").alias("impact"), F.lit(" ").alias("action"), (k % 5 + 1).cast("int").alias("Color"),
        F.lit(None).cast("string").alias("update_time"), F.col("ts").alias("acquired_at"))
    return src.parse_nowcast(rows).select("event_id", "issued_at", "valid_to", "value_text", "colour")


@query("s7_station_rows", """
SELECT event_id, 'temperature' AS variable, 'degC' AS unit, round((event_id % 400) / 10, 6) AS value_num FROM {events} WHERE event_id % 5 <> 0
UNION ALL SELECT event_id, 'wind_speed', 'kn', round((event_id % 90) / 1.852::DOUBLE, 6) FROM {events} WHERE event_id % 7 <> 0
UNION ALL SELECT event_id, 'wind_direction', 'deg', round(event_id % 360, 6) FROM {events} UNION ALL SELECT event_id, 'humidity', '%', 80 FROM {events} UNION ALL SELECT event_id, 'pressure', 'hPa', 1008.5 FROM {events}""")
def s7(v: Views):
    k = F.col("event_id")
    rows = v.events.select(
        "event_id", F.when(k % 5 != 0, ((k % 400) / 10).cast("string")).otherwise("NULL").alias("temp"),
        F.when(k % 7 != 0, (k % 90).cast("string")).otherwise(" ").alias("windspeed"), (k % 360).cast("string").alias("winddir"),
        F.lit("80").alias("rh"), F.lit(" 1008.5 ").alias("mslp"), F.lit("trace").alias("rainfall"))
    return src.parse_stations(rows).select("event_id", "variable", "unit", "value_num")


@query("s8_cyclone_events", """
SELECT CAST(o_custkey AS VARCHAR) AS event_id, CAST(o_orderkey AS VARCHAR) AS episode_id, 'TC-' || CAST(o_custkey AS VARCHAR) AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'Red' ELSE 'Green' END AS alert_level,
       o_orderdate AS from_date, round((o_orderkey % 200) / 10, 6) AS lat, CASE WHEN o_orderkey % 2 = 0 THEN 'Severe storm' ELSE CAST(o_orderkey % 90 AS VARCHAR) || '.0 km/h' END AS severity, o_orderstatus = 'O' AS is_current
FROM {orders} WHERE o_orderkey % 10 <> 0""")
def s8(v: Views):
    k = F.col("o_orderkey")
    prop = F.to_json(F.struct(
        F.col("o_custkey").alias("eventid"), F.when(k % 10 != 0, k).alias("episodeid"), F.when(k % 3 == 0, "Red").alias("alertlevel"),
        F.when(F.col("o_orderstatus") == "O", "True").otherwise("false").alias("iscurrent"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("fromdate"),
        F.struct((k % 90).cast("double").alias("severity"), F.when(k % 2 == 0, "Severe storm").alias("severitytext"), F.lit("km/h").alias("severityunit")).alias("severitydata")))
    body = F.concat(F.lit('{"geometry":{"coordinates":[80.5,'), ((k % 200) / 10).cast("string"), F.lit(']},"properties":'), prop, F.lit("}"))
    return src.parse_cyclones(v.orders.select(body.alias("value"))).select(
        "event_id", "episode_id", "name", "alert_level", "from_date", "lat", "severity", "is_current")


_CLASSES = "CASE p_size % 8 WHEN 0 THEN 'Poly_Cones' WHEN 1 THEN 'Poly_Red' WHEN 2 THEN 'Poly_Orange' WHEN 3 THEN 'Poly_Green' WHEN 4 THEN 'Line_Line_2' WHEN 5 THEN 'Point_12' WHEN 6 THEN 'Poly_Circle' END"


@query("s9_hazard_classes", f"""
SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'cone' WHEN 1 THEN 'wind_red' WHEN 2 THEN 'wind_orange' WHEN 3 THEN 'wind_green' WHEN 4 THEN 'track' WHEN 5 THEN 'point' END AS kind, p_size % 8 < 3 AS excludes FROM {{part}}""")
def s9(v: Views):
    return src.classify_hazards(v.part.select("p_partkey", F.expr(_CLASSES).alias("Class"))).select("p_partkey", "kind", "excludes")


@query("s10_boundary_lines", """
SELECT s_suppkey AS line_id, CASE WHEN s_suppkey % 10 = 1 THEN 'IMBL_HISTORIC_WATERS' ELSE 'IMBL_MARITIME_BOUNDARY' END AS fence_class, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_name END, 'second') AS treaty,
       '1974-06-26' AS treaty_date, CASE WHEN s_suppkey % 10 NOT IN (1, 2, 3) THEN 'unlisted line id' END AS note FROM {supplier} WHERE s_suppkey % 4 <> 0""")
def s10(v: Views):
    k = F.col("s_suppkey")
    lines = v.supplier.select(k.alias("line_id"), F.when(k % 4 != 0, "Treaty").otherwise("200 NM").alias("line_type"),
                              F.when(k % 3 != 0, F.col("s_name")).alias("source1"), F.lit("second").alias("source2"), F.lit("1974-06-26Z").alias("doc_date"))
    return src.classify_boundaries(lines, lines.where("line_id % 10 = 1"), lines.where("line_id % 10 IN (2, 3)"))


@query("s11_landing_centres", f"SELECT port_id AS id, name, district, {r6('lat', 'lon')} FROM {{ports}} WHERE port_id % 6 <> 0")
def s11(v: Views):
    k = F.col("port_id")
    rows = v.ports.select(k.alias("id"), F.when(k % 6 != 0, F.concat(F.lit(" "), F.col("name"))).otherwise(" ").alias("LC_NAME"), F.col("district").alias("DIST_NAME"),
                          F.when(k % 2 == 0, F.col("lat")).alias("geom_lat"), F.when(k % 2 == 0, F.col("lon")).alias("geom_lon"),
                          F.col("lat").cast("string").alias("LATITUDE"), F.col("lon").cast("string").alias("LONGITUDE"))
    return src.parse_landing_centres(rows)


@query("s12_year_day", """
SELECT event_id, CAST(CASE WHEN event_id % 8 <> 0 AND event_id % 370 >= 1 THEN DATE '2024-01-01' + CAST(event_id % 370 - 1 AS INT) END AS TIMESTAMP) AS advisory_date FROM {events}""")
def s12(v: Views):
    jday = F.when(F.col("event_id") % 8 != 0, F.concat(F.lit(" "), (F.col("event_id") % 370).cast("string"))).otherwise("n/a")
    return v.events.select("event_id", src.advisory_date(F.lit(2024), jday).cast("timestamp_ntz").alias("advisory_date"))


@query("s13_feature_observations", """
WITH f AS (SELECT p_partkey, p_size % 6 AS k, p_name FROM {part})
SELECT p_partkey, CASE k WHEN 0 THEN 'pfz_line_id' WHEN 1 THEN 'pfz_sector_id' WHEN 2 THEN 'landing_centre_name' WHEN 3 THEN 'hab_sector_status' WHEN 4 THEN 'bathymetry_contour_depth' ELSE 'eco_sensitive_zone_present' END AS variable,
       CAST(CASE WHEN k = 4 THEN p_partkey % 200 END AS DOUBLE) AS value_num, CASE k WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'SEC' || CAST(p_partkey AS VARCHAR) WHEN 2 THEN p_name WHEN 3 THEN 'HAB sector ' || CAST(p_partkey AS VARCHAR) WHEN 5 THEN 'coral' END AS value_text
FROM f WHERE NOT (k = 4 AND p_partkey % 5 = 0)""")
def s13(v: Views):
    k, key = F.col("p_size") % 6, F.col("p_partkey").cast("string")
    names = F.array(*[F.lit(n) for n in ("pfz_lines", "pfz_sectors", "landing_centres", "hab_sectors", "bathymetry", "eco_coral")])
    props = F.create_map(F.lit("Sno"), key, F.lit("SEC_ID"), F.concat(F.lit("SEC"), key), F.lit("LC_NAME"), F.col("p_name"), F.lit("Id"), key,
                         F.lit("BATHMETRY1"), F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 200).cast("string")).otherwise(""))
    rows = v.part.select("p_partkey", F.get(names, k.cast("int")).alias("layer"), props.alias("properties"))
    return src.features_to_observations(rows).select("p_partkey", "variable", "value_num", "value_text")


@query("s14_keyed_upsert", """
WITH b AS (SELECT layer_id, feature_key, name, acquired_at, seq FROM {features} WHERE seq % 2 = 0 UNION ALL SELECT layer_id, feature_key, name || ' v2', acquired_at, seq FROM {features} WHERE seq % 2 = 1)
SELECT layer_id, feature_key, arg_max(name, (acquired_at, seq)) AS name, max(acquired_at) AS acquired_at FROM b GROUP BY 1, 2""")
def s14(v: Views):
    rows = v.features.select("layer_id", "feature_key", "name", "acquired_at", "seq")
    updates = rows.where("seq % 2 = 1").withColumn("name", F.concat("name", F.lit(" v2")))
    once = src.upsert(rows.where("seq % 2 = 0"), updates, ["layer_id", "feature_key"], ["acquired_at", "seq"])
    return src.upsert(once, updates, ["layer_id", "feature_key"], ["acquired_at", "seq"]).select("layer_id", "feature_key", "name", "acquired_at")


@query("s15_latest_snapshot", f"""
WITH n AS (SELECT source_id, key, max(fetched_at) AS fetched_at, arg_max(seq, (fetched_at, seq)) AS seq FROM {{snapshots}} WHERE fetched_at <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2)
SELECT 'fresh' AS mode, source_id, key, seq, false AS stale FROM n WHERE date_diff('microsecond', fetched_at, TIMESTAMP '{AS_OF}') // 1000000 <= 43200
UNION ALL SELECT 'stale_ok', source_id, key, seq, date_diff('microsecond', fetched_at, TIMESTAMP '{AS_OF}') // 1000000 > 43200 FROM n""")
def s15(v: Views):
    pick = lambda mode, **kw: src.latest_snapshot(v.snapshots, F.expr(NOW), 43200, **kw).select(F.lit(mode).alias("mode"), "source_id", "key", "seq", "stale")
    return pick("fresh").unionByName(pick("stale_ok", stale_ok=True))


@query("s16_trace_lines", "SELECT step_id, query_id, kind, ts + INTERVAL 123456 MICROSECONDS AS ts, round(duration_ms, 6) AS duration_ms, 'd1' AS result_digest, 2 AS n_sources FROM {trace_steps} QUALIFY row_number() OVER (PARTITION BY step_id ORDER BY ts, duration_ms) = 1")
def s16(v: Views):
    body = F.to_json(F.struct("step_id", "query_id", "parent_id", "agent", "kind", "tool", F.struct(F.col("tool").alias("name")).alias("args"), F.lit("d1").alias("result_digest"),
                              F.array(F.lit("a"), F.lit("b")).alias("provenance_ids"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123456+00:00")).alias("ts"),
                              "duration_ms", F.lit("why").alias("why"), "ok"))
    good = v.trace_steps.select(body.alias("value"))
    return src.read_traces(good.unionByName(good).unionByName(good.select(F.expr("substring(value, 1, 40)").alias("value")))).select(
        "step_id", "query_id", "kind", "ts", "duration_ms", "result_digest", F.size("provenance_ids").alias("n_sources"))


@query("s17_freeze_snapshots", f"""
SELECT source_id, count(DISTINCT key) AS n_keys, max(fetched_at) AS newest FROM {{snapshots}} WHERE fetched_at <= TIMESTAMP '{AS_OF}' GROUP BY 1""")
def s17(v: Views):
    """The frozen set is written, partitioned by source, and read back."""
    frozen = src.freeze(v.snapshots, F.expr(NOW), f"{shared_folder(v.spark)}/frozen-{uuid.uuid4().hex}")
    return frozen.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_keys"), F.max("fetched_at").alias("newest"))


@query("s18_export_features", f"""
WITH c AS ({dims.rows_sql(dims.FENCE_CLASSES, dims.FENCE_COLUMNS)})
SELECT layer, fkey, '{{"fkey":' || fkey || ',"name":"' || name || '","layer":"' || layer || '","colour":"' || colour || '","severity":"' || severity || '","warn_nm":' || coalesce(own_warn_nm, warn_nm) || ',"critical_nm":' || coalesce(own_critical_nm, critical_nm) || '}}' AS feature
FROM {{fences}} JOIN c ON c.fence_class = layer WHERE y0 BETWEEN 7 AND 11.9 AND x0 BETWEEN 77 AND 81.6""")
def s18(v: Views):
    return src.export_features(v.fences)
