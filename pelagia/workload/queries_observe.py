"""Readings, series, unions and source coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia import dims
from pelagia.functions import marine
from pelagia.operators import observe as ops, reports
from pelagia.plans.ordered import micros_of
from pelagia.plans.percentile import exact_percentile
from pelagia.workload.queries_scalars import DOUGLAS_SQL, FRESHNESS_SQL, NOW, SPAN_SQL
from pelagia.workload.registry import query, r6
from pelagia.workload.views import AS_OF, Views

AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
ORDER_SQL = dims.rows_sql(dims.GOVERNING_ORDER, "variable, prefix, ord")

GOVERNING = f"""
    o AS ({ORDER_SQL}),
    n AS (SELECT variable, count(*) AS n FROM o GROUP BY 1),
    rk AS (SELECT b.*, coalesce(min(o.ord), max(n.n), 0) AS src_rank
           FROM {{observations}} b LEFT JOIN o ON o.variable = b.variable AND starts_with(b.source_id, o.prefix)
           LEFT JOIN n ON n.variable = b.variable WHERE b.value_num IS NOT NULL GROUP BY ALL),
    gov AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY location_id, variable
            ORDER BY src_rank, abs(epoch_us({AS_OF_SQL}) - epoch_us(valid_time)), obs_id) = 1)"""


def governing(v: Views):
    return ops.governing_reading(v.observations, ["location_id"], F.expr(NOW))


@query("w1_governing_reading", f"WITH {GOVERNING} SELECT location_id, variable, obs_id, source_id, round(value_num, 6) AS value_num FROM gov")
def w1(v: Views):
    return governing(v).select("location_id", "variable", "obs_id", "source_id", "value_num")


@query("w2_nearest_hour", f"""
WITH h AS (SELECT *, HOUR_OF(valid_time) AS hour FROM {{observations}}),
b AS (SELECT location_id, arg_min(hour, (abs(epoch_us({AS_OF_SQL}) - epoch_us(hour)), hour)) AS hour FROM h GROUP BY 1)
SELECT h.location_id, h.hour, h.obs_id, h.variable FROM h JOIN b USING (location_id, hour)""")
def w2(v: Views):
    return ops.nearest_hour(v.observations, ["location_id"], F.expr(NOW)).select("location_id", "hour", "obs_id", "variable")


@query("w3_readings_in_order", """
SELECT location_id, variable, obs_id, row_number() OVER (PARTITION BY location_id, variable ORDER BY valid_time, obs_id) AS position
FROM {observations}""")
def w3(v: Views):
    return ops.readings_in_order(v.observations, ["location_id"]).select("location_id", "variable", "obs_id", "position")


_SERIES = """(SELECT user_id, ts, CASE WHEN event_id % 13 = 0 THEN NULL ELSE floor(value / 10) END AS level FROM {events})"""
EXTREMA = f"""
    s0 AS {_SERIES}, s AS (SELECT * FROM s0 WHERE level IS NOT NULL),
    d AS (SELECT *, lag(level) OVER w AS pv, lag(ts) OVER w AS pt, sign(level - lag(level) OVER w) AS sg FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    e AS (SELECT *, last_value(CASE WHEN sg <> 0 THEN sg END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls FROM d),
    x AS (SELECT user_id, pt AS ts, pv AS level, CASE WHEN ls > 0 THEN 'high' ELSE 'low' END AS kind FROM e WHERE sg <> 0 AND ls IS NOT NULL AND sg <> ls)"""


def extrema(v: Views):
    return ops.local_extrema(v.sql(_SERIES.strip()[1:-1]), ["user_id"], "ts", "level")


@query("w4_local_extrema", f"WITH {EXTREMA} SELECT user_id, ts, {r6('level')}, kind FROM x")
def w4(v: Views):
    return extrema(v).select("user_id", "ts", F.col("level").cast("double").alias("level"), "kind")


@query("w5_next_high_low", f"""
WITH {EXTREMA} SELECT user_id, min(ts) FILTER (WHERE kind = 'high') AS next_high, round(arg_min(level, ts) FILTER (WHERE kind = 'high'), 6) AS high_value,
       min(ts) FILTER (WHERE kind = 'low') AS next_low, round(arg_min(level, ts) FILTER (WHERE kind = 'low'), 6) AS low_value
FROM x WHERE ts >= {AS_OF_SQL} GROUP BY user_id""")
def w5(v: Views):
    got = ops.next_extrema(extrema(v), ["user_id"], "ts", "level", F.expr(NOW))
    return got.select("user_id", "next_high", F.col("high_value").cast("double").alias("high_value"), "next_low",
                      F.col("low_value").cast("double").alias("low_value"))


@query("w7_strided_subsample", """
WITH s AS (SELECT o_custkey, o_orderdate AS day, o_orderkey FROM {orders}),
b AS (SELECT o_custkey, min(day) AS lo, max(day) AS hi FROM s GROUP BY 1)
SELECT o_orderkey FROM s JOIN b USING (o_custkey) WHERE date_diff('day', lo, hi) <= 730 OR date_diff('day', lo, day) % 8 = 0""")
def w7(v: Views):
    series = v.orders.select("o_custkey", F.col("o_orderdate").alias("day"), "o_orderkey")
    return ops.strided(series, ["o_custkey"], "day", stride_days=ops.STRIDE_DAYS).select("o_orderkey")


TREND = """
    t AS (SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 86400000000 AS x FROM {src}),
    g AS (SELECT {keys}, count(*) AS n_points, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(y) AS mean_value,
                 min(ts) AS first_time, max(ts) AS last_time, arg_max(y, ts) AS last_value FROM t GROUP BY ALL),
    tr AS (SELECT *, CASE WHEN n_points >= 2 AND sxx > 0 THEN sxy / sxx * 3652.5 END AS slope_per_decade,
                  CASE WHEN n_points >= 3 AND sxx > 0 THEN sqrt(greatest(0, syy - sxy * sxy / sxx) / (n_points - 2) / sxx) * 3652.5 END AS slope_se FROM g)"""


@query("a1_ols_trend", """
WITH src AS (SELECT user_id, ts, value AS y FROM {events}), """ + TREND.replace("{src}", "src").replace("{keys}", "user_id") + """
SELECT user_id, n_points, round(mean_value, 6) AS mean_value, round(slope_per_decade, 4) AS slope_per_decade, round(slope_se, 4) AS slope_se FROM tr""")
def a1(v: Views):
    t = ops.ols_trend(v.events, ["user_id"], "ts", "value", "2024-01-01 00:00:00")
    return t.select("user_id", "n_points", "mean_value", F.round("slope_per_decade", 4).alias("slope_per_decade"),
                    F.round("slope_se", 4).alias("slope_se"))


@query("w8_series_summary", """
WITH src AS (SELECT event_type, user_id % 10 AS station, ts, value AS y FROM {events}), """ + TREND.replace("{src}", "src").replace("{keys}", "event_type, station") + """
SELECT event_type, station, n_points, round(mean_value, 6) AS mean_value, first_time, last_time, round(last_value, 6) AS last_value FROM tr""")
def w8(v: Views):
    src = v.events.withColumn("station", F.col("user_id") % 10)
    return ops.ols_trend(src, ["event_type", "station"], "ts", "value").select(
        "event_type", "station", "n_points", "mean_value", "first_time", "last_time", "last_value")


@query("a2_trend_direction", """
WITH src AS (SELECT user_id, CASE WHEN event_type IN ('view', 'signup', 'error') THEN 'view' ELSE 'click' END AS event_type, ts, value / 10000 AS y FROM {events}), """
       + TREND.replace("{src}", "src").replace("{keys}", "user_id, event_type") + """,
dir AS (SELECT user_id, event_type, CASE WHEN slope_per_decade IS NULL THEN 'unknown' WHEN abs(slope_per_decade) <= coalesce(CASE WHEN event_type = 'view' THEN 0.05 ELSE slope_se END, 0) THEN 'stable' WHEN slope_per_decade > 0 THEN 'rising' ELSE 'falling' END AS d FROM tr),
p AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN d END) AS first_direction, max(CASE WHEN event_type = 'click' THEN d END) AS second_direction FROM dir GROUP BY 1)
SELECT *, coalesce((first_direction = 'rising' AND second_direction = 'falling') OR (first_direction = 'falling' AND second_direction = 'rising'), false) AS conflict FROM p""")
def a2(v: Views):
    signal = F.when(F.col("event_type").isin("view", "signup", "error"), "view").otherwise("click")
    src = v.events.withColumns({"event_type": signal, "y": F.col("value") / 10000})
    t = ops.ols_trend(src, ["user_id", "event_type"], "ts", "y", "2024-01-01 00:00:00")
    eps = F.when(F.col("event_type") == "view", F.lit(ops.TREND_EPSILON)).otherwise(F.col("slope_se"))
    directed = t.withColumn("direction", ops.trend_direction("slope_per_decade", eps))
    return ops.trend_conflict(directed, ["user_id"], "event_type", "view", "click")


@query("a3_disagreement_panel", f"""
WITH {GOVERNING},
p AS (SELECT location_id, variable, count(*) AS n_readings, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources,
             CASE WHEN count(*) >= 2 THEN round(max(value_num) - min(value_num), 3) END AS spread FROM {{observations}} WHERE value_num IS NOT NULL GROUP BY 1, 2)
SELECT p.*, gov.source_id AS governing_source, round(gov.value_num, 6) AS governing_value,
       CASE WHEN p.variable = 'significant_wave_height' THEN coalesce({DOUGLAS_SQL.format(h='gov.value_num')} <> 4, false) ELSE false END AS band_mismatch
FROM p JOIN gov USING (location_id, variable)""")
def a3(v: Views):
    return ops.disagreement_panel(v.observations, ["location_id"], F.expr(NOW), F.lit(4))


@query("a4_evidence_groups", f"""
WITH {GOVERNING}, c AS ({dims.rows_sql(dims.EVIDENCE_CATEGORIES, 'variable, category')}),
g AS (SELECT b.location_id, b.variable, count(*) AS n_readings, bool_or(gov.obs_id IS NOT NULL) AS governs, count(DISTINCT b.source_id) > 1 AS disagreement
      FROM {{observations}} b LEFT JOIN gov ON gov.location_id = b.location_id AND gov.obs_id = b.obs_id GROUP BY 1, 2)
SELECT g.*, coalesce(category, 'other') AS category, CAST(CASE WHEN governs THEN 0 WHEN disagreement THEN 1 ELSE 2 END AS INT) AS panel_rank FROM g LEFT JOIN c USING (variable)""")
def a4(v: Views):
    return ops.evidence_groups(v.observations, ["location_id"], governing(v))


VARIABLES = ["wind_speed", "wind_gust", "visibility", "wave_period", "precipitation"]


@query("a9_wide_record", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY location_id, variable ORDER BY abs(epoch_us({AS_OF_SQL}) - epoch_us(valid_time)), obs_id) AS rn FROM {{observations}} WHERE value_num IS NOT NULL),
w AS (SELECT location_id, {', '.join(f"round(max(CASE WHEN variable = '{x}' AND rn = 1 THEN value_num END), 6) AS {x}" for x in VARIABLES)} FROM k GROUP BY 1)
SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {x} IS NULL THEN '{x}' END" for x in VARIABLES)}) AS missing FROM w""")
def a9(v: Views):
    return ops.wide_record(v.observations, ["location_id"], VARIABLES, F.expr(NOW))


PROVENANCE_SQL = "source_id || '@' || strftime(coalesce(issued_at, acquired_at), '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(coalesce(issued_at, acquired_at)) % 1000000 <> 0 THEN strftime(coalesce(issued_at, acquired_at), '.%f') ELSE '' END || '+00:00'"


@query("w9_first_evidence", f"""
WITH {GOVERNING}, e AS (SELECT variable, {PROVENANCE_SQL} AS provenance_id, min(obs_id) AS obs_id FROM {{observations}} GROUP BY 1, 2)
SELECT e.*, EXISTS (SELECT 1 FROM gov WHERE gov.obs_id = e.obs_id) AS governs FROM e""")
def w9(v: Views):
    return ops.first_evidence(v.observations, governing(v))


@query("w10_reading_age", f"""
WITH s AS (SELECT *, {SPAN_SQL} AS span FROM {{observations}})
SELECT obs_id, round(date_diff('microsecond', coalesce(issued_at, acquired_at), ADDS(acquired_at; 18000)) // 1000000 / 3600, 6) AS age_h,
       {FRESHNESS_SQL.format(now="ADDS(acquired_at; 18000)")} AS freshness FROM s""")
def w10(v: Views):
    clock = F.timestamp_add("SECOND", F.lit(18000), F.col("acquired_at"))
    return v.observations.select(
        "obs_id", (F.timestamp_diff("SECOND", F.coalesce("issued_at", "acquired_at"), clock) / F.lit(3600.0)).alias("age_h"),
        marine.freshness_grade(clock, "acquired_at", "issued_at", "valid_from", "valid_to").alias("freshness"))


@query("w11_window_bounds", f"""
WITH h AS (SELECT event_id, date_diff('microsecond', {AS_OF_SQL}, ts) // 1000000 / 3600 AS ahead, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 400 - 20 AS INT) END AS hours FROM {{events}})
SELECT event_id, CAST(CASE WHEN ahead < 0 THEN greatest(1, ceil(-ahead) + 1) ELSE 1 END AS INT) AS past_hours,
       CAST(CASE WHEN ahead > 0 THEN greatest(1, ceil(ahead) + 1) ELSE 1 END AS INT) AS future_hours,
       CAST(greatest(1, least(240, coalesce(hours, 24))) AS INT) AS hours FROM h""")
def w11(v: Views):
    bounds = ops.needed_hours(F.col("ts"), F.expr(NOW))
    hours = F.when(F.col("event_id") % 6 != 0, (F.col("event_id") % 400 - 20).cast("int"))
    return v.events.select("event_id", *[c.alias(n) for n, c in bounds.items()], ops.clamp_hours(hours).alias("hours"))


@query("w12_provenance_list", f"""
WITH p AS (SELECT location_id, {PROVENANCE_SQL} AS provenance_id, min(obs_id) AS first_seen FROM {{observations}} GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY first_seen) AS position FROM p""")
def w12(v: Views):
    return ops.provenance_list(v.observations, ["location_id"])


@query("u1_union_of_sources", """
SELECT source_id, variable, count(*) AS n FROM {observations} GROUP BY 1, 2""")
def u1(v: Views):
    one = v.observations.where("source_id = 'incois_osf_wave'").drop("valid_to")
    two = v.observations.where("source_id <> 'incois_osf_wave'")
    return ops.union_readings(one, two).groupBy("source_id", "variable").agg(F.count(F.lit(1)).alias("n"))


EXPECTED = ["imd_geoserver", "incois_osf_wave", "openmeteo_forecast", "openmeteo_marine"]


@query("q3_partial_report", f"""
WITH e AS (SELECT unnest({EXPECTED}) AS s), d AS (SELECT DISTINCT location_id || '/' || CAST(CAST(valid_time AS DATE) AS VARCHAR) AS scan, source_id FROM {{observations}})
SELECT scan, coalesce(string_agg(s, ',' ORDER BY s) FILTER (WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.scan = k.scan AND x.source_id = e.s)), '') AS missing,
       bool_or(NOT EXISTS (SELECT 1 FROM d x WHERE x.scan = k.scan AND x.source_id = e.s)) AS partial
FROM (SELECT DISTINCT scan FROM d) k, e GROUP BY scan""")
def q3(v: Views):
    scan = F.concat(F.col("location_id").cast("string"), F.lit("/"), F.date_format("valid_time", "yyyy-MM-dd"))
    return ops.source_gaps(v.observations.withColumn("scan", scan), ["scan"], EXPECTED)


@query("u6_fallback_chain", """
WITH r AS (SELECT *, CASE source_id WHEN 'incois_osf_winds' THEN 0 WHEN 'imd_geoserver' THEN 1 WHEN 'openmeteo_forecast' THEN 2 END AS p FROM {observations} WHERE location_id >= 0),
w AS (SELECT location_id, CAST(valid_time AS DATE) AS d, min(p) AS p FROM r WHERE value_num IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)
SELECT obs_id, source_id FROM r JOIN w ON r.location_id = w.location_id AND CAST(r.valid_time AS DATE) = w.d AND r.p = w.p""")
def u6(v: Views):
    day = v.observations.withColumn("d", F.to_date("valid_time"))
    return ops.first_valid_source(day, ["location_id", "d"], ["incois_osf_winds", "imd_geoserver", "openmeteo_forecast"]) \
        .select("obs_id", "source_id")


COVERAGE = f"""
    i AS ({dims.rows_sql(dims.SOURCE_CADENCE, 'source_id, resolution, cadence, validity_h')}),
    p AS (SELECT source_id, count(*) AS n, max(coalesce(issued_at, acquired_at)) AS newest FROM {{observations}} GROUP BY 1),
    cov AS (SELECT i.*, coalesce(n, 0) AS n_rows, newest, greatest(0, date_diff('microsecond', newest, TIMESTAMP '2024-01-31 06:00:00') // 1000000 / 3600) AS age_h, n IS NOT NULL AS reachable
            FROM i LEFT JOIN p USING (source_id))"""
LATE = "timestamp_ntz'2024-01-31 06:00:00'"


@query("a10_source_coverage", f"WITH {COVERAGE} SELECT source_id, resolution, cadence, n_rows, newest, reachable, round(CASE WHEN reachable THEN age_h END, 6) AS age_h FROM cov")
def a10(v: Views):
    return ops.source_coverage(v.observations, F.expr(LATE)).select(
        "source_id", "resolution", "cadence", "n_rows", "newest", "reachable", F.when(F.col("reachable"), F.col("age_h")).alias("age_h"))


@query("q4_source_status", f"""
WITH {COVERAGE} SELECT source_id, n_rows, CASE WHEN NOT reachable THEN 'FAIL' WHEN age_h > validity_h AND source_id <> 'incois_osf' THEN 'STALE' ELSE 'OK' END AS status FROM cov""")
def q4(v: Views):
    cov = ops.source_coverage(v.observations, F.expr(LATE))
    return ops.source_status(cov, ~F.col("reachable"), F.col("source_id") == "incois_osf").select("source_id", "n_rows", "status")


@query("a11_field_summary", """
SELECT slice, round(avg(value), 4) AS mean_value, round(min(value), 4) AS min_value, round(max(value), 4) AS max_value,
       round(count(*) / 2000, 6) AS coverage FROM {grid_cells} GROUP BY slice""")
def a11(v: Views):
    from pelagia.operators.grid import field_summary
    return field_summary(v.grid_cells, ["slice"], 2000)


@query("a14_percentile", """
SELECT event_type, round(quantile_cont(value, 0.85), 6) AS threshold FROM {events} GROUP BY event_type""")
def a14(v: Views):
    return exact_percentile(v.events, ["event_type"], "value", 0.85)


@query("a13_worst_level", """
WITH r AS (SELECT user_id % 50 AS loc, CASE WHEN value > 95 THEN 2 WHEN value > 90 THEN 1 ELSE 0 END AS lvl FROM {events})
SELECT k.loc, CAST(coalesce(max(r.lvl), 2) AS INT) AS worst_rank FROM (SELECT DISTINCT user_id % 60 AS loc FROM {events}) k LEFT JOIN r USING (loc) GROUP BY 1""")
def a13(v: Views):
    rows = v.events.select((F.col("user_id") % 50).alias("loc"), F.when(
        F.col("value") > 95, 2).when(F.col("value") > 90, 1).otherwise(0).alias("lvl"))
    return reports.worst_level(rows, ["loc"], "lvl", v.events.select((F.col("user_id") % 60).alias("loc")).distinct(), 2)


@query("u5_ordered_distinct", """
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM {documents}),
f AS (SELECT doc_id, word, min(pos) AS pos FROM w WHERE trim(word, ' ') <> '' GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_words, md5(string_agg(word, ' ' ORDER BY pos)) AS digest FROM f GROUP BY 1""")
def u5(v: Views):
    words = F.array_distinct(F.filter(F.split("text", " "), lambda w: F.trim(w) != ""))
    return v.documents.select("doc_id", words.alias("w")).where(F.size("w") > 0).select(
        "doc_id", F.size("w").cast("bigint").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))
