"""Marine views derived from the given tables, written once as SQL for both engines.

Whole numbers are combined first and divided last, so both engines compute the same
doubles. ``Views`` builds the Spark side lazily; ``with_clause`` renders the same view
as common table expressions for the checking engine.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

AS_OF = "2024-01-16 00:00:00"
#: Rows of a table in one task of :meth:`Views.spread`, at most.
ROWS_PER_TASK = 500_000

#: Macros: ADDS(ts, n) adds n seconds; IDIV(a, b) is whole division of non-negative numbers.
_SPARK_MACROS = {"ADDS": "timestampadd(SECOND, {1}, {0})", "IDIV": "CAST(({0}) div ({1}) AS INT)",
                 "TS": "timestamp_ntz'{0}'", "HOUR_OF": "CAST(date_trunc('HOUR', {0}) AS TIMESTAMP_NTZ)",
                 "DAY_OF": "CAST(date_trunc('DAY', {0}) AS TIMESTAMP_NTZ)", "LEN": "char_length({0})"}
_CHECK_MACROS = {"ADDS": "({0} + to_seconds(CAST({1} AS BIGINT)))", "IDIV": "CAST(({0}) // ({1}) AS INT)",
                 "TS": "TIMESTAMP '{0}'", "HOUR_OF": "date_trunc('hour', {0})",
                 "DAY_OF": "CAST(date_trunc('day', {0}) AS TIMESTAMP)", "LEN": "length({0})"}

VIEWS: dict[str, str] = {
    "positions": """
        SELECT event_id, user_id AS vessel_id, ts,
               8 + ((user_id * 37) % 290) / 100 + ((event_id * 7) % 50) / 1000 AS lat,
               78 + ((user_id * 53) % 260) / 100 + ((event_id * 11) % 50) / 1000 AS lon,
               CAST((event_id * 37) % 360 AS DOUBLE) AS heading_deg,
               ((event_id * 13) % 120) / 10 AS speed_kn
        FROM {events}""",
    "fences": """
        SELECT CAST(n_nationkey AS INT) AS fkey, n_name AS name,
               CASE n_regionkey WHEN 0 THEN 'IMBL_HISTORIC_WATERS' WHEN 1 THEN 'IMBL_MARITIME_BOUNDARY'
                    WHEN 2 THEN 'MPA' WHEN 3 THEN 'ECO_SENSITIVE' ELSE 'HAZARD_EXCLUSION' END AS layer,
               n_regionkey IN (2, 3) AS is_polygon,
               (782 + (n_nationkey % 5) * 5) / 10 AS x0,
               (82 + IDIV(n_nationkey; 5) * 5) / 10 AS y0,
               CASE WHEN n_nationkey % 7 = 0 THEN 3 / 1 END AS own_warn_nm,
               CASE WHEN n_nationkey % 7 = 0 THEN 1 / 1 END AS own_critical_nm
        FROM {nation}""",
    "fence_segments": """
        SELECT layer, fkey, 0 AS part, 0 AS ring, s.seq AS seq,
               CASE WHEN NOT is_polygon THEN x0 ELSE x0 + s.ax / 10 END AS x1,
               CASE WHEN NOT is_polygon THEN y0 ELSE y0 + s.ay / 10 END AS y1,
               CASE WHEN NOT is_polygon THEN x0 + 3 / 10 ELSE x0 + s.zx / 10 END AS x2,
               CASE WHEN NOT is_polygon THEN y0 + 15 / 100 ELSE y0 + s.zy / 10 END AS y2,
               is_polygon
        FROM {fences} JOIN (VALUES (TRUE, 0, 0, 0, 2, 0), (TRUE, 1, 2, 0, 2, 2), (TRUE, 2, 2, 2, 0, 2), (TRUE, 3, 0, 2, 0, 0),
             (FALSE, 0, 0, 0, 0, 0)) AS s(poly, seq, ax, ay, zx, zy) ON s.poly = is_polygon""",
    "ports": """
        SELECT s_suppkey AS port_id, s_name AS name, n_name AS district, n_regionkey AS zone,
               8 + ((s_suppkey * 53) % 290) / 100 AS lat, 78 + ((s_suppkey * 71) % 260) / 100 AS lon
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "requests": """
        SELECT c_custkey AS request_id,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'fibreglass_catamaran' WHEN 'MACHINERY' THEN 'mechanised_trawler'
                    WHEN 'HOUSEHOLD' THEN 'mechanised_trawler' ELSE 'small_motorised' END AS vessel_class,
               8 + ((c_custkey * 53) % 290) / 100 + 3 / 1000 AS lat,
               78 + ((c_custkey * 71) % 260) / 100 + 4 / 1000 AS lon,
               ADDS(TS(2024-01-16 00:00:00); (c_custkey * 7919) % 86400) AS as_of,
               n_name AS district
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "observations": """
        SELECT event_id AS obs_id, user_id % 50 AS location_id, ts AS valid_time,
               CASE event_type WHEN 'view' THEN 'wind_speed' WHEN 'click' THEN 'significant_wave_height'
                    WHEN 'purchase' THEN 'wave_period' WHEN 'signup' THEN 'wind_gust' ELSE 'visibility' END AS variable,
               CASE event_type
                    WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'imd_geoserver' WHEN 1 THEN 'openmeteo_forecast' ELSE 'incois_osf_winds' END
                    WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'incois_osf_wave' WHEN 1 THEN 'openmeteo_marine' ELSE 'incois_osf' END
                    WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'incois_osf_wave' WHEN 1 THEN 'openmeteo_marine' ELSE 'incois_osf' END
                    WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'openmeteo_forecast' ELSE 'other_model' END
                    ELSE CASE event_id % 3 WHEN 0 THEN 'openmeteo_forecast' ELSE 'other_model' END END AS source_id,
               CASE WHEN event_id % 41 = 0 THEN NULL ELSE
               CASE event_type WHEN 'view' THEN CAST((event_id * 17) % 4000 AS DOUBLE) / 100
                    WHEN 'click' THEN CAST((event_id * 17) % 450 AS DOUBLE) / 100
                    WHEN 'purchase' THEN 3 + CAST((event_id * 17) % 150 AS DOUBLE) / 10
                    WHEN 'signup' THEN CAST((event_id * 17) % 4500 AS DOUBLE) / 100
                    ELSE CAST((event_id * 17) % 9000 AS DOUBLE) END END AS value_num,
               CASE event_type WHEN 'view' THEN 'kn' WHEN 'click' THEN 'm' WHEN 'purchase' THEN 's'
                    WHEN 'signup' THEN 'kn' ELSE 'm' END AS unit,
               8 + ((user_id * 37) % 290) / 100 AS lat, 78 + ((user_id * 53) % 260) / 100 AS lon,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE ADDS(ts; -3600) END AS issued_at,
               ts AS acquired_at, ADDS(ts; -3600) AS valid_from,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE ADDS(ts; 21600 + (event_id % 11) * 3600) END AS valid_to
        FROM {events}""",
    "grid_cells": """
        SELECT slice, i, j, (800 + i * 7) / 100 AS lat, (7800 + j * 5) / 100 AS lon,
               20 + sum(l_quantity) / count(*) / 3 AS value, sum(l_quantity) / count(*) / 25 AS chl
        FROM (SELECT l_returnflag AS slice, CAST(l_orderkey % 40 AS INT) AS i,
                     CAST((l_partkey * 7 + l_suppkey) % 50 AS INT) AS j, l_quantity FROM {lineitem}) AS c
        GROUP BY slice, i, j""",
    "cost_inputs": """
        SELECT i, j, (800 + i * 7) / 100 AS lat, (7800 + j * 5) / 100 AS lon,
               CASE WHEN (i * 7 + j * 3) % 23 <> 0 THEN sum(l_quantity) / count(*) / 15 END AS hs,
               CAST(sum(l_linenumber) AS BIGINT) * 61 / (count(*) * 10) AS wind, CAST(4 + CAST(sum(l_orderkey) AS BIGINT) % 9 AS DOUBLE) AS period,
               CASE WHEN (i + j) % 29 <> 0 THEN ((i * 31 + j * 17) % 200) / 10 END AS depth,
               (CAST(sum(l_partkey) AS BIGINT) + i) % 23 = 0 AS land, i BETWEEN 15 AND 18 AND j BETWEEN 20 AND 26 AS exclusion,
               (CAST(sum(l_suppkey) AS BIGINT) % 30) / 10 AS current_kn, CAST((CAST(sum(l_suppkey) AS BIGINT) * 7) % 360 AS DOUBLE) AS current_to
        FROM (SELECT CAST(l_orderkey % 40 AS INT) AS i, CAST((l_partkey * 7 + l_suppkey) % 50 AS INT) AS j,
                     l_quantity, l_linenumber, l_orderkey, l_partkey, l_suppkey FROM {lineitem}) AS c
        GROUP BY i, j""",
    "routes": """
        SELECT s_suppkey AS route_id, 8 + ((s_suppkey * 53) % 270) / 100 AS olat, 78 + ((s_suppkey * 71) % 245) / 100 AS olon,
               8 + ((s_suppkey * 29 + 70) % 270) / 100 AS dlat, 78 + ((s_suppkey * 31 + 120) % 245) / 100 AS dlon
        FROM {supplier}""",
    "bulletins": """
        SELECT o_orderkey AS bulletin_id, o_custkey % 25 AS block_id,
               CASE o_orderkey % 10 WHEN 0 THEN 'SMOOTH' WHEN 1 THEN 'SLIGHT' WHEN 2 THEN 'MODERATE' WHEN 3 THEN 'ROUGH'
                    WHEN 4 THEN 'VERY  ROUGH' WHEN 5 THEN 'CALM (RIPPLED)' WHEN 6 THEN 'slight' WHEN 7 THEN 'HIGH'
                    WHEN 8 THEN 'Smooth' ELSE 'UNREADABLE' END || ' TO ' ||
               CASE (o_orderkey * 3) % 10 WHEN 0 THEN 'SLIGHT' WHEN 1 THEN 'MODERATE BECOMING ROUGH IN GUST' WHEN 2 THEN 'SMOOTH'
                    WHEN 3 THEN 'VERY ROUGH' WHEN 4 THEN 'SLIGHT' WHEN 5 THEN 'SMOOTH' WHEN 6 THEN 'VERY HIGH'
                    WHEN 7 THEN 'MODERATE' WHEN 8 THEN 'PHENOMENAL' ELSE 'HIGHLY VARIABLE' END AS sea_condition,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'SIGNAL NO. III' WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN NULL
                    WHEN '4-NOT SPECIFIED' THEN 'NIL' ELSE 'No Signal' END AS port_signal,
               CASE WHEN o_orderkey % 3 = 0 THEN 'High waves along ' || CASE IDIV(o_orderkey; 6) % 5 WHEN 0 THEN 'RAMANATHAPURAM district' WHEN 1 THEN 'Thoothukkudi coast'
                    WHEN 2 THEN 'Nagai, Thanjavur' WHEN 3 THEN 'Tirunelvelli' ELSE 'Puducherry' END
                    WHEN o_orderkey % 3 = 1 THEN 'NIL' END AS storm_surge_warning,
               CASE o_custkey % 6 WHEN 0 THEN 'Ramanathapuram' WHEN 1 THEN 'Pudukkottai' WHEN 2 THEN 'Thanjavur' WHEN 3 THEN 'Nagapattinam'
                    WHEN 4 THEN 'Thoothukudi' ELSE 'Tirunelveli' END AS district,
               CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderdate END AS valid_from,
               CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE ADDS(o_orderdate; 43200) END AS valid_to,
               ADDS(o_orderdate; ((o_orderkey * 5) % 24) * 3600) AS target_time,
               ADDS(o_orderdate; ((o_orderkey * 7) % 30) * 3600) AS as_of,
               CASE o_custkey % 3 WHEN 0 THEN 'small_motorised' WHEN 1 THEN 'fibreglass_catamaran' ELSE 'mechanised_trawler' END AS vessel_class,
               CAST((o_orderkey * 11) % 20 AS DOUBLE) AS swell_period_s
        FROM {orders}""",
    "questions": """
        SELECT conv_id, turn, CASE (conv_id + turn) % 14 WHEN 0 THEN 'Is it safe to go out tomorrow morning at 04:30? '
            WHEN 1 THEN 'What if I leave at 04:00 instead of 06.15 today ' WHEN 2 THEN 'கடலுக்கு போகலாமா நாளை ' WHEN 3 THEN 'Where are the fish? list the fishing zone '
            WHEN 4 THEN 'naalai kadal epadi irukkum ' WHEN 5 THEN 'Which boats are near the boundary line or the IMBL? '
            WHEN 6 THEN 'Show cyclone warning and storm surge, tonight ' WHEN 7 THEN 'why has productivity declined over the years '
            WHEN 8 THEN 'dariya machhi kale kem ' WHEN 9 THEN 'nearest port or landing centre this evening ' WHEN 10 THEN 'समुद्र में मौसम ' 
            WHEN 11 THEN 'should I avoid the no-go area near the marine national park at 9:05 and 23:59 ' WHEN 12 THEN 'chlorophyll and sst front now ' ELSE '' END || text AS text
        FROM {conversations} WHERE role = 'user'""",
    "trace_steps": """
        SELECT CAST(conv_id AS VARCHAR(20)) AS query_id,
               CAST(conv_id AS VARCHAR(20)) || '-' || CAST(turn AS VARCHAR(20)) AS step_id,
               CASE WHEN turn > 0 THEN CAST(conv_id AS VARCHAR(20)) || '-' || CAST(turn - 1 AS VARCHAR(20)) END AS parent_id,
               turn,
               CASE WHEN turn = 0 THEN 'plan' WHEN turn % 5 = 4 THEN 'ceiling' WHEN role = 'user' THEN 'tool_call'
                    WHEN role = 'assistant' THEN 'tool_result' ELSE 'synthesis' END AS kind,
               CASE WHEN role = 'assistant' THEN CASE WHEN turn % 3 = 1 THEN 'evaluate_verdict' ELSE 'get_weather' END END AS tool,
               role AS agent,
               CAST(LEN(text) AS DOUBLE) AS duration_ms,
               ADDS(TS(2024-01-01 00:00:00); conv_id * 600 + turn * 7) AS ts,
               NOT (LEN(text) % 17 = 0) AS ok,
               CASE WHEN turn = 0 THEN text END AS question,
               CASE WHEN turn = 0 THEN 'console' END AS surface,
               CASE WHEN turn % 5 = 4 AND turn % 2 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'GO' ELSE 'DO_NOT_ADVISE' END END AS level,
               CASE WHEN role = 'assistant' THEN 'Verdict: ' || CASE WHEN conv_id % 4 = 0 THEN 'GO_WITH_CAUTION. ' WHEN conv_id % 4 = 1 THEN 'GO because ' ELSE 'MAYBE ' END || text END AS result_digest
        FROM {conversations}""",
    "cyclones": """
        SELECT o_custkey AS event_id, o_orderkey AS episode_id, o_orderstatus = 'O' AS is_current,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Red' WHEN '2-HIGH' THEN 'Orange' ELSE 'Green' END AS alert_level,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE -10 + ((o_orderkey * 37) % 3000) / 100 END AS lat,
               70 + ((o_orderkey * 53) % 2000) / 100 AS lon, o_orderdate AS from_date
        FROM {orders}""",
    "snapshots": """
        SELECT CASE event_type WHEN 'view' THEN 'openmeteo_forecast' WHEN 'click' THEN 'incois_wfs' ELSE 'imd_geoserver' END AS source_id,
               'key-' || CAST(user_id AS VARCHAR(20)) AS key, ts AS fetched_at, event_id AS seq, props AS payload
        FROM {events}""",
    "features": """
        SELECT CASE p_size % 4 WHEN 0 THEN 'mpa' WHEN 1 THEN 'eco_coral' WHEN 2 THEN 'bathymetry' ELSE 'pfz' END AS layer_id,
               p_brand || '-' || CAST(p_size AS VARCHAR(5)) AS feature_key, p_name AS name, p_type AS kind, p_partkey AS seq,
               'source_' || CAST(p_partkey % 3 AS VARCHAR(3)) AS source_id,
               ADDS(TS(2024-01-01 00:00:00); (p_partkey * 37) % 100000) AS acquired_at,
               78 + ((p_partkey * 53) % 260) / 100 AS minx, 8 + ((p_partkey * 37) % 290) / 100 AS miny,
               78 + ((p_partkey * 53) % 260) / 100 + (p_size % 10) / 10 AS maxx,
               8 + ((p_partkey * 37) % 290) / 100 + (p_size % 7) / 10 AS maxy
        FROM {part}""",
}


def _expand(sql: str, macros: dict[str, str]) -> str:
    """Expand the macros; arguments are separated by ';'."""
    while True:
        found = re.search(r"\b(ADDS|IDIV|TS|HOUR_OF|DAY_OF|LEN)\(", sql)
        if not found:
            return sql
        depth, end, parts, start = 1, found.end(), [], found.end()
        while depth:
            ch = sql[end]
            depth += ch == "("
            depth -= ch == ")"
            if depth == 1 and ch == ";":
                parts.append(sql[start:end])
                start = end + 1
            end += 1
        parts.append(sql[start:end - 1])
        sql = sql[:found.start()] + macros[found.group(1)].format(*[p.strip() for p in parts]) + sql[end:]


def needed(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n in VIEWS or n in TABLES]


def _plain(sql: str) -> str:
    for name in needed(sql):
        sql = sql.replace("{" + name + "}", name)
    return sql


def spark_sql(spark: SparkSession, sql: str, views: "Views") -> DataFrame:
    return spark.sql(_expand(sql, _SPARK_MACROS), **{n: getattr(views, n) for n in needed(sql)})


def with_clause(sql: str) -> str:
    """The checking SQL with the views it names in front, as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in needed(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    body = _plain(_expand(sql, _CHECK_MACROS)).strip()
    ctes = ",\n".join(
        f"{n} AS MATERIALIZED (" + _plain(_expand(VIEWS[n], _CHECK_MACROS)) + ")" for n in order)
    if not ctes:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Views:
    """Lazily built DataFrames: the given tables and the views above."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES or name in VIEWS:
            if name not in self._built:
                self._built[name] = (
                    self.spark.read.parquet(f"{self.folder}/{name}.parquet") if name in TABLES
                    else spark_sql(self.spark, VIEWS[name], self))
            return self._built[name]
        raise AttributeError(name)

    def spread(self, df: DataFrame) -> DataFrame:
        """Spread the rows of a table over the cores before heavy per-row work, in tasks that do not grow with the table."""
        rows, most, filled = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count"), F.count(F.lit(1))).first()
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-(rows or 0) // ROWS_PER_TASK))
        # Counted, as a file of few row groups is cut into more splits than hold rows.
        return df.repartition(tasks) if filled < tasks or most > ROWS_PER_TASK else df

    def sql(self, text: str) -> DataFrame:
        return spark_sql(self.spark, text, self)
