"""Rule tables as small DataFrames built from literals, so their size is fixed and known.

``rows_sql`` renders a table as a VALUES relation; doubles are written in exponent form
so they are doubles, not decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# ---- fixed values -----------------------------------------------------------------

#: level, rank
VERDICT_LEVELS = (("GO", 0), ("GO_WITH_CAUTION", 1), ("DO_NOT_ADVISE", 2))

#: level, rank
ALERT_LEVELS = (("INFO", 0), ("WARN", 1), ("CRITICAL", 2), ("BREACH", 3))

#: severity, rank
SEVERITIES = (("advisory", 0), ("restricted", 1), ("hazard", 2), ("legal_hard", 3))

#: class, order, severity, warn nm, critical nm, colour, title
FENCE_CLASSES = (
    ("IMBL_HISTORIC_WATERS", 0, "legal_hard", 2.0, 0.5, "#d32029", "1974 India-Sri Lanka historic waters boundary"),
    ("IMBL_MARITIME_BOUNDARY", 1, "legal_hard", 2.0, 0.5, "#f5222d", "1976 India-Sri Lanka maritime boundary"),
    ("MPA", 2, "restricted", 1.0, 0.25, "#fa8c16", "Marine National Park"),
    ("ECO_SENSITIVE", 3, "advisory", 0.5, 0.1, "#52c41a", "Ecologically sensitive habitat"),
    ("USER_DEFINED", 4, "advisory", 1.0, 0.25, "#722ed1", "Operational boundary"),
    ("HAZARD_EXCLUSION", 5, "hazard", 5.0, 2.0, "#eb2f96", "Hazard exclusion zone"),
)

#: alias, class
CLASS_ALIASES = (
    ("IMBL", "IMBL_HISTORIC_WATERS"),
    ("IMBL", "IMBL_MARITIME_BOUNDARY"),
) + tuple((row[0], row[0]) for row in FENCE_CLASSES)

#: class, level, English copy
ALERT_COPY = (
    ("IMBL_HISTORIC_WATERS", "WARN", "You are {distance} nm from the 1974 India-Sri Lanka historic waters boundary, closing in about {eta}. Crossing it risks arrest and seizure of your boat. Alter course now."),
    ("IMBL_HISTORIC_WATERS", "CRITICAL", "CRITICAL: {distance} nm from the 1974 historic waters boundary. Turn back immediately. If detained, contact Coast Guard 1554."),
    ("IMBL_HISTORIC_WATERS", "BREACH", "BREACH: you have crossed the 1974 historic waters boundary. Return to Indian waters on a reciprocal course and call Coast Guard 1554."),
    ("IMBL_MARITIME_BOUNDARY", "WARN", "You are {distance} nm from the 1976 India-Sri Lanka maritime boundary, closing in about {eta}. Beyond it you are in Sri Lankan waters. Alter course."),
    ("IMBL_MARITIME_BOUNDARY", "CRITICAL", "CRITICAL: {distance} nm from the 1976 maritime boundary. Turn back immediately."),
    ("IMBL_MARITIME_BOUNDARY", "BREACH", "BREACH: you have crossed the 1976 maritime boundary into Sri Lankan waters. Return west immediately and call Coast Guard 1554."),
    ("MPA", "WARN", "{name} boundary is {distance} nm ahead. Fishing gear restrictions apply inside — this is a conservation area, not a national border."),
    ("MPA", "CRITICAL", "You are at the edge of {name}. Trawling and anchoring are prohibited inside."),
    ("MPA", "BREACH", "You are inside {name}. Haul gear and leave the protected area."),
    ("ECO_SENSITIVE", "WARN", "{name} is {distance} nm ahead. Avoid anchoring and bottom trawling over it."),
    ("ECO_SENSITIVE", "CRITICAL", "You are over {name}. Do not anchor here."),
    ("ECO_SENSITIVE", "BREACH", "You are over {name}. Anchoring or trawling here damages habitat that fish stocks depend on."),
    ("USER_DEFINED", "WARN", "{name} is {distance} nm ahead."),
    ("USER_DEFINED", "CRITICAL", "You are at the edge of {name}."),
    ("USER_DEFINED", "BREACH", "You have entered {name}."),
    ("HAZARD_EXCLUSION", "WARN", "{name} is {distance} nm ahead on your course, about {eta} away. Do not enter."),
    ("HAZARD_EXCLUSION", "CRITICAL", "CRITICAL: {name} is {distance} nm ahead. Alter course away now."),
    ("HAZARD_EXCLUSION", "BREACH", "You are inside {name}. Make for the nearest safe harbour."),
)

#: band, descriptor, low metres, high metres
DOUGLAS = (
    (0, "CALM (GLASSY)", 0.0, 0.0),
    (1, "CALM (RIPPLED)", 0.0, 0.1),
    (2, "SMOOTH", 0.1, 0.5),
    (3, "SLIGHT", 0.5, 1.25),
    (4, "MODERATE", 1.25, 2.5),
    (5, "ROUGH", 2.5, 4.0),
    (6, "VERY ROUGH", 4.0, 6.0),
    (7, "HIGH", 6.0, 9.0),
    (8, "VERY HIGH", 9.0, 14.0),
    (9, "PHENOMENAL", 14.0, 99.0),
)

#: phrase, band — longest phrases first, so a part of a longer phrase is not read again
SEA_PHRASES = (
    ("CALM (RIPPLED)", 1), ("CALM (GLASSY)", 0), ("CALM RIPPLED", 1), ("CALM GLASSY", 0),
    ("PHENOMENAL", 9), ("VERY ROUGH", 6), ("VERY HIGH", 8), ("MODERATE", 4), ("RIPPLED", 1),
    ("GLASSY", 0), ("SMOOTH", 2), ("SLIGHT", 3), ("ROUGH", 5), ("HIGH", 7), ("CALM", 1),
)
ESCALATION_MARKERS = ("BECOMING", "GUST", "SQUALL", "AT TIMES", "OCCASIONALLY", "TEMPORARILY")

#: class, cruise kn, max kn, minimum depth m, Hs go, Hs caution, wind go, wind caution,
#: gust caution, steepness caution, visibility caution m, long-period swell s
VESSEL_CLASSES = (
    ("small_motorised", 7.0, 12.0, 1.2, 1.25, 2.5, 15.0, 22.0, 28.0, 0.045, 2000.0, 15.0),
    ("fibreglass_catamaran", 5.0, 8.0, 0.8, 0.75, 1.25, 12.0, 18.0, 22.0, 0.040, 2000.0, 15.0),
    ("mechanised_trawler", 9.0, 14.0, 2.5, 2.5, 4.0, 22.0, 30.0, 38.0, 0.055, 1000.0, 15.0),
)
DEFAULT_VESSEL_CLASS = "small_motorised"

#: class, band, most permissive verdict rank
VESSEL_BANDS = (
    ("small_motorised", 2, 0), ("small_motorised", 3, 0), ("small_motorised", 4, 1),
    ("small_motorised", 5, 2), ("small_motorised", 6, 2), ("small_motorised", 7, 2),
    ("small_motorised", 8, 2), ("small_motorised", 9, 2),
    ("fibreglass_catamaran", 2, 0), ("fibreglass_catamaran", 3, 1), ("fibreglass_catamaran", 4, 2),
    ("fibreglass_catamaran", 5, 2), ("fibreglass_catamaran", 6, 2), ("fibreglass_catamaran", 7, 2),
    ("fibreglass_catamaran", 8, 2), ("fibreglass_catamaran", 9, 2),
    ("mechanised_trawler", 2, 0), ("mechanised_trawler", 3, 0), ("mechanised_trawler", 4, 0),
    ("mechanised_trawler", 5, 1), ("mechanised_trawler", 6, 2), ("mechanised_trawler", 7, 2),
    ("mechanised_trawler", 8, 2), ("mechanised_trawler", 9, 2),
)

#: variable, source id prefix, order
GOVERNING_ORDER = (
    ("significant_wave_height", "incois_osf_wave", 0), ("significant_wave_height", "incois_osf", 1),
    ("significant_wave_height", "openmeteo_marine", 2),
    ("swell_wave_height", "incois_osf_wave", 0), ("swell_wave_height", "incois_osf", 1),
    ("swell_wave_height", "openmeteo_marine", 2),
    ("wave_period", "incois_osf_wave", 0), ("wave_period", "incois_osf", 1), ("wave_period", "openmeteo_marine", 2),
    ("swell_wave_period", "incois_osf_wave", 0), ("swell_wave_period", "incois_osf", 1),
    ("swell_wave_period", "openmeteo_marine", 2),
    ("max_wave_height", "incois_osf_mwh", 0), ("max_wave_height", "incois_osf", 1),
    ("wind_speed", "imd_geoserver", 0), ("wind_speed", "openmeteo_forecast", 1), ("wind_speed", "incois_osf_winds", 2),
    ("wind_gust", "openmeteo_forecast", 0),
    ("current_speed", "incois_osf_currents", 0), ("current_speed", "openmeteo_marine", 1),
    ("visibility", "openmeteo_forecast", 0),
)

#: raw unit, unit, factor
UNITS = (("km/h", "m/s", 1 / 3.6), ("km/h", "kn", 1 / 1.852), ("m/s", "kn", 1.9438444924406))

#: raw variable, variable, raw unit, unit, factor (hourly JSON)
HOURLY_VARIABLES = (
    ("wave_height", "significant_wave_height", "m", "m", 1.0),
    ("wave_period", "wave_period", "s", "s", 1.0),
    ("ocean_current_velocity", "current_speed", "km/h", "m/s", 1 / 3.6),
    ("wind_speed_10m", "wind_speed", "km/h", "kn", 1 / 1.852),
    ("wind_gusts_10m", "wind_gust", "km/h", "kn", 1 / 1.852),
    ("visibility", "visibility", "m", "m", 1.0),
    ("wind_wave_height", "wind_wave_height", "m", "m", 1.0),
    ("swell_wave_height", "swell_wave_height", "m", "m", 1.0),
    ("swell_wave_period", "swell_wave_period", "s", "s", 1.0),
    ("wave_direction", "wave_direction", "deg", "deg", 1.0),
    ("sea_level_height_msl", "sea_level", "m", "m", 1.0),
    ("ocean_current_direction", "current_direction", "deg", "deg", 1.0),
    ("sea_surface_temperature", "sea_surface_temperature", "degC", "degC", 1.0),
    ("wind_direction_10m", "wind_direction", "deg", "deg", 1.0),
    ("precipitation", "precipitation", "mm", "mm", 1.0),
    ("cape", "cape", "J/kg", "J/kg", 1.0),
    ("temperature_2m", "air_temperature", "degC", "degC", 1.0),
    ("pressure_msl", "pressure", "hPa", "hPa", 1.0),
    ("cloud_cover", "cloud_cover", "%", "%", 1.0),
)

#: station field, variable, unit, factor
STATION_VARIABLES = (
    ("temp", "temperature", "degC", 1.0), ("windspeed", "wind_speed", "kn", 1 / 1.852),
    ("winddir", "wind_direction", "deg", 1.0), ("rh", "humidity", "%", 1.0),
    ("mslp", "pressure", "hPa", 1.0), ("rainfall", "rainfall", "mm", 1.0),
)

#: nowcast colour code, label
WARNING_COLOURS = ((1, "green"), (2, "yellow"), (3, "orange"), (4, "red"))

#: bulletin row label, field
BULLETIN_FIELDS = (
    ("wind", "wind"), ("weather", "weather"), ("visibility", "visibility"),
    ("sea condition", "sea_condition"), ("port signal", "port_signal"),
    ("storm surge/tidal warning", "storm_surge_warning"),
)

#: source, resolution, cadence, validity hours
SOURCE_CADENCE = (
    ("imd_coastal_bulletin", "coast block", "re-issued periodically, valid 12 h", 12.0),
    ("imd_geoserver", "district / station", "each row carries its own issue and expiry time", 3.0),
    ("incois_wfs", "vector", "daily advisory lines, near-static layers", 24.0),
    ("incois_osf", "coastal nest", "56 steps of 3 h, about 2 days publication lag", 72.0),
    ("incois_osf_wave", "coastal nest", "56 steps of 3 h, about 2 days publication lag", 72.0),
    ("incois_argo", "1 degree", "10-day gridded analysis", 360.0),
    ("openmeteo_marine", "28 km", "hourly global forecast", 6.0),
    ("openmeteo_forecast", "11 km", "hourly atmospheric forecast", 6.0),
    ("gdacs_tc", "event", "event driven", 6.0),
    ("marine_regions_imbl", "vector", "static reference", 8760.0),
)

#: term, weight / limit (routing)
ROUTE_WEIGHTS = {"base": 1.0, "hs": 4.0, "wind": 2.0, "current": 1.5, "shallow": 3.0, "steep": 5.0, "imbl": 6.0}
ROUTE_NORMALISERS = {"hs_max_m": 4.0, "wind_max_kn": 40.0, "current_max_kn": 3.0, "steepness_max": 0.08}
ROUTE_SOFT_NM, ROUTE_HARD_NM = 3.0, 0.3
ROUTE_SAFETY_FACTOR, ROUTE_RAMP_M = 2.0, 5.0
ROUTE_GRID_DEG = 0.01

#: minimum lon, minimum lat, maximum lon, maximum lat
REGION_BBOX = (78.0, 8.0, 80.6, 10.9)
REGION_ZONE = "Asia/Kolkata"
REGION_ZONE_LABEL = "IST"
#: name, lat, lon, district
ANCHOR_PORTS = (
    ("Rameswaram", 9.2876, 79.3129, "Ramanathapuram"),
    ("Nagapattinam", 10.7660, 79.8450, "Nagapattinam"),
    ("Tuticorin", 8.7642, 78.1348, "Thoothukudi"),
)
FISHING_GROUNDS = (
    ("Palk Bay grounds north of Pamban", 9.52, 79.36),
    ("Gulf of Mannar grounds south of Rameswaram", 8.98, 79.12),
)
DISTRICTS = ("Ramanathapuram", "Pudukkottai", "Thanjavur", "Nagapattinam", "Thoothukudi", "Tirunelveli")
COAST_GUARD = ("Indian Coast Guard — Maritime Rescue", "coast_guard", "1554", "Maritime distress", "Ch 16")

#: variable, panel category
EVIDENCE_CATEGORIES = (
    ("significant_wave_height", "sea"), ("swell_wave_height", "sea"), ("wave_period", "sea"),
    ("swell_wave_period", "sea"), ("max_wave_height", "sea"), ("wave_steepness", "sea"), ("current_speed", "sea"),
    ("wind_speed", "wind"), ("wind_gust", "wind"), ("wind_direction", "wind"),
    ("visibility", "weather"), ("precipitation", "weather"), ("temperature", "weather"),
)

# ---- rendering --------------------------------------------------------------------


def _literal(value, quote: str = "''") -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        text = repr(value)
        return text if "e" in text else text + "E0"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", quote) + "'"


def rows_sql(rows, columns: str, quote: str = "''") -> str:
    """``SELECT`` over a VALUES relation; the same text runs on any SQL engine."""
    body = ", ".join("(" + ", ".join(_literal(v, quote) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def table(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A rule table; it is made of literals, so broadcasting it is always safe."""
    return F.broadcast(spark.sql(rows_sql(rows, columns, "\\'")))


def vessel_classes(spark: SparkSession) -> DataFrame:
    return table(spark, VESSEL_CLASSES, VESSEL_COLUMNS)


VESSEL_COLUMNS = ("vessel_class, cruise_kn, max_kn, min_depth_m, hs_go, hs_caution, wind_go, wind_caution, "
                  "gust_caution, steepness_caution, visibility_caution, long_swell_s")
FENCE_COLUMNS = "fence_class, class_order, severity, warn_nm, critical_nm, colour, title"


def fence_classes(spark: SparkSession) -> DataFrame:
    """Every fence class with the rank of its severity: one literal relation, which a join sends to its tasks."""
    ranks = dict(SEVERITIES)
    return table(spark, [(*r, ranks[r[2]]) for r in FENCE_CLASSES], f"{FENCE_COLUMNS}, severity_rank")


def vessel_limits(spark: SparkSession) -> DataFrame:
    """One row per class and checked variable: go / caution limits and direction."""
    rows = []
    for (name, _, _, _, hs_go, hs_c, w_go, w_c, gust_c, steep, vis, _) in VESSEL_CLASSES:
        rows += [(name, "significant_wave_height", hs_go, hs_c, True, 0), (name, "wind_speed", w_go, w_c, True, 1),
                 (name, "wind_gust", w_c, gust_c, True, 2), (name, "wave_steepness", steep, steep * 1.4, True, 3),
                 (name, "visibility", vis, None, False, 4)]
    return table(spark, rows, "vessel_class, variable, go_limit, caution_limit, higher_is_worse, check_order")
