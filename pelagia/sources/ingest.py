"""Bulk ingest of landed raw rows: JSON, GeoJSON, CSV, listings, HTML, JSON lines; keyed sinks.

Each reader takes a DataFrame of raw text (``spark.read.text`` or a landing table), so the
work is split over the rows and nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pelagia import dims
from pelagia.functions import geo
from pelagia.functions.geo import _col
from pelagia.operators.filters import numeric_or_null
from pelagia.plans.ordered import EPOCH
from pelagia.session import shared_folder

# Fixed values.
VALIDITY = (r"(?i)Valid\s+for\s+(\d+)\s+hrs\s+from\s+(\d{1,2})\s+UTC\s+of\s+(\d{4}-\d{2}-\d{2})"
            r"\s*to\s*(\d{1,2})\s+UTC\s+of\s+(\d{4}-\d{2}-\d{2})")
STANDARD_FILE = r'name="([A-Za-z_]+)_(\d{8})\.nc"'
COMPOSITE_FILE = r'name="VIIRS-SNPP-Roll-(\d{8})-(\d{8})-4KM-PICountries-CHL\.nc"'
HAZARD_EXCLUSION = ("cone", "wind_red", "wind_orange")
INDIA_OFFSET_MIN = 330


def _epoch_plus(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("long"), F.expr(EPOCH))


def ntz(text, fmt: str) -> Column:
    return F.try_to_timestamp(_col(text), F.lit(fmt)).cast("timestamp_ntz")


def ingest_hourly_json(raw: DataFrame, body: str = "value", lat: str | None = None, lon: str | None = None) -> DataFrame:
    """Parallel hourly arrays -> one observation per non-null hour, converted to standard units.

    ``lat`` and ``lon`` name columns with the point that was asked for; ``grid_distance_m`` (1 decimal) is how far off the
    answering grid cell lies, zero where no point was given and null where either is unknown. ``model`` is the payload's own or
    ``best_match``; ``hourly_index`` is the place in the arrays.
    The raw unit is the payload's own (``hourly_units``); the known unit of the variable stands in where it is not given.
    """
    schema = "latitude DOUBLE, longitude DOUBLE, model STRING, hourly MAP<STRING, ARRAY<STRING>>, hourly_units MAP<STRING, STRING>"
    doc = raw.select(*[c for c in raw.columns if c != body], F.from_json(body, schema).alias("_d")).where("_d.hourly IS NOT NULL")
    keep = [c for c in raw.columns if c != body]
    asked = lambda c, grid: F.coalesce(F.col(c), grid) if c else grid
    off = geo.haversine_m(asked(lat, F.col("_d.latitude")), asked(lon, F.col("_d.longitude")), F.col("_d.latitude"), F.col("_d.longitude"))
    doc = doc.withColumns({"_off": F.round(off, 1), "_model": F.coalesce(F.when(F.col("_d.model") != "", F.col("_d.model")), F.lit("best_match"))})
    series = doc.select(*keep, "_d.latitude", "_d.longitude", "_off", "_model", F.col("_d.hourly_units").alias("_units"), F.col("_d.hourly")["time"].alias("_time"),
                        F.explode(F.map_filter("_d.hourly", lambda k, v: k != "time")).alias("raw_variable", "_v"))
    hours = series.select(*keep, "latitude", "longitude", "_off", "_model", "raw_variable", F.try_element_at("_units", F.col("raw_variable")).alias("_unit"), F.posexplode(F.arrays_zip(
        F.col("_time").alias("time"), F.col("_v").alias("raw_text"))).alias("hourly_index", "_h")).select("*", "_h.*")
    names = dims.table(raw.sparkSession, dims.HOURLY_VARIABLES, "raw_variable, variable, raw_unit, unit, factor")
    value = numeric_or_null("raw_text")
    return hours.withColumn("raw_value", value).where(F.col("raw_value").isNotNull()).join(names, "raw_variable").select(
        *keep, "latitude", "longitude", "variable", ntz("time", "yyyy-MM-dd'T'HH:mm").alias("valid_time"),
        (F.col("raw_value") * F.col("factor")).alias("value_num"), "unit", "raw_value",
        F.coalesce(F.when(F.trim("_unit") != "", F.col("_unit")), F.col("raw_unit")).alias("raw_unit"),
        F.col("_model").alias("model"), "hourly_index", F.col("_off").alias("grid_distance_m"))


#: What a feature of a layer file carries besides its geometry and properties.
FEATURE_FIELDS = ("feature_key", "source_id", "acquired_at")


def _features(raw: DataFrame, body: str, geometry: str, properties: str) -> DataFrame:
    """The features of each row, which holds one Feature or a FeatureCollection; a row with neither gives none."""
    fields = {"geometry": f"STRUCT<{geometry}>", "properties": properties, **dict.fromkeys(FEATURE_FIELDS, "STRING")}
    schema = ", ".join(f"{k} {t}" for k, t in fields.items()) + f", features ARRAY<STRUCT<{', '.join(f'{k}: {t}' for k, t in fields.items())}>>"
    keep = [c for c in raw.columns if c != body]
    doc = raw.select(*keep, F.from_json(body, schema).alias("_d"))
    single = F.array(F.struct(*[F.col(f"_d.{c}").alias(c) for c in fields]))
    return doc.select(*keep, F.explode(F.coalesce(F.col("_d.features"), F.when(F.col("_d").isNotNull(), single))).alias("_f"))


def rejected_rows(raw: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Landed rows (by ``keys``) of which nothing was kept, so that a reader loses no file without a trace."""
    return raw.join(kept.select(*keys).distinct(), keys, "left_anti").select(*keys)


def _iso_time(text) -> Column:
    """ISO time with or without fraction and offset, as a zone-less UTC time; unreadable text gives null."""
    t = F.trim(_col(text))
    zoned = F.when(t.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), t).otherwise(F.concat(t, F.lit("+00:00")))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(zoned).cast("timestamp_ntz"))


def ingest_geojson(raw: DataFrame, body: str = "value") -> tuple[DataFrame, DataFrame]:
    """Features or FeatureCollections -> (features, segments in part / ring / seq order).

    ``feature_key``, ``source_id`` and ``acquired_at`` of a feature are kept where the columns do not have them already.
    """
    given = raw.columns
    raw_features = _features(raw, body, "type: STRING, coordinates: STRING", "MAP<STRING, STRING>").where("_f.geometry IS NOT NULL")
    extra = [c for c in FEATURE_FIELDS if c not in given]
    keep = [c for c in given if c != body] + extra
    features = raw_features.select(
        *[c for c in given if c != body], *[(_iso_time(f"_f.{c}") if c == "acquired_at" else F.coalesce(F.col(f"_f.{c}"), F.lit(""))).alias(c) for c in extra],
        F.col("_f.properties").alias("properties"), F.col("_f.geometry.type").alias("geometry_type"),
        F.col("_f.geometry.coordinates").alias("coordinates"))
    point = "ARRAY<DOUBLE>"
    c = F.col("coordinates")
    # Every geometry becomes parts -> rings -> points.
    nested = (F.when(F.col("geometry_type") == "Point", F.array(F.array(F.array(F.from_json(c, point)))))
              .when(F.col("geometry_type") == "MultiPoint", F.transform(F.from_json(c, f"ARRAY<{point}>"), lambda p: F.array(F.array(p))))
              .when(F.col("geometry_type") == "LineString", F.array(F.array(F.from_json(c, f"ARRAY<{point}>"))))
              .when(F.col("geometry_type") == "MultiLineString", F.transform(F.from_json(c, f"ARRAY<ARRAY<{point}>>"), lambda line: F.array(line)))
              .when(F.col("geometry_type") == "Polygon", F.array(F.from_json(c, f"ARRAY<ARRAY<{point}>>")))
              .when(F.col("geometry_type") == "MultiPolygon", F.from_json(c, f"ARRAY<ARRAY<ARRAY<{point}>>>")))
    is_polygon = F.col("geometry_type").isin("Polygon", "MultiPolygon")
    rings = (features.select(*keep, is_polygon.alias("is_polygon"), F.posexplode(nested).alias("part", "_rings"))
             .select(*keep, "is_polygon", "part", F.posexplode("_rings").alias("ring", "_points")))
    pairs = F.when(F.size("_points") == 1, F.array(F.struct(F.col("_points")[0].alias("a"), F.col("_points")[0].alias("b")))).otherwise(
        F.transform(F.slice("_points", 1, F.greatest(F.size("_points") - 1, F.lit(0))),
                    lambda p, k: F.struct(p.alias("a"), F.get("_points", k + 1).alias("b"))))
    segments = rings.select(*keep, "is_polygon", "part", "ring", F.posexplode(pairs).alias("seq", "_s")).select(
        *keep, "part", "ring", "seq", F.col("_s.a")[0].alias("x1"), F.col("_s.a")[1].alias("y1"),
        F.col("_s.b")[0].alias("x2"), F.col("_s.b")[1].alias("y2"), "is_polygon")
    return features, segments


def ingest_griddap_csv(raw: DataFrame, variables: dict[str, str | None], body: str = "value") -> DataFrame:
    """Names row, units row, data rows -> one observation per non-missing variable.

    ``variables`` maps a variable to its relative-error column, if it has one. Which column is where is read from the
    names row, so any order and any subset of columns will do; rows belong together by the other columns of ``raw``
    (the file's key). Header rows have no readable time and fall out by that, wherever the file was split. The tables hold
    numbers and times only, so no field is quoted. Files without a names row give nothing (see ``rejected_rows``).
    """
    keep = [c for c in raw.columns if c != body]
    cut = raw.select(*keep, F.transform(F.split(body, ","), lambda x: F.trim(x)).alias("_r"))
    heads = cut.groupBy(*keep).agg(F.max(F.when(F.col("_r")[0] == "time", F.col("_r"))).alias("_names"),
                                   F.max(F.when(F.col("_r")[0] == "UTC", F.col("_r"))).alias("_units")).where("_names IS NOT NULL")
    heads = heads.withColumnsRenamed({k: f"_head_{k}" for k in keep})
    both = cut.join(heads, [F.col(k).eqNullSafe(F.col(f"_head_{k}")) for k in keep] or F.lit(True))
    at = lambda name, row="_r": F.get(row, F.array_position("_names", name).cast("int") - 1)
    rows = both.select(
        *keep, _iso_time(at("time")).alias("valid_time"), numeric_or_null(F.coalesce(at("ZAX"), at("altitude"))).alias("depth"),
        numeric_or_null(at("latitude")).alias("lat"), numeric_or_null(at("longitude")).alias("lon"),
        F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), numeric_or_null(at(v)).alias("value_num"), at(v, "_units").alias("unit"),
                                    (numeric_or_null(at(e)) if e else F.lit(None).cast("double")).alias("relative_error")) for v, e in variables.items()])))
    return rows.where(F.col("valid_time").isNotNull() & F.col("value_num").isNotNull())


def catalog_dates(lines: DataFrame, body: str = "value") -> DataFrame:
    """Catalog listing lines -> (product, file_date, path); a composite counts by its end date."""
    standard, composite = F.regexp_extract(body, STANDARD_FILE, 2), F.regexp_extract(body, COMPOSITE_FILE, 2)
    date = F.when(standard != "", standard).when(composite != "", composite)
    product = F.when(standard != "", F.regexp_extract(body, STANDARD_FILE, 1)).when(composite != "", F.lit("chl"))
    return lines.select(*[c for c in lines.columns if c != body], product.alias("product"),
                        F.try_to_date(date, "yyyyMMdd").alias("file_date"), F.regexp_extract(body, 'urlPath="([^"]*)"', 1).alias("path")) \
        .where(F.col("file_date").isNotNull())


def _strip_tags(html: Column) -> Column:
    """Tags, non-breaking spaces and white-space runs become one space, in a single pass."""
    return F.trim(F.regexp_replace(html, r"(?:<[^>]*>|&nbsp;|[\s\p{Z}])+", " "))


def parse_bulletins(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per captioned table (coast block) with its label -> text map and the validity window."""
    keep = [c for c in pages.columns if c != html]
    # The sentence is cut out once; its parts are then read from the short text.
    sentence = pages.select(*keep, html, F.regexp_extract(_strip_tags(F.col(html)), VALIDITY, 0).alias("_valid"))
    part = lambda n: F.regexp_extract("_valid", VALIDITY, n)
    moment = lambda day, hour: F.when(F.col("_valid") != "", F.timestamp_add(
        "HOUR", part(hour).try_cast("int"), F.try_to_timestamp(part(day), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")))
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))
    blocks = sentence.select(*keep, moment(3, 2).alias("valid_from"), moment(5, 4).alias("valid_to"), F.explode(tables).alias("_t"))
    caption = _strip_tags(F.regexp_extract("_t", r"(?is)<caption[^>]*>(.*?)</caption>", 1))
    row = r"(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>\s*<td[^>]*>(.*?)</td>"
    labels, values = (F.regexp_extract_all("_t", F.lit(row), F.lit(k)) for k in (1, 2))
    known = F.create_map(*[F.lit(x) for pair in (*dims.BULLETIN_FIELDS, ("storm surge / tidal warning", "storm_surge_warning")) for x in pair])

    def entry(pair: Column) -> Column:
        return F.struct(F.coalesce(known[pair["l"]], F.replace(pair["l"], F.lit(" "), F.lit("_"))).alias("k"), pair["v"].alias("v"))

    plain = F.transform(F.arrays_zip(labels.alias("l"), values.alias("v")), lambda c: F.struct(
        F.lower(_strip_tags(c["l"])).alias("l"), _strip_tags(c["v"]).alias("v")))
    entries = F.transform(F.filter(plain, lambda c: c["l"] != ""), entry)
    return blocks.select(*keep, "valid_from", "valid_to", caption.alias("block"), entries.alias("_e")).where("block <> ''").select(
        *keep, "valid_from", "valid_to", "block", F.map_from_entries(F.filter("_e", lambda e: e["v"].isNotNull())).alias("fields"))


def hhmm_to_utc(date, hhmm) -> Column:
    """``HHMM`` on an India-time date as zone-less UTC; hours and minutes wrap."""
    digits = F.trim(_col(hhmm))
    padded = F.when(digits.rlike("^[0-9]+$"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))
    minutes = (F.substring(padded, 1, 2).cast("int") % 24) * 60 + F.substring(padded, 3, 2).cast("int") % 60
    return F.timestamp_add("MINUTE", minutes - INDIA_OFFSET_MIN, F.try_to_timestamp(F.trim(_col(date)), F.lit("yyyy-MM-dd")).cast("timestamp_ntz"))


def parse_nowcast(rows: DataFrame) -> DataFrame:
    """District warnings: text, colour, issue and expiry in UTC (expiry rolls over midnight)."""
    issued = F.coalesce(hhmm_to_utc("Date", "toi"), ntz("update_time", "yyyy-MM-dd HH:mm:ss"), F.col("acquired_at"))
    upto = hhmm_to_utc("Date", "vupto")
    text = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in ("message", "impact", "action")], F.lit("NIL"))
    colours = F.create_map(*[F.lit(x) for pair in dims.WARNING_COLOURS for x in pair])
    staged = rows.withColumns({"issued_at": issued, "_upto": upto, "value_text": text, "colour": colours[F.col("Color")]})
    return staged.withColumn("valid_to", F.when(
        F.col("_upto") <= F.col("issued_at"), F.timestamp_add("DAY", F.lit(1), F.col("_upto"))).otherwise(F.col("_upto"))).drop("_upto")


def parse_stations(rows: DataFrame) -> DataFrame:
    """Station rows to one observation per usable variable; wind in knots."""
    names = [r[0] for r in dims.STATION_VARIABLES]
    keep = [c for c in rows.columns if c not in names]
    spec = dims.table(rows.sparkSession, dims.STATION_VARIABLES, "field, variable, unit, factor")
    long = rows.select(*keep, F.inline(F.array(*[F.struct(F.lit(n).alias("field"), numeric_or_null(n).alias("_v")) for n in names])))
    return long.where(F.col("_v").isNotNull()).join(spec, "field").select(
        *keep, "variable", "unit", (F.col("_v") * F.col("factor")).alias("value_num"))


def parse_cyclones(raw: DataFrame, body: str = "value") -> DataFrame:
    """Event features or collections of them; those without event or episode id are dropped, the level defaults to Green."""
    fields = ("STRUCT<eventid: STRING, episodeid: STRING, eventname: STRING, name: STRING, alertlevel: STRING, iscurrent: STRING, fromdate: STRING, "
              "todate: STRING, country: STRING, severitydata: STRUCT<severity: DOUBLE, severitytext: STRING, severityunit: STRING>>")
    p = lambda c: F.col(f"_e.properties.{c}")
    sev = lambda c: F.col(f"_e.properties.severitydata.{c}")
    blank = lambda c: F.when(c != "", c)
    rows = _features(raw, body, "coordinates: ARRAY<DOUBLE>", fields).withColumnRenamed("_f", "_e") \
        .where(p("eventid").isNotNull() & p("episodeid").isNotNull())
    return rows.select(
        *[c for c in raw.columns if c != body], p("eventid").alias("event_id"), p("episodeid").alias("episode_id"),
        F.coalesce(blank(p("eventname")), blank(p("name")), F.concat(F.lit("TC-"), p("eventid"))).alias("name"),
        F.coalesce(blank(p("alertlevel")), F.lit("Green")).alias("alert_level"),
        _iso_time(p("fromdate")).alias("from_date"), _iso_time(p("todate")).alias("to_date"),
        F.get("_e.geometry.coordinates", F.lit(1)).alias("lat"), F.get("_e.geometry.coordinates", F.lit(0)).alias("lon"),
        F.coalesce(blank(sev("severitytext")), F.trim(F.concat_ws(" ", F.when(sev("severity").isNotNull(), sev("severity").cast("string")),
                   F.when(sev("severity").isNotNull(), sev("severityunit")))) ).alias("severity"),
        F.coalesce(F.lower(p("iscurrent")) == "true", F.lit(False)).alias("is_current"))


def classify_hazards(features: DataFrame, cls: str = "Class") -> DataFrame:
    """Hazard kind by class name; ``excludes`` marks what boats must keep out of (green wind is not)."""
    c = F.col(cls)
    kind = (F.when(c == "Poly_Cones", "cone").when(c == "Poly_Red", "wind_red").when(c == "Poly_Orange", "wind_orange")
            .when(c == "Poly_Green", "wind_green").when(c.startswith("Line_Line"), "track").when(c.startswith("Point_"), "point"))
    return features.withColumn("kind", kind).withColumn("excludes", F.coalesce(F.col("kind").isin(*HAZARD_EXCLUSION), F.lit(False)))


def classify_boundaries(lines: DataFrame, historic: DataFrame, maritime: DataFrame) -> DataFrame:
    """Treaty lines only; listed historic ids, else maritime — unlisted ids carry a note."""
    h = historic.select("line_id", F.lit(True).alias("_h"))
    m = maritime.select("line_id", F.lit(True).alias("_m"))
    joined = lines.where("line_type = 'Treaty'").join(h, "line_id", "left").join(m, "line_id", "left")
    return joined.select(
        "line_id", F.when(F.col("_h"), "IMBL_HISTORIC_WATERS").otherwise("IMBL_MARITIME_BOUNDARY").alias("fence_class"),
        F.coalesce("source1", "source2").alias("treaty"), F.regexp_replace("doc_date", "Z$", "").alias("treaty_date"),
        F.when(F.col("_h").isNull() & F.col("_m").isNull(), F.lit("unlisted line id")).alias("note"))


def parse_landing_centres(rows: DataFrame) -> DataFrame:
    """Named centres with coordinates from the geometry, else from their own columns."""
    name = F.trim("LC_NAME")
    return rows.where(F.coalesce(name != "", F.lit(False))).select(
        "id", name.alias("name"), F.trim("DIST_NAME").alias("district"),
        F.coalesce("geom_lat", numeric_or_null("LATITUDE")).alias("lat"), F.coalesce("geom_lon", numeric_or_null("LONGITUDE")).alias("lon"))


def advisory_date(year, jday) -> Column:
    """Year and day-of-year text to a date; below 1 or unreadable is null."""
    day = F.trim(_col(jday)).try_cast("int")
    return F.when(day >= 1, F.date_add(F.make_date(_col(year), F.lit(1), F.lit(1)), day - 1))


def features_to_observations(features: DataFrame) -> DataFrame:
    """Layer-typed features to observations: ``layer`` and a property map decide variable and value."""
    p = lambda k: F.when(F.trim(F.col("properties")[k]) != "", F.trim(F.col("properties")[k]))
    layer = F.col("layer")
    variable = (F.when(layer == "pfz_lines", "pfz_line_id").when(layer == "pfz_sectors", "pfz_sector_id")
                .when(layer == "landing_centres", "landing_centre_name").when(layer == "hab_sectors", "hab_sector_status")
                .when(layer == "bathymetry", "bathymetry_contour_depth").when(layer.startswith("eco_"), "eco_sensitive_zone_present"))
    text = (F.when(layer == "pfz_lines", F.coalesce(p("UID"), p("Sno"))).when(layer == "pfz_sectors", p("SEC_ID"))
            .when(layer == "landing_centres", p("LC_NAME"))
            .when(layer == "hab_sectors", F.coalesce(p("Location"), F.concat(F.lit("HAB sector "), p("Id"))))
            .when(layer.startswith("eco_"), F.substr(layer, F.lit(5))))
    depth = F.when(layer == "bathymetry", numeric_or_null(F.col("properties")["BATHMETRY1"]))
    return features.select(*[c for c in features.columns if c != "properties"], variable.alias("variable"), depth.alias("value_num"),
                           text.alias("value_text")).where(F.col("value_num").isNotNull() | F.col("value_text").isNotNull())


# ---- keyed tables -------------------------------------------------------------------


def feature_key(named, *content: str) -> Column:
    """The named property, else the first 16 digits of the content's SHA-1."""
    return F.coalesce(F.when(F.trim(_col(named)) != "", _col(named)), F.substring(F.sha1(F.to_json(F.struct(*content))), 1, 16))


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key wins; repeating the same updates changes nothing."""
    both = table.unionByName(updates, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def latest_snapshot(snapshots: DataFrame, as_of: Column, ttl_s: Column | int | None = None, stale_ok: bool = False) -> DataFrame:
    """Newest row per (source, key) up to ``as_of``; older than the ttl is dropped, or kept and flagged."""
    rest = [c for c in snapshots.columns if c not in ("source_id", "key")]
    newest = snapshots.where(F.col("fetched_at") <= as_of).groupBy("source_id", "key").agg(
        F.max_by(F.struct(*rest), F.struct("fetched_at", "seq")).alias("_r")).select(
        "source_id", "key", *[F.col(f"_r.{c}").alias(c) for c in rest])
    if ttl_s is None:
        return newest.withColumn("stale", F.lit(False))
    limit = ttl_s if isinstance(ttl_s, Column) else F.lit(ttl_s)
    aged = newest.withColumn("stale", F.timestamp_diff("SECOND", F.col("fetched_at"), as_of) > limit)
    return aged if stale_ok else aged.where(~F.col("stale"))


def freeze(snapshots: DataFrame, as_of: Column, path: str | None = None) -> DataFrame:
    """Newest snapshot of every key written as a frozen set partitioned by source; returns it."""
    latest = latest_snapshot(snapshots, as_of)
    if path is None:
        return latest
    latest.write.mode("overwrite").partitionBy("source_id").parquet(path)
    return latest.sparkSession.read.parquet(path)


def read_traces(lines: DataFrame, body: str = "value") -> DataFrame:
    """JSON lines to trace steps: unreadable lines are skipped, a repeated step id counts once.

    ``args`` stays JSON text; times are ISO with or without fraction and offset.
    """
    schema = ("step_id STRING, query_id STRING, parent_id STRING, agent STRING, kind STRING, tool STRING, args STRING, result_digest STRING, "
              "provenance_ids ARRAY<STRING>, ts STRING, duration_ms DOUBLE, why STRING, ok BOOLEAN, error STRING")
    rows = lines.select(F.from_json(body, schema).alias("_s")).select("_s.*").where(F.col("step_id").isNotNull() & F.col("query_id").isNotNull())
    rest = [c for c in rows.columns if c != "step_id"]
    return rows.groupBy("step_id").agg(F.min_by(F.struct(*rest), F.struct("ts", "query_id")).alias("_r")).select(
        "step_id", *[F.col(f"_r.{c}").alias(c) for c in rest]).withColumns({
            "ts": _iso_time("ts"), "ok": F.coalesce("ok", F.lit(True)), "kind": F.coalesce("kind", F.lit("tool_call")),
            "provenance_ids": F.coalesce("provenance_ids", F.array().cast("array<string>"))})


def export_features(features: DataFrame, bbox=dims.REGION_BBOX, pad: float = 1.0) -> DataFrame:
    """Region-clipped features with class style merged as one JSON text each; own lead distances win."""
    from pelagia.operators.filters import in_bbox

    classes = dims.fence_classes(features.sparkSession).select(
        F.col("fence_class").alias("layer"), "colour", "severity", "warn_nm", "critical_nm")
    clipped = features.where(in_bbox("y0", "x0", bbox, pad)).join(classes, "layer")
    body = F.to_json(F.struct("fkey", "name", "layer", "colour", "severity",
                              F.coalesce("own_warn_nm", "warn_nm").alias("warn_nm"),
                              F.coalesce("own_critical_nm", "critical_nm").alias("critical_nm")))
    return clipped.select("layer", "fkey", body.alias("feature"))


def write_table(df: DataFrame, name: str) -> str:
    """Write under the shared folder and return the path."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path
