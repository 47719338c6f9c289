"""Readers: files to text rows, and text rows to survey tables.

Each source is split in two: `read_*` lists files through Spark's own readers, and `parse_*`
turns documents into rows with column expressions, so the parsing also works on text that is
already in a table.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geodesy import forward_stages, on_vertices
from ..functions.polyline import bounds
from ..functions.schema import first_present_column, require_columns
from ..functions.timeops import local_wall_time, night_key
from ..operators.evidence import NIGHT, truthy, with_night
from ..operators.events import event_fields
from ..operators.tracks import number_points
from ..params import DEFAULTS, Params

# --- tracks ----------------------------------------------------------------------------

#: A time of day with its zone; a date alone ends in digits like a zone and has none.
ZONE = r":[0-9.]+\s*(Z|[+-][0-9]{2}:?[0-9]{2})\s*$"

GPX_SCHEMA = (
    "trk array<struct<trkseg:array<struct<trkpt:array<struct<"
    "_lat:double,_lon:double,ele:double,time:string>>>>>>"
)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Track points of GPX files: `session_file, seq, timestamp, lat, lon, elevation_m`.

    Points without a time are skipped; times without a zone are UTC; `seq` runs over all tracks
    and segments of a file. Empty files give no rows.
    """
    files = (
        spark.read.format("xml")
        .option("rowTag", "gpx")
        .schema(GPX_SCHEMA)
        .load(path)
        .withColumn("session_file", F.col("_metadata.file_name"))
    )
    return parse_gpx(files)


def parse_gpx(files: DataFrame) -> DataFrame:
    """`files` has `session_file` and the nested `trk` of one GPX document per row."""
    flat = F.flatten(
        F.transform("trk", lambda track: F.flatten(F.transform(track["trkseg"], lambda s: s["trkpt"])))
    )
    timed = F.filter(flat, lambda point: point["time"].isNotNull() & (F.trim(point["time"]) != ""))
    points = files.select("session_file", F.posexplode(timed).alias("seq", "p"))
    zoned = F.col("p.time").rlike(ZONE)
    instant = F.try_to_timestamp(F.when(zoned, F.trim("p.time")).otherwise(F.concat(F.trim("p.time"), F.lit("Z"))))
    return points.select(
        "session_file",
        F.col("seq").cast("bigint").alias("seq"),
        local_wall_time(instant).alias("timestamp"),
        F.col("p._lat").alias("lat"),
        F.col("p._lon").alias("lon"),
        F.col("p.ele").alias("elevation_m"),
    )


def read_gps_history(spark: SparkSession, path: str) -> DataFrame:
    return prepare_gps_history(spark.read.option("header", True).csv(path))


def prepare_gps_history(raw: DataFrame, order: tuple[str, ...] = (), *, group_rows=None) -> DataFrame:
    """Location history as track points: bad rows dropped, one session per night, `seq` in time.

    Text times with a zone become local wall time; without one they are local already.
    """
    require_columns(raw, ["timestamp", "lat", "lon"], "location history")
    moment = F.col("timestamp").try_cast("timestamp_ntz")
    if raw.schema["timestamp"].dataType.typeName() == "string":
        zoned = F.col("timestamp").rlike(ZONE)
        moment = F.when(zoned, local_wall_time(F.try_to_timestamp(F.trim("timestamp")))).otherwise(moment)
    typed = raw.withColumns(
        {
            "timestamp": moment,
            "lat": F.col("lat").try_cast("double"),
            "lon": F.col("lon").try_cast("double"),
        }
    ).dropna(subset=["timestamp", "lat", "lon"])
    typed = typed.where(~F.isnan("lat") & ~F.isnan("lon"))
    nightly = with_night(typed).withColumn(
        "session_file", F.concat(F.lit("gps_history:"), F.col(NIGHT))
    )
    if "elevation_m" not in nightly.columns:
        nightly = nightly.withColumn("elevation_m", F.lit(None).cast("double"))
    tie = [*order] or ["lat", "lon"]
    return number_points(nightly, "session_file", ["timestamp", *tie], group_rows=group_rows)


# --- roads and context -----------------------------------------------------------------

GEOMETRY = "type:string,coordinates:string"
FEATURE_SCHEMA = (
    "struct<id:string,properties:map<string,string>,"
    f"geometry:struct<{GEOMETRY},geometries:array<struct<{GEOMETRY}>>>>"
)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features, one row each, from a collection or from one feature per line.

    The layout is told per file, by parsing. Files whose lines with the word Feature are all whole
    features, as map exports write them, are read line by line and split across tasks; any other file
    is one document of one task. A text may hold several values with commas between them; one that is
    not whole, or holds anything but features and collections, is an error, so no feature is lost.
    """
    lines = spark.read.text(path).where(F.col("value").contains('"Feature"'))
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"))
    alone = _complete("value") & F.forall(_values("value", "type:string"), lambda v: v["type"] == "Feature")
    # the driver lists these files anyway to plan the scan
    whole = [r["file"] for r in lines.where(~F.coalesce(alone, F.lit(False))).select("file").distinct().toLocalIterator()]
    fields = FEATURE_SCHEMA.removeprefix("struct<").removesuffix(">")
    single = lines.where(~F.col("file").isin(whole)).select(F.explode(_values("value", fields)).alias("f")).select("f.*")
    if not whole:
        return single
    documents = spark.read.text([unquote(f) for f in whole], wholetext=True)
    values = _values("value", f"type:string,features:array<{FEATURE_SCHEMA}>,{fields}")
    known = _complete("value") & F.forall(values, lambda v: v["type"].isin("Feature", "FeatureCollection"))
    features = F.flatten(
        F.transform(
            values,
            lambda v: F.when(v["type"] == "Feature", F.array(F.struct(*[v[n].alias(n) for n in ("id", "properties", "geometry")]))).otherwise(v["features"]),
        )
    )
    lost = F.raise_error(F.concat(F.lit("neither features nor a collection, or not whole: "), F.col("_metadata.file_path")))
    collected = documents.select(F.explode(F.when(F.coalesce(known, F.lit(False)), features).otherwise(lost)).alias("f"))
    return single.unionByName(collected.select("f.*"))


def _json_body(column: str) -> Column:
    """A line or document without a byte-order mark, a record mark, or a trailing comma."""
    return F.regexp_replace(F.regexp_replace(F.col(column), "^[\ufeff\x1e\\s]+", ""), r",\s*$", "")


def _listed(column: str) -> Column:
    """The text as one array: what parses so is whole, with nothing but commas between its values."""
    return F.concat(F.lit("["), _json_body(column), F.lit("]"))


def _complete(column: str) -> Column:
    return F.try_parse_json(_listed(column)).isNotNull()


def _values(column: str, fields: str) -> Column:
    return F.from_json(_listed(column), f"array<struct<{fields}>>")


def parse_features(lines: DataFrame, column: str = "value") -> DataFrame:
    """One GeoJSON feature per row of text; a trailing comma is ignored."""
    return lines.select(F.from_json(_json_body(column), FEATURE_SCHEMA).alias("f")).select("f.*")


def _lines_of_geometry() -> Column:
    """All lines of a feature as arrays of coordinate pairs; other geometry gives none."""
    kind, raw = F.col("geometry.type"), F.col("geometry.coordinates")
    single = F.array(F.from_json(raw, "array<array<double>>"))
    several = F.from_json(raw, "array<array<array<double>>>")
    return F.when(kind == "LineString", single).when(kind == "MultiLineString", several)


def _plane_line(coordinates: str, p: Params) -> Column:
    """Line of plane vertices from an array of (longitude, latitude) pairs."""
    named = f"transform({coordinates}, c -> named_struct('lat', c[1], 'lon', c[0]))"
    return F.expr(on_vertices(named, forward_stages(p)))


def road_parts(features: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Road features to line parts: `way_id, part_index, highway, name, line`."""
    tags = F.col("properties")
    identity = F.coalesce(
        F.nullif(tags["@id"], F.lit("")),
        F.nullif(F.col("id"), F.lit("")),
        F.nullif(tags["id"], F.lit("")),
        F.nullif(tags["osm_id"], F.lit("")),
        F.concat(F.lit("row"), F.xxhash64(F.col("geometry.coordinates")).cast("string")),
    )
    way = F.replace(F.replace(identity, F.lit("way/"), F.lit("")), F.lit("w"), F.lit(""))
    return (
        features.withColumns({"way_id": way, "highway": tags["highway"], "name": tags["name"]})
        .select("way_id", "highway", "name", F.posexplode(_lines_of_geometry()).alias("part_index", "_c"))
        .where(F.size("_c") >= 2)
        .withColumn("line", _plane_line("_c", p))
        .drop("_c")
    )


def context_features(features: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Land-context features with their class: `feature_id, context_class, area_id, line, x0..y1`.

    One row per point, line or ring; the rings of one polygon share an `area_id`, which is null
    elsewhere. A feature of several classes appears once per class; a collection of geometries
    counts as its members. Other geometry types are an error, a feature without geometry has no row.
    """
    tags = F.col("properties")
    water, nature, land = (F.coalesce(tags[k], F.lit("")) for k in ("waterway", "natural", "landuse"))
    classes = F.array_compact(
        F.array(
            F.when(water != "", F.lit("stream")),
            F.when(nature == "coastline", F.lit("coast")),
            F.when((nature == "wood") | land.isin("forest", "orchard"), F.lit("forest")),
            F.when(land.isin("farmland", "farmyard", "meadow"), F.lit("farmland")),
            F.when(land == "residential", F.lit("residential")),
        )
    )
    collection = F.col("geometry.type") == "GeometryCollection"
    own = F.array(F.struct("geometry.type", "geometry.coordinates"))
    members = F.when(collection, F.col("geometry.geometries")).when(F.col("geometry.type").isNotNull(), own)
    kind, raw = F.col("_g.type"), F.col("_g.coordinates")

    def as_lines(lines: Column, area: bool = False) -> Column:
        return F.struct(F.lit(area).alias("area"), lines.alias("lines"))

    place, line, lines, areas = (F.from_json(raw, "array<" * n + "double" + ">" * n) for n in (1, 2, 3, 4))
    parts = (
        F.when(kind == "Point", F.array(as_lines(F.array(F.array(place)))))
        .when(kind == "MultiPoint", F.array(as_lines(F.transform(line, lambda c: F.array(c)))))
        .when(kind == "LineString", F.array(as_lines(F.array(line))))
        .when(kind == "MultiLineString", F.array(as_lines(lines)))
        .when(kind == "Polygon", F.array(as_lines(lines, True)))
        .when(kind == "MultiPolygon", F.transform(areas, lambda rings: as_lines(rings, True)))
        .otherwise(F.raise_error(F.concat(F.lit("geometry not known: "), F.coalesce(kind, F.lit("none")))))
    )
    placed = (
        features.withColumn("context_class", F.explode(classes))
        .select(
            "context_class",
            F.xxhash64(F.to_json(F.struct("id", "properties", "geometry"))).alias("feature_id"),
            F.explode(members).alias("_g"),
        )
        .select("context_class", "feature_id", F.explode(parts).alias("_p"))
        .withColumn("area_id", F.when(F.col("_p.area"), F.xxhash64("feature_id", "_p.lines")))
        .select("context_class", "feature_id", "area_id", F.explode("_p.lines").alias("_c"))
        .where(F.size("_c") > 0)
        .withColumn("line", _plane_line("_c", p))
        .drop("_c")
        .withColumns({name: F.expr(text) for name, text in bounds("line").items()})
    )
    return placed.select("feature_id", "context_class", "area_id", "line", "x0", "y0", "x1", "y1")


# --- field logs ------------------------------------------------------------------------

DATE_LINE = r"(20[0-9]{2})/([0-9]{1,2})/([0-9]{1,2})\s+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?"
SESSION_START = "エリア探索開始"
# Fixed marker words of a search session.
START_MARKERS = ("エリア探索開始", "探索開始")
END_MARKERS = ("エリア探索終了", "探索終了")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as `file, content`; a log is one document written by one person."""
    return (
        spark.read.text(path, wholetext=True)
        .withColumn("file", F.col("_metadata.file_name"))
        .select("file", F.col("value").alias("content"))
    )


def _content() -> Column:
    """A document's text without a byte-order mark, which would hide its first line's date."""
    return F.regexp_replace("content", "^\ufeff", "")


def _moment(line: Column) -> Column:
    part = [F.regexp_extract(line, DATE_LINE, i) for i in range(1, 7)]
    numbers = [F.coalesce(x.try_cast("int"), F.lit(0)) for x in part]
    return F.make_timestamp_ntz(*numbers[:5], numbers[5].cast("decimal(16,6)"))


def parse_field_log(documents: DataFrame) -> DataFrame:
    """Event rows of field logs.

    A block starts at a date line and ends before the next one. Blocks with a line that names an
    event type become rows; the session start is that of the last start block before them.
    """
    starts = r"(?m)(?=^[ \t　]*" + DATE_LINE.replace(r"\s+", r"[ \t　]+") + ")"
    blocks = documents.select("file", F.posexplode(F.split(_content(), starts)).alias("block", "raw")).where(
        F.regexp_extract("raw", r"(?U)^\s*" + DATE_LINE, 1) != ""
    )
    lines = tx.lines_of(F.col("raw"))
    # Trailing blank lines belong to the gap between blocks, not to the block.
    text = tx.strip(F.array_join(lines, "\n"))
    noted = blocks.withColumn("raw_text", text).withColumn(
        "timestamp", _moment(F.element_at(F.split("raw_text", "\n"), 1))
    )
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    started = F.when(F.col("raw_text").contains(SESSION_START), F.col("timestamp"))
    with_start = noted.withColumn("session_start", F.last(started, ignorenulls=True).over(upto))
    fields = event_fields(with_start.drop("raw")).where(F.col("event_type").isNotNull())
    night = night_key(F.col("timestamp"))
    return fields.withColumns({"night_date": night, NIGHT: night})


def parse_session_markers(documents: DataFrame) -> DataFrame:
    """Start and end markers of searches with the moment written above them."""
    lines = documents.select(
        "file",
        F.sha2(F.col("content").cast("binary"), 256).alias("source_hash"),
        F.posexplode(F.split(_content(), r"\r\n|\r|\n")).alias("_line", "_raw"),
    ).withColumn("line", tx.strip(F.col("_raw")))
    dated = F.regexp_extract("line", r"^(20[0-9]{2}/[0-9]{1,2}/[0-9]{1,2})\s+([0-9]{1,2}:[0-9]{2})$", 0) != ""
    upto = Window.partitionBy("file").orderBy("_line").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(_contains_any(START_MARKERS), "SEARCH_START").when(_contains_any(END_MARKERS), "SEARCH_END")
    marked = (
        lines.withColumn("_dated", dated)
        .withColumn("moment", F.last(F.when(dated, _moment(F.col("line"))), ignorenulls=True).over(upto))
        .withColumn("evidence_type", kind)
        .where(~F.col("_dated") & F.col("evidence_type").isNotNull() & F.col("moment").isNotNull())
    )
    return marked.select(
        night_key(F.col("moment")).alias(NIGHT),
        "evidence_type",
        F.col("file").alias("source_file"),
        F.date_format("moment", "yyyy-MM-dd'T'HH:mm:ss'+09:00'").alias("source_timestamp"),
        "source_hash",
        F.lit("STRONG_SESSION_MARKER").alias("strength"),
        F.concat(
            F.lit("line="), (F.col("_line") + 1).cast("string"), F.lit("; marker="), F.col("line")
        ).alias("notes"),
    )


def _contains_any(words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.col("line").contains(word)
    return hit


def combine_manifests(*manifests: DataFrame) -> DataFrame:
    out = manifests[0]
    for other in manifests[1:]:
        out = out.unionByName(other)
    return out.distinct()


# --- weather ---------------------------------------------------------------------------

WEATHER_SCHEMA = (
    "hourly struct<time:array<string>,temperature_2m:array<double>,relative_humidity_2m:array<double>,"
    "dew_point_2m:array<double>,precipitation:array<double>>"
)


def parse_weather(documents: DataFrame, station: str = "station", column: str = "content") -> DataFrame:
    """Hourly reports from a document of parallel arrays, one document per station."""
    hourly = documents.select(station, F.from_json(column, WEATHER_SCHEMA)["hourly"].alias("h"))
    names = {
        "temperature_c": "temperature_2m",
        "humidity_pct": "relative_humidity_2m",
        "dew_point_c": "dew_point_2m",
        "precip_mm": "precipitation",
    }
    # A measure that was not asked for has no array; zipping needs an empty one.
    series = [
        F.coalesce(F.col(f"h.{source}"), F.array().cast("array<double>")).alias(name)
        for name, source in names.items()
    ]
    rows = hourly.select(
        station, F.explode(F.arrays_zip(F.col("h.time").alias("time"), *series)).alias("r")
    )
    return rows.select(
        station,
        F.col("r.time").try_cast("timestamp_ntz").alias("timestamp"),
        "r.temperature_c",
        "r.humidity_pct",
        "r.dew_point_c",
        "r.precip_mm",
    )


# --- registries ------------------------------------------------------------------------


def parse_conflicts(raw: DataFrame) -> DataFrame:
    """Reviewed night conflicts: blanks for nulls, `include_by_default` as boolean."""
    wanted = [NIGHT, "status", "include_by_default", "reason", "source_evidence"]
    require_columns(raw, wanted, "conflict registry")
    text = raw.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in wanted])
    return text.withColumn("include_by_default", truthy(F.col("include_by_default")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def candidate_nights(df: DataFrame) -> DataFrame:
    """Distinct nights of a list whose night column has one of several names."""
    column = first_present_column(df, [NIGHT, "operational_date", "date"])
    return (
        df.select(F.col(column).cast("string").alias(NIGHT)).where(F.col(NIGHT).isNotNull()).distinct()
    )


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def inventory_by_hash(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Expected originals, found by content hash whatever their name: `sha256, night, found, file`."""
    column = first_present_column(manifest, ["sha256", "raw_sha256"])
    wanted = manifest.select(F.col(column).alias("sha256"), F.col("operational_night"))
    present = (
        files.select(F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "file")
        .groupBy("sha256")
        .agg(F.max("file").alias("file"))
    )
    return wanted.join(present, "sha256", "left").withColumn("found", F.col("file").isNotNull())


def inventory_status(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if("found").alias("found"),
        F.count_if(~F.col("found")).alias("missing"),
        F.bool_and("found").alias("complete"),
    )
