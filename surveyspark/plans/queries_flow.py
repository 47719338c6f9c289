"""Registered queries of readers, writers, road recovery, models and the nightly flow."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geodesy import with_degrees
from ..functions.timeops import night_key
from ..operators import events as evt
from ..operators import model as md
from ..operators import weather as we
from ..operators.ordered import arrange
from ..operators.recovery import RecoveryRules, recover_roads
from ..params import Params
from ..session import scratch_folder
from ..sources import ingest, sinks
from . import nightly
from .queries_geo import CONTEXT_CLASSES, VISIT_TABLES, context_lines, located_points, parts, segment_places
from .queries_tracks import FIELDS_SQL, NIGHT_SQL, visits
from .registry import Tables, query, rounded

# --- readers ---------------------------------------------------------------------------

# One log document per user and night, its notes in order.
LOGGED_SQL = f"""
select *, user_id || '@' || {NIGHT_SQL} as file,
       row_number() over (partition by user_id, {NIGHT_SQL} order by timestamp, event_id) as k,
       date_trunc('minute', timestamp) as moment
from field_notes join (select event_id, user_id, event_type as kind from events) using (event_id)"""


def log_documents(t: Tables):
    owner = t.events.select("event_id", "user_id")
    noted = t.field_notes.join(owner, "event_id").withColumn(
        "file", F.concat(F.col("user_id").cast("string"), F.lit("@"), night_key(F.col("timestamp")))
    )
    gathered = noted.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("timestamp", "event_id", "raw_text"))).alias("n")
    )
    return gathered.select(
        "file", F.array_join(F.transform("n", lambda n: n["raw_text"]), "\n").alias("content")
    )


@query(
    "src_field_log",
    """select l.file, l.k - 1 as block, l.moment as timestamp,
              (select max(s.moment) from logged s where s.file = l.file and s.k <= l.k and s.kind = 'signup') as session_start,
              f.event_type, f.species, f.individual_count, f.size, f.wetness, f.lat, f.lon, """
    + NIGHT_SQL.replace("timestamp", "l.moment")
    + """ as night_date from logged l join fields f using (event_id) where f.event_type is not null""",
    ("logged", LOGGED_SQL),
    ("fields", FIELDS_SQL),
)
def _(t: Tables):
    return (
        ingest.parse_field_log(log_documents(t))
        .withColumn("block", F.col("block").cast("bigint"))
        .drop("raw_text", "operational_date_0700")
    )


@query(
    "src_session_markers",
    f"""select {NIGHT_SQL.replace('timestamp', 'moment')} as operational_date_0700, 'SEARCH_START' as evidence_type,
              file as source_file, strftime(moment, '%Y-%m-%dT%H:%M:%S') || '+09:00' as source_timestamp, source_hash,
              'STRONG_SESSION_MARKER' as strength, 'line=' || ((k - 1) * 5 + 3) || '; marker=エリア探索開始' as notes
       from logged join (select file, sha256(string_agg(raw_text, chr(10) order by k)) as source_hash from logged group by 1) using (file)
       where kind = 'signup'""",
    ("logged", LOGGED_SQL),
)
def _(t: Tables):
    return ingest.parse_session_markers(log_documents(t))


@query(
    "combine_manifests",
    f"""select distinct {NIGHT_SQL.replace('timestamp', 'moment')} as operational_date_0700, file as source_file from logged where kind = 'signup'""",
    ("logged", LOGGED_SQL),
)
def _(t: Tables):
    markers = ingest.parse_session_markers(log_documents(t)).select("operational_date_0700", "source_file")
    return ingest.combine_manifests(markers, markers)


RAW_HISTORY_SQL = """
select event_id, case when value > 90 then 'bad' else cast(timestamp as string) end as timestamp,
       case when value < 2 then '' else cast(lat as string) end as lat, cast(lon as string) as lon
from (select h.*, e.value from gps_history h join events e using (event_id))"""


@query(
    "prep_gps_history",
    f"""select event_id, {NIGHT_SQL} as operational_date_0700, 'gps_history:' || {NIGHT_SQL} as session_file,
              cast(row_number() over (partition by {NIGHT_SQL} order by timestamp, event_id) - 1 as bigint) as seq,
              round(lat, 6) as lat, round(lon, 6) as lon
       from (select h.*, e.value from gps_history h join events e using (event_id)) where value <= 90 and value >= 2""",
)
def _(t: Tables):
    value = t.events.select("event_id", "value")
    raw = t.gps_history.join(value, "event_id").select(
        "event_id",
        F.when(F.col("value") > 90, "bad").otherwise(F.col("timestamp").cast("string")).alias("timestamp"),
        F.when(F.col("value") < 2, "").otherwise(F.col("lat").cast("string")).alias("lat"),
        F.col("lon").cast("string").alias("lon"),
    )
    out = ingest.prepare_gps_history(raw, order=("event_id",)).select(
        "event_id", "operational_date_0700", "session_file", "seq", "lat", "lon"
    )
    return rounded(out, "lat", "lon")


@query(
    "src_gpx_points",
    "select session_file, seq, timestamp + interval '9' hour as timestamp, round(lat, 6) as lat, round(lon, 6) as lon, elevation_m from points",
)
def _(t: Tables):
    # the nested form a GPX file is read into, one document per session
    point = F.struct(
        F.col("lat").alias("_lat"),
        F.col("lon").alias("_lon"),
        F.col("elevation_m").alias("ele"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
    )
    documents = t.points.groupBy("session_file").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))), lambda x: x["p"]
        ).alias("trkpt")
    )
    nested = documents.select(
        "session_file",
        F.array(F.struct(F.array(F.struct("trkpt")).alias("trkseg"))).alias("trk"),
    )
    return rounded(ingest.parse_gpx(nested), "lat", "lon")


@query(
    "src_road_parts",
    """select way_id, part_index, highway, round(degrees_x, 6) as first_lon, vertices from (
         select replace(way_id, 'w', '') as way_id, i as part_index, highway, 129.3 + (x0 + i) / 100000 as degrees_x, 2 + i as vertices
         from road_lines, (select unnest([0, 1]) as i))""",
)
def _(t: Tables):
    def vertex(dx: float, dy: float):
        return F.array(F.lit(129.3) + (F.col("x0") + dx) / 100000, F.lit(28.1) + (F.col("y0") + dy) / 100000)

    geometry = F.struct(
        F.lit("MultiLineString").alias("type"),
        F.array(
            F.array(vertex(0, 0), vertex(0, 50)), F.array(vertex(1, 0), vertex(1, 50), vertex(40, 90))
        ).alias("coordinates"),
    )
    tags = F.struct(F.concat(F.lit("way/"), "way_id").alias("@id"), "highway")
    text = F.to_json(
        F.struct(F.lit("Feature").alias("type"), tags.alias("properties"), geometry.alias("geometry"))
    )
    parsed = ingest.road_parts(ingest.parse_features(t.road_lines.select(text.alias("value"))))
    return with_degrees(parsed, "line[0].x", "line[0].y").select(
        "way_id",
        F.col("part_index").cast("bigint").alias("part_index"),
        "highway",
        F.round("lon", 6).alias("first_lon"),
        F.size("line").cast("bigint").alias("vertices"),
    )


@query(
    "src_context",
    """select context_class, half_w is not null as area, cast(case when half_w is null then null else i end as bigint) as ring,
              round(129.2 + (cx - coalesce(half_w, 0) * share) / 100000, 6) as lon, round(28.1 + (cy - coalesce(half_h, 0) * share) / 100000, 6) as lat,
              cast(case when half_w is not null then 5 when context_class = 'stream' then 2 else 1 end as bigint) as vertices
       from context, (values (0, 1.0::double), (1, 0.5::double)) as s(i, share) where i = 0 or (half_w is not null and has_hole)""",
)
def _(t: Tables):
    tag = {
        "stream": ("waterway", "river"),
        "coast": ("natural", "coastline"),
        "forest": ("landuse", "orchard"),
        "farmland": ("landuse", "meadow"),
        "residential": ("landuse", "residential"),
    }

    def property_of(key: str):
        chain = F.lit(None).cast("string")
        for name, (k, v) in tag.items():
            if k == key:
                chain = F.when(F.col("context_class") == name, v).otherwise(chain)
        return chain.alias(key)

    # the geometry is written as the files have it: points, lines, and polygons with their holes
    degrees = F.transform(
        "line", lambda c: F.array(F.lit(129.2) + c["x"] / 100000, F.lit(28.1) + c["y"] / 100000)
    )
    lines = context_lines(t).withColumn("c", degrees)
    shape = F.array_sort(F.collect_list(F.struct((-F.size("c")).alias("n"), F.col("c")[0][0].alias("west"), "c")))
    whole = lines.groupBy("feature_id", "context_class", "area_id").agg(F.transform(shape, lambda r: r["c"]).alias("rings"))
    kind = F.when(F.col("area_id").isNotNull(), "Polygon").when(F.col("context_class") == "stream", "LineString").otherwise("Point")
    raw = (
        F.when(kind == "Polygon", F.to_json("rings"))
        .when(kind == "LineString", F.to_json(F.col("rings")[0]))
        .otherwise(F.to_json(F.col("rings")[0][0]))
    )
    geometry = F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), raw, F.lit("}"))
    tags = F.to_json(F.struct("feature_id", *[property_of(k) for k in ("waterway", "natural", "landuse")]))
    text = F.concat(F.lit('{"type":"Feature","properties":'), tags, F.lit(',"geometry":'), geometry, F.lit("}"))
    parsed = ingest.context_features(ingest.parse_features(whole.select(text.alias("value"))))
    # holes of one area are told by their order from the west
    by_area = Window.partitionBy("area_id").orderBy("x0")
    ring = F.when(F.col("area_id").isNotNull(), F.row_number().over(by_area) - 1).cast("bigint")
    return with_degrees(parsed.withColumn("ring", ring), "line[0].x", "line[0].y").select(
        "context_class",
        F.col("area_id").isNotNull().alias("area"),
        "ring",
        F.round("lon", 6).alias("lon"),
        F.round("lat", 6).alias("lat"),
        F.size("line").cast("bigint").alias("vertices"),
    )


@query(
    "src_weather_hourly",
    "select station, timestamp, temperature_c, precip_mm from weather_hourly",
)
def _(t: Tables):
    hour = F.struct("timestamp", "temperature_c", "precip_mm")
    gathered = t.weather_hourly.groupBy("station").agg(F.array_sort(F.collect_list(hour)).alias("h"))
    arrays = F.struct(
        F.transform("h", lambda h: F.date_format(h["timestamp"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.transform("h", lambda h: h["temperature_c"]).alias("temperature_2m"),
        F.transform("h", lambda h: h["precip_mm"]).alias("precipitation"),
    )
    documents = gathered.select("station", F.to_json(F.struct(arrays.alias("hourly"))).alias("content"))
    return ingest.parse_weather(documents).select("station", "timestamp", "temperature_c", "precip_mm")


@query(
    "src_conflicts",
    """select operational_date_0700, status, include_by_default, '' as reason, source_evidence from population_conflicts""",
)
def _(t: Tables):
    raw = t.population_conflicts.withColumns(
        {
            "include_by_default": F.when(F.col("include_by_default"), " YES ").otherwise("no"),
            "reason": F.lit(None).cast("string"),
        }
    )
    return ingest.parse_conflicts(raw)


@query("src_nights", "select distinct operational_date_0700 from imported_nights")
def _(t: Tables):
    return ingest.candidate_nights(
        t.imported_nights.select(F.col("operational_date_0700").alias("date"), F.lit(1).alias("note"))
    )


@query(
    "inventory_by_hash",
    """select m.sha256, m.operational_night, f.file is not null as found, f.file
       from (select distinct sha256(text) as sha256, lang as operational_night from documents
             union select distinct sha256(text), role from conversations) m
       left join (select sha256(text) as sha256, max(cast(doc_id as varchar)) as file from documents group by 1) f using (sha256)""",
)
def _(t: Tables):
    files = t.documents.select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    hashed = F.sha2(F.col("text").cast("binary"), 256).alias("sha256")
    manifest = (
        t.documents.select(hashed, F.col("lang").alias("operational_night"))
        .union(t.conversations.select(hashed, F.col("role")))
        .distinct()
    )
    return ingest.inventory_by_hash(files, manifest)


# --- writers ---------------------------------------------------------------------------


@query(
    "sink_roundtrip",
    """select session_file, visit_index, segment_id, point_count, night,
              row_number() over (partition by night order by entered_at, session_file, visit_index) - 1 as place
       from (select *, cast(cast(entered_at - interval '7' hour as date) as string) as night from visits)""",
    *VISIT_TABLES,
)
def _(t: Tables):
    folder = f"{scratch_folder(t.spark)}/visits-{uuid.uuid4().hex}"
    sinks.write_table(
        visits(t), folder, night_of="entered_at", order=["entered_at", "session_file", "visit_index"], file_rows=2000
    )
    back = t.spark.read.parquet(folder).select("*", "_metadata.file_name", "_metadata.row_index")
    # the place of a row as it was written, not as its values say
    written = Window.partitionBy("night").orderBy("file_name", "row_index")
    return back.select(
        "session_file",
        "visit_index",
        "segment_id",
        "point_count",
        F.col("night").cast("string").alias("night"),
        (F.row_number().over(written) - 1).cast("bigint").alias("place"),
    )


@query(
    "route_layer",
    """select row_number() over (order by part, session_file, seq) as place, value from (
         select 0 as part, '' as session_file, 0 as seq, '{"type":"FeatureCollection","features":[' as value
         union all select 2, '', 0, ']}'
         union all select 1, session_file, seq,
           case when seq = low then case when session_file = least_one then '' else ',' end
             || '{"type":"Feature","properties":{"session_file":"' || session_file || '"},"geometry":{"type":"LineString","coordinates":[' else '' end
           || printf('[%.7f,%.7f]', lon, lat) || case when seq = high then ']}}' else ',' end
         from (select *, min(seq) over (partition by session_file) as low, max(seq) over (partition by session_file) as high from points
               where lon is not null and lat is not null),
              (select min(session_file) as least_one from (select session_file from points where lon is not null and lat is not null
                 group by 1 having count(*) > 1))
         where low < high)""",
)
def _(t: Tables):
    folder = f"{scratch_folder(t.spark)}/routes-{uuid.uuid4().hex}"
    sinks.write_text(sinks.route_text(t.points), folder, sinks.ROUTE_ORDER, file_rows=5000)
    back = t.spark.read.text(folder).select(
        "value", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")
    )
    # numbered by file, block and line, as they were written
    return arrange(back, [], ["file_name", "file_block_start", "line"]).running_sum(place=F.lit(1)).done().select(
        F.col("place").cast("bigint").alias("place"), "value"
    )


# --- recovery, model, flow -------------------------------------------------------------

# The given points are hours and kilometres apart; these limits make stretches of them.
LOOSE = RecoveryRules(
    min_points=3, event_distance_m=600.0, event_minutes=2880, loop_gap_m=500.0, loop_min_index=1, same_line_m=200.0
)


def _recovered(t: Tables):
    lone = t.field_events.withColumn("segment_id", F.lit(None).cast("string"))
    return recover_roads(t.points, lone, rules=LOOSE)


@query("recover_roads")
def _(t: Tables):
    return _recovered(t).roads.select(
        "road_id", "session_file", "source_seq_start", "source_seq_end", F.round("length_m", 4).alias("length_m")
    )


@query("recovered_segments")
def _(t: Tables):
    return _recovered(t).segments.select("segment_id", "segment_index", F.round("length_m", 4).alias("length_m"))


@query(
    "corroborate_blocks",
    """select distinct session_file, run_id from (
         select *, cast(sum(case when segment_id is null then 0 else 1 end) over (partition by session_file order by seq) as bigint) as run_id from points) p
       join (select session_file, run_id from (select *, cast(sum(case when segment_id is null then 0 else 1 end)
               over (partition by session_file order by seq) as bigint) as run_id from points)
             where segment_id is null group by 1, 2 having count(*) >= 3) r using (session_file, run_id)
       join (select * from field_events where species = 'ハブ' and event_type = 'capture' and x_m is not null) e
         on abs(date_diff('microsecond', e.timestamp, p.timestamp)) <= 172800000000
        and (e.x_m - p.x_m) * (e.x_m - p.x_m) + (e.y_m - p.y_m) * (e.y_m - p.y_m) <= 360000
       where p.segment_id is null""",
)
def _(t: Tables):
    from ..operators.recovery import corroborated_runs
    from ..operators.tracks import unmatched_runs

    triggers = evt.capture_filter(t.field_events).where("x_m is not null")
    return corroborated_runs(unmatched_runs(t.points, 3), triggers, LOOSE)


MODEL = Params(
    outcome_window_s=3 * 3600,
    baseline_cutoff=datetime(2024, 1, 20, 7),
    holdout_start=datetime(2024, 1, 20, 7),
)


def _learning(t: Tables):
    assigned = we.nearest_stations(segment_places(t), t.stations)
    return nightly.visit_features(
        visits(t), t.weather_hourly, t.field_events, MODEL, measure=t.point_rows, assigned=assigned
    )


@query("visit_features")
def _(t: Tables):
    return _learning(t)


@query("fit_model")
def _(t: Tables):
    train, _ = evt.split_cutoff(_learning(t), "entered_at", MODEL)
    return md.coefficient_table(md.fit_model(train), t.spark)


@query("loono_cv")
def _(t: Tables):
    train, _ = evt.split_cutoff(_learning(t), "entered_at", MODEL)
    return md.loono_cv(train)


@query("score_holdout")
def _(t: Tables):
    train, hold = evt.split_cutoff(_learning(t), "entered_at", MODEL)
    return md.score_holdout(md.fit_model(train), hold)


@query("learning_table")
def _(t: Tables):
    p = replace(MODEL, min_match_ratio=0.02, bio_windows_min=(30, 60, 120, 360), bio_distances_m=(100.0, 250.0, 500.0, 1000.0))
    events = t.field_events.drop("segment_id")
    tables = nightly.learning_table(
        t.points.drop("segment_id", "match_distance_m"),
        parts(t).withColumn("name", F.lit(None).cast("string")),
        events,
        t.weather_hourly,
        context_lines(t),
        CONTEXT_CLASSES,
        p,
        stations=t.stations,
    )
    return tables["learning"]
