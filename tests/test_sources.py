"""Readers and writers on real files."""

import hashlib
import json

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from surveyspark.functions import polyline as pl
from surveyspark.operators import evidence as ev
from surveyspark.sources import ingest, sinks


def point(lat, time, ele="<ele>5.5</ele>"):
    stamp = f"<time>{time}</time>" if time else ""
    return f'<trkpt lat="{lat}" lon="129.3">{ele}{stamp}</trkpt>'


def test_gpx(spark, tmp_path):
    body = "".join(
        [
            "<gpx><trk><trkseg>", point(28.1, "2026-08-01T11:00:00Z"), point(28.2, None), "</trkseg><trkseg>",
            point(28.3, "2026-08-01T20:00:02+09:00"), "</trkseg></trk><trk><trkseg>",
            point(28.4, "2026-08-01T11:00:03", ""), "</trkseg></trk></gpx>",
        ]
    )
    (tmp_path / "night.gpx").write_text(body)
    (tmp_path / "empty.gpx").write_text("")
    out = ingest.read_gpx(spark, str(tmp_path))
    assert rows(out) == [
        ("night.gpx", 0, at("2026-08-01 20:00:00"), 28.1, 129.3, 5.5),
        ("night.gpx", 1, at("2026-08-01 20:00:02"), 28.3, 129.3, 5.5),
        ("night.gpx", 2, at("2026-08-01 20:00:03"), 28.4, 129.3, None),
    ]


def feature(kind, coordinates, **tags):
    return {"type": "Feature", "properties": tags, "geometry": {"type": kind, "coordinates": coordinates}}


@pytest.mark.parametrize("layout", ["one_line", "pretty", "per_line"])
def test_roads_in_any_layout(spark, tmp_path, layout):
    features = [
        feature("LineString", [[129.3, 28.1], [129.31, 28.1]], **{"@id": "way/12w", "highway": "track"}),
        feature("MultiLineString", [[[129.3, 28.1], [129.3, 28.2]], [[129.3, 28.2], [129.4, 28.2]]], osm_id="7", name="n"),
        feature("Point", [129.3, 28.1], highway="stop"),
    ]
    if layout == "per_line":
        text = '{"type":"FeatureCollection","features":[\n' + ",\n".join(json.dumps(f) for f in features) + "\n]}"
    else:
        text = json.dumps({"type": "FeatureCollection", "features": features}, indent=None if layout == "one_line" else 2)
    (tmp_path / "roads.geojson").write_text(text)
    out = ingest.road_parts(ingest.read_features(spark, str(tmp_path / "roads.geojson")))
    assert rows(out, "way_id", "part_index", "highway", F.size("line")) == [
        ("12", 0, "track", 2), ("7", 0, None, 2), ("7", 1, None, 2),
    ]
    length = out.where("way_id = '12'").select(F.expr(pl.length("line"))).first()[0]
    assert length == pytest.approx(982.5, abs=1.0)


def test_context_classes(spark, tmp_path):
    ring = [[129.3, 28.1], [129.31, 28.1], [129.31, 28.11], [129.3, 28.1]]
    hole = [[129.305, 28.101], [129.306, 28.101], [129.306, 28.102], [129.305, 28.101]]
    features = [
        feature("LineString", [[129.3, 28.1], [129.31, 28.1]], waterway="river"),
        feature("Polygon", [ring, hole], natural="wood", landuse="residential"),
        feature("Point", [129.3, 28.1], landuse="meadow"),
        feature("Point", [129.3, 28.1], landuse="meadow", name="another feature at the same place"),
        feature("Point", [129.3, 28.1], shop="x"),
        feature("MultiPoint", [[129.3, 28.1], [129.4, 28.1]], natural="coastline"),
        feature("MultiPolygon", [[ring], [hole]], landuse="farmyard"),
        {"type": "Feature", "properties": {"waterway": "weir"}, "geometry": None},
        {
            "type": "Feature",
            "properties": {"natural": "coastline"},
            "geometry": {
                "type": "GeometryCollection",
                "geometries": [{"type": "Point", "coordinates": [129.3, 28.1]}, {"type": "Polygon", "coordinates": [ring]}],
            },
        },
    ]
    (tmp_path / "c.geojson").write_text("\n".join(json.dumps(f) for f in features))
    out = ingest.context_features(ingest.read_features(spark, str(tmp_path)))
    found = out.groupBy("context_class").agg(
        F.count("*"), F.countDistinct("feature_id"), F.count("area_id"), F.countDistinct("area_id")
    )
    assert rows(found) == [
        ("coast", 4, 2, 1, 1),
        ("farmland", 4, 3, 2, 2),
        ("forest", 2, 1, 2, 1),
        ("residential", 2, 1, 2, 1),
        ("stream", 1, 1, 0, 0),
    ]
    odd = [feature("Circle", [129.3, 28.1], landuse="meadow")]
    (tmp_path / "c.geojson").write_text(json.dumps(odd[0]))
    with pytest.raises(Exception, match="geometry not known"):
        ingest.context_features(ingest.read_features(spark, str(tmp_path))).collect()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_no_feature_is_lost_to_its_values(spark, tmp_path, end):
    features = [
        feature("Point", [129.3, 28.1], role="Feature"),
        feature("Point", [129.3, 28.2], note='says "Feature" twice'),
        feature("Point", [129.3, 28.3]),
    ]
    (tmp_path / "lines.geojson").write_text(end.join(json.dumps(f) for f in features))
    assert ingest.read_features(spark, str(tmp_path)).count() == 3
    # several features on one line are all read; a line with anything behind them is an error
    (tmp_path / "lines.geojson").write_text(",".join(json.dumps(f) for f in features))
    assert ingest.read_features(spark, str(tmp_path)).count() == 3
    for rest in (json.dumps(features[0]), '{"type": "Topology"}', "x"):
        (tmp_path / "lines.geojson").write_text(json.dumps(features[2]) + " " + rest)
        with pytest.raises(Exception, match="or not whole"):
            ingest.read_features(spark, str(tmp_path)).collect()


def test_areas_hold_segments(spark, tmp_path):
    from surveyspark.functions.geodesy import with_plane
    from surveyspark.operators import features as ft

    def square(west, south, size):
        return [[west, south], [west + size, south], [west + size, south + size], [west, south + size], [west, south]]

    features = [
        feature("Polygon", [square(129.30, 28.10, 0.02), square(129.305, 28.105, 0.005)], natural="wood"),
        feature("MultiPolygon", [[square(129.40, 28.10, 0.01)], [square(129.42, 28.10, 0.01)]], landuse="residential"),
        feature("LineString", [[129.3, 28.2], [129.4, 28.2]], waterway="river"),
    ]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    context = ingest.context_features(ingest.read_features(spark, str(tmp_path)))
    places = [("in", 28.102, 129.302), ("hole", 28.107, 129.307), ("second", 28.105, 129.425), ("out", 28.15, 129.35)]
    segments = with_plane(spark.createDataFrame(places, "segment_id string, lat double, lon double"))
    segments = segments.withColumnsRenamed({"x_m": "segment_x_m", "y_m": "segment_y_m"})
    out = ft.nearest_context(segments, context, classes=("forest", "residential", "stream", "coast")).collect()
    got = {r["segment_id"]: r for r in out}
    assert len(out) == 4 and all(r["coast_distance_m"] is None for r in out)
    assert got["in"]["forest_distance_m"] == 0 and got["second"]["residential_distance_m"] == 0
    assert 150 < got["hole"]["forest_distance_m"] < 250  # the way to the hole's edge
    assert got["out"]["forest_distance_m"] > 3000 and got["out"]["stream_distance_m"] == pytest.approx(5541, abs=20)


LOG = """2026/8/1 20:00
エリア探索開始
2026/8/1 21:10
捕獲
ハブ捕獲大 2匹
28.15
129.31
28.1629.9

2026/8/2 01:05:30
　目撃　
イシカワガエル
2026/8/2 02:52
エリア探索終了
"""


def test_field_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    out = ingest.parse_field_log(ingest.read_documents(spark, str(tmp_path)))
    assert rows(out, "timestamp", "session_start", "event_type", "species", "individual_count", "lat", "lon", "night_date") == [
        (at("2026-08-01 21:10:00"), at("2026-08-01 20:00:00"), "捕獲", "ハブ", 2, 28.15, 129.31, "2026-08-01"),
        (at("2026-08-02 01:05:30"), at("2026-08-01 20:00:00"), "目撃", "イシカワガエル", 1, None, None, "2026-08-01"),
    ]
    assert out.where("event_type = '捕獲'").first().raw_text.splitlines()[0] == "2026/8/1 21:10"


def test_session_markers(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    out = ingest.parse_session_markers(ingest.read_documents(spark, str(tmp_path)))
    digest = hashlib.sha256(LOG.encode()).hexdigest()
    assert rows(out) == [
        ("2026-08-01", "SEARCH_END", "log.txt", "2026-08-02T02:52:00+09:00", digest, "STRONG_SESSION_MARKER", "line=14; marker=エリア探索終了"),
        ("2026-08-01", "SEARCH_START", "log.txt", "2026-08-01T20:00:00+09:00", digest, "STRONG_SESSION_MARKER", "line=2; marker=エリア探索開始"),
    ]
    assert rows(ev.nights_of(out)) == [("2026-08-01",)]
    assert ingest.combine_manifests(out, out).count() == 2


def test_history_and_registries(spark, tmp_path):
    (tmp_path / "h.csv").write_text("timestamp,lat,lon\n2026-07-23 06:59:00,28.1,129.3\n2026-07-23 07:01:00,28.1,129.3\nbad,1,1\n2026-07-23 08:00:00,x,1\n")
    out = ingest.read_gps_history(spark, str(tmp_path / "h.csv"))
    assert rows(out, "session_file", "seq") == [("gps_history:2026-07-22", 0), ("gps_history:2026-07-23", 0)]
    with pytest.raises(ValueError, match="lon"):
        ingest.prepare_gps_history(out.drop("lon"))
    (tmp_path / "n.csv").write_text("date,x\n2026-01-02,1\n2026-01-02,2\n,3\n")
    assert rows(ingest.candidate_nights(ingest.read_csv(spark, str(tmp_path / "n.csv")))) == [("2026-01-02",)]


@pytest.mark.parametrize("column", ["sha256", "raw_sha256"])
def test_inventory(spark, tmp_path, column):
    folder = tmp_path / column
    folder.mkdir()
    (folder / "renamed.bin").write_bytes(b"abc")
    (folder / "empty.bin").write_bytes(b"")
    wanted = [(hashlib.sha256(b"abc").hexdigest(), "n1"), (hashlib.sha256(b"").hexdigest(), "n2")]
    manifest = spark.createDataFrame(wanted, f"{column} string, operational_night string")
    out = ingest.inventory_by_hash(ingest.read_binary(spark, str(folder)), manifest)
    assert rows(out, "operational_night", "found", "file") == [("n1", True, "renamed.bin"), ("n2", False, None)]
    assert tuple(ingest.inventory_status(out).first()) == (2, 1, 1, False)


def test_weather_document(spark):
    doc = json.dumps({"hourly": {"time": ["2026-08-01T00:00", "2026-08-01T01:00"], "temperature_2m": [25.0, None], "precipitation": [0.0, 1.5]}})
    out = ingest.parse_weather(spark.createDataFrame([("st", doc)], "station string, content string"))
    assert rows(out, "timestamp", "temperature_c", "precip_mm", "humidity_pct") == [
        (at("2026-08-01 00:00:00"), 25.0, 0.0, None), (at("2026-08-01 01:00:00"), None, 1.5, None),
    ]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_tables_are_partitioned_by_night(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, at("2026-08-01 20:00")), (2, at("2026-08-02 03:00")), (3, at("2026-08-02 20:00"))], "a int, entered_at timestamp_ntz")
    sinks.write_table(df, str(tmp_path / "t"), night_of="entered_at", fmt=fmt)
    back = spark.read.format(fmt).option("header", True).load(str(tmp_path / "t"))
    assert rows(back.groupBy("night").count().select(F.col("night").cast("string"), "count")) == [("2026-08-01", 2), ("2026-08-02", 1)]


def test_written_order_and_file_sizes(spark, tmp_path):
    import random

    pick = random.Random(4)
    df = spark.createDataFrame(
        [(k, pick.randrange(900), at("2026-08-01 20:00") if k % 10 else at("2026-08-05 20:00")) for k in range(3000)],
        "a int, b int, entered_at timestamp_ntz",
    ).repartition(7)
    for night_of, parts in (("entered_at", "night"), (None, None)):
        folder = str(tmp_path / f"t-{parts}")
        sinks.write_table(df, folder, night_of=night_of, order=["b", "a"], file_rows=500)
        back = spark.read.parquet(folder).select("*", "_metadata.file_path", "_metadata.file_name", "_metadata.row_index").collect()
        assert len(back) == 3000
        groups = {}
        for r in sorted(back, key=lambda r: (r.file_name, r.row_index)):
            groups.setdefault(str(r.night) if parts else "", []).append((r.b, r.a))
        assert all(g == sorted(g) for g in groups.values()) and len(groups) == (2 if parts else 1)
        files = {}
        for r in back:
            files[r.file_path] = files.get(r.file_path, 0) + 1
        assert max(files.values()) <= 1000 and 6 <= len(files) <= 8


def test_a_join_that_multiplies_rows_is_told(spark):
    from surveyspark.operators.contracts import RowGuard

    df = spark.range(5)
    for copies, fails in ((1, False), (2, True)):
        guard = RowGuard()
        guard.watched(df, "before").collect()
        other = spark.createDataFrame([(k,) for k in range(4) for _ in range(copies)], "id long")
        guard.watched(df.join(other, "id"), "after").collect()
        if fails:
            with pytest.raises(ValueError, match="after has 8 rows"):
                guard.not_more("after", "before")
        else:
            guard.not_more("after", "before")


def test_layers_and_summaries(spark, tmp_path):
    road = spark.createDataFrame([("s", [(0.0, -500000.0), (10.0, -500010.0)])], "segment_id string, line array<struct<x:double,y:double>>")
    layer = sinks.geojson_features(road, sinks.plane_line_geometry("line"), ["segment_id"])
    sinks.write_lines(layer, str(tmp_path / "layer"))
    written = json.loads(spark.read.text(str(tmp_path / "layer")).first()[0])
    assert written["properties"] == {"segment_id": "s"} and written["geometry"]["type"] == "LineString"
    assert written["geometry"]["coordinates"][0][0] == pytest.approx(129.5)
    again = ingest.road_parts(ingest.parse_features(layer)).select("line").first()[0]
    assert (again[1].x, again[1].y) == pytest.approx((10.0, -500010.0), abs=1e-6)
    sinks.write_summary(spark.createDataFrame([(3,)], "n int"), str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).first().n == 3


def test_byte_order_mark_does_not_hide_the_first_marker(spark):
    from surveyspark.sources import ingest

    text = "\ufeff2026/08/28 21:00\nエリア探索開始\n2026/08/28 23:00\nエリア探索終了\n"
    documents = spark.createDataFrame([("log.txt", text)], "file string, content string")
    kinds = [r.evidence_type for r in ingest.parse_session_markers(documents).orderBy("source_timestamp").collect()]
    assert kinds == ["SEARCH_START", "SEARCH_END"]


def test_features_of_mixed_layouts_and_any_key_order(spark, tmp_path):
    points = [feature("Point", [129.3, 28.1], n=str(i)) for i in range(9)]
    turned = [dict(reversed(f.items())) for f in points[:4]]
    (tmp_path / "a.geojson").write_text("﻿" + "\n".join(json.dumps(f) for f in turned))
    (tmp_path / "b c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": points[4:6]}))
    # one feature on a line of its own, one over several lines, one of which the text names another
    named = feature("Point", [129.3, 28.1], n="8", note="Feature")
    body = ",\n".join([json.dumps(points[6]), json.dumps(points[7], indent=1), json.dumps(named)])
    (tmp_path / "d.geojson").write_text('{"type": "FeatureCollection", "features": [\n' + body + "\n]}")
    out = ingest.read_features(spark, str(tmp_path))
    assert sorted(r.properties["n"] for r in out.collect()) == [str(i) for i in range(9)]


def test_history_times_with_and_without_a_zone(spark):
    times = ["2026-08-01T13:00:00Z", "2026-08-01T22:00:00+09:00", "2026-08-01 22:00:00", "2026-08-01", "no time"]
    raw = spark.createDataFrame([(t, "28.1", "129.3") for t in times], "timestamp string, lat string, lon string")
    out = ingest.prepare_gps_history(raw)
    assert sorted(r.timestamp for r in out.collect()) == [at("2026-08-01 00:00:00")] + [at("2026-08-01 22:00:00")] * 3
