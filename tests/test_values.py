"""Time, text, geodesy and geometry expressions."""

import math

import pytest
from helpers import at
from pyspark.sql import functions as F

from surveyspark.functions import geodesy as gd
from surveyspark.functions import polyline as pl
from surveyspark.functions import schema as sc
from surveyspark.functions import text as tx
from surveyspark.functions import timeops as to
from surveyspark.operators import events as evt


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expr.alias("r")).first()[0]


@pytest.mark.parametrize(
    "moment, night",
    [
        ("2026-07-23 00:00:00", "2026-07-22"),
        ("2026-07-23 05:23:00", "2026-07-22"),
        ("2026-07-23 06:59:59", "2026-07-22"),
        ("2026-07-23 07:00:00", "2026-07-23"),
    ],
)
def test_night_boundary(spark, moment, night):
    ts = F.lit(moment).cast("timestamp_ntz")
    assert one(spark, to.night_key(ts)) == night


def test_session_start_never_overrides_the_night(spark):
    df = spark.createDataFrame(
        [(at("2026-07-23 05:23:00"), at("2026-07-23 01:00:00"))],
        "timestamp timestamp_ntz, session_start timestamp_ntz",
    )
    assert evt.operational_night(df).first()["night_date"] == "2026-07-22"


def test_bin_floor(spark):
    ts = F.lit("2026-08-01 21:19:59.999").cast("timestamp_ntz")
    assert one(spark, to.bin_start(ts)) == at("2026-08-01 21:10:00")


def test_zoned_instants_become_wall_time(spark):
    assert one(spark, to.local_wall_time(F.lit("2026-08-01 15:30:00Z").cast("timestamp"))) == at("2026-08-02 00:30:00")


def test_activity_time_is_not_discovery_time(spark):
    seen, found = F.lit("2026-08-01 20:00:00"), F.lit("2026-08-01 23:00:00")
    none = F.lit(None).cast("string")
    assert one(spark, to.activity_time(F.lit("road_event"), found, none)) is None
    assert one(spark, to.activity_time(F.lit("road_event"), found, seen)) == "2026-08-01 20:00:00"
    assert one(spark, to.activity_time(F.lit("capture"), found, none)) == "2026-08-01 23:00:00"


@pytest.mark.parametrize(
    "text, species",
    [("ヒメハブ 目撃", "ヒメハブ"), ("ハブ捕獲大", "ハブ"), ("イシカワガエル", "イシカワガエル"), ("カエル", "カエル"), ("?", "その他")],
)
def test_species(spark, text, species):
    assert one(spark, tx.species(F.lit(text))) == species


@pytest.mark.parametrize("text, n", [("2匹", 2), ("なし", 1), ("２匹", 2), ("１２匹いた", 12), ("5匹以上", 5)])
def test_counts(spark, text, n):
    assert one(spark, tx.individual_count(F.lit(text))) == n


def test_event_fields(spark):
    note = "2026/8/1 21:00\n　捕獲　\nハブ捕獲大 ウェット\n28.15\n28.25\n129.3\n28.4129.5"
    r = evt.event_fields(spark.createDataFrame([(note,)], "raw_text string")).first()
    assert (r.event_type, r.species, r["size"], r.wetness, r.lat, r.lon) == ("捕獲", "ハブ", "大", "ウェット", 28.25, 129.3)


def test_angles(spark):
    assert one(spark, gd.angle_difference(F.lit(359.0), F.lit(1.0))) == 2.0
    assert one(spark, gd.angle_difference(F.lit(None).cast("double"), F.lit(1.0))) == 0.0
    assert one(spark, gd.axis_difference(F.lit(10.0), F.lit(185.0))) == 5.0


def vincenty(lat1, lon1, lat2, lon2):
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(p))) for p in (lat1, lat2))
    big = lam = math.radians(lon2 - lon1)
    for _ in range(50):
        s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sig = math.atan2(s, c)
        sa = math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        c2 = 1 - sa * sa
        cm = c - 2 * math.sin(u1) * math.sin(u2) / c2 if c2 else 0
        k = f / 16 * c2 * (4 + f * (4 - 3 * c2))
        lam = big + (1 - k) * f * sa * (sig + k * s * (cm + k * c * (2 * cm * cm - 1)))
    us = c2 * (a * a - b * b) / (b * b)
    aa = 1 + us / 16384 * (4096 + us * (us * (320 - 175 * us) - 768))
    bb = us / 1024 * (256 + us * (us * (74 - 47 * us) - 128))
    ds = bb * s * (cm + bb / 4 * (c * (2 * cm * cm - 1) - bb / 6 * cm * (4 * s * s - 3) * (4 * cm * cm - 3)))
    az = math.degrees(math.atan2(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam)))
    return b * aa * (sig - ds), az % 360


@pytest.mark.parametrize("to_lat, to_lon", [(28.12001, 129.30001), (28.1, 129.4), (28.2, 129.3), (28.12, 129.25)])
def test_geodesic_step(spark, to_lat, to_lon):
    distance, azimuth = gd.geodesic_step("28.12D", "129.3D", f"{to_lat}D", f"{to_lon}D")
    expected = vincenty(28.12, 129.3, to_lat, to_lon)
    assert one(spark, distance) == pytest.approx(expected[0], rel=1e-6)
    assert one(spark, azimuth) == pytest.approx(expected[1], abs=1e-4)


def test_projection_keeps_lengths_and_inverts(spark):
    df = spark.createDataFrame([(28.12, 129.30), (28.121, 129.302), (28.4, 129.5), (33.0, 129.5)], "lat double, lon double")
    placed = gd.with_plane(df)
    back = gd.with_degrees(placed, "x_m", "y_m", "lat2", "lon2").collect()
    for r in back:
        assert r.lat2 == pytest.approx(r.lat, abs=1e-11) and r.lon2 == pytest.approx(r.lon, abs=1e-11)
    a, b, c, origin = back
    truth = vincenty(a.lat, a.lon, b.lat, b.lon)[0]
    # scale on the plane near the axis is k0 times one plus a tiny term
    scale = 0.9999 * (1 + (a.x_m**2) / (2 * 6371000.0**2))
    assert math.hypot(a.x_m - b.x_m, a.y_m - b.y_m) == pytest.approx(truth * scale, rel=1e-6)
    assert origin.x_m == pytest.approx(0, abs=1e-6) and origin.y_m == pytest.approx(0, abs=1e-6)


def line(spark, *points):
    return spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in points],)], f"line {pl.LINE_TYPE}")


def test_polyline_measures(spark):
    df = line(spark, (0, 0), (30, 0), (30, 40))
    get = lambda text: df.select(F.expr(text)).first()[0]
    assert get(pl.length("line")) == 70
    assert get(pl.curvature("line")) == pytest.approx(90)
    assert get(pl.line_bearing("line")) == pytest.approx(math.degrees(math.atan2(30, 40)))
    assert get(pl.point_to_line("10D", "5D", "line")) == 5
    assert [get(t) for t in pl.centroid("line")] == pytest.approx([(30 * 15 + 40 * 30) / 70, 40 * 20 / 70])
    assert get(pl.hausdorff("line", "transform(line, q -> named_struct('x', q.x + 3D, 'y', q.y + 4D))")) == pytest.approx(5)


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1.0, 2)], "a double, b int")
    with pytest.raises(ValueError, match="c"):
        sc.require_columns(df, ["a", "c"])
    assert sc.with_default_columns(df, c=("x", "string")).first()["c"] == "x"
    assert sc.first_present_column(df, ["z", "b"]) == "b"
    nan = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert [r[0] for r in nan.select(sc.finite(F.col("v"))).collect()] == [None, None, 1.0]
