"""A whole nightly run on the smallest given tables, read back from its folder."""

import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from surveyspark.operators.recovery import RecoveryRules
from surveyspark.plans import nightly
from surveyspark.plans.queries_flow import MODEL
from surveyspark.plans.queries_geo import CONTEXT_CLASSES, context_lines, parts
from surveyspark.plans.registry import Tables
from surveyspark.sources import sinks

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")
def test_whole_run(spark, tmp_path):
    t = Tables(spark, FOLDER)
    p = replace(MODEL, min_match_ratio=0.02, bio_windows_min=(60,), bio_distances_m=(500.0,))
    out = nightly.run(
        t.points.drop("segment_id", "match_distance_m"),
        parts(t).withColumn("name", F.lit(None).cast("string")),
        t.field_events.drop("segment_id").withColumn("size", F.lit("大")),
        t.weather_hourly,
        str(tmp_path),
        context=context_lines(t),
        context_classes=CONTEXT_CLASSES,
        p=p,
        rules=RecoveryRules(min_points=1000),
        stations=t.stations,
        snapshots=t.forecast_snapshots,
        main=(0, 720),
        secondary=(720, 1440),
    )
    read = lambda name: spark.read.json(f"{tmp_path}/reports/{name}")
    learning = spark.read.parquet(f"{tmp_path}/tables/learning")
    before = learning.where(F.col("entered_at") < F.lit(p.baseline_cutoff).cast("timestamp_ntz"))
    assert learning.count() == out["learning"].count() > 0

    steps = {r.step: r.status for r in read("steps").collect()}
    assert len(steps) == 7 and steps["5_bio_time_and_distance"] == "complete"
    assert steps["4_weather_join"] == "incomplete"  # these tables have no humidity
    qa = read("qa").first()
    assert qa.learning_rows == before.count() and qa.duplicates_removed == qa.raw_event_rows - qa.deduplicated_event_rows
    assert read("unmatched").count() == qa.baseline_unmatched_capture_events > 0
    assert steps["2_captures_on_segments"] == "partial" and steps["7_prediction_actual_scoring"] == "complete"

    forecast = read("forecast").first()
    ranked = [r.segment_id for r in out["ranking"].collect()]
    assert forecast.status == "ok" and forecast.top_segment_ids == ranked

    # no capture lies on a road before the cutoff here, so there is nothing to fit
    assert read("model").first().status == "insufficient-data"
    assert before.where("target_capture = 1").count() == 0 and "holdout" not in out and not (tmp_path / "model").exists()

    segments = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/layers/segments").collect()]
    assert len(segments) == out["segments"].count()
    assert sum(s["properties"]["visits"] for s in segments) == before.count()
    assert all(len(s["geometry"]["coordinates"]) >= 2 for s in segments)


def test_routes_are_one_document(spark, tmp_path):
    rows = [(s, k, 129.0 + k / 7, 28.0 + k / 9) for s in ('a"b', "c", "d") for k in range(40)] + [("lone", 0, 1.0, 2.0), ("c", 99, None, 1.0)]
    df = spark.createDataFrame(rows, "session_file string, seq int, lon double, lat double").repartition(7)
    sinks.write_text(sinks.route_text(df), str(tmp_path / "r"), sinks.ROUTE_ORDER, file_rows=20)
    files = sorted(tmp_path.glob("r/part-*"))
    document = json.loads("".join(f.read_text() for f in files))
    assert len(files) > 3 and [f["properties"]["session_file"] for f in document["features"]] == ['a"b', "c", "d"]
    for feature in document["features"]:
        places = feature["geometry"]["coordinates"]
        assert places == [[round(129.0 + k / 7, 7), round(28.0 + k / 9, 7)] for k in range(40)]
    sinks.write_text(sinks.route_text(df.limit(0)), str(tmp_path / "e"), sinks.ROUTE_ORDER)
    assert json.loads("".join(f.read_text() for f in sorted(tmp_path.glob("e/part-*")))) == {"type": "FeatureCollection", "features": []}


def test_reports_of_one_class_and_of_nothing(spark):
    from surveyspark.operators import model as md
    from surveyspark.operators import report as rp

    schema = "segment_id string, entered_at timestamp_ntz, target_capture int, target_individuals int, elevation_m double"
    empty = spark.createDataFrame([], schema)
    row = rp.forecast_summary(empty).first()
    assert (row.status, row.top_segment_ids, row.provisional_peak_start) == ("no-data", [], None)
    report, folds = md.model_report(empty, None)
    assert report.first().status == "insufficient-data" and folds.count() == 0


def test_learning_table_recovers_roads_by_the_field_rules(spark, monkeypatch):
    import inspect

    from surveyspark.operators.recovery import RecoveryRules
    from surveyspark.plans import nightly
    from surveyspark.plans.catalog import QUERIES

    asked = []
    shape = inspect.signature(nightly.learning_table)

    def noted(*args, **named):
        call = shape.bind(*args, **named)
        call.apply_defaults()
        asked.append(call.arguments["rules"])
        return {"learning": None}

    monkeypatch.setattr(nightly, "learning_table", noted)
    QUERIES["learning_table"](spark, "/root/testdata/sf0.001")
    assert asked == [RecoveryRules()]
