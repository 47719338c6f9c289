"""Night population, classes, gates, intervals and contracts."""

import pytest
from helpers import at, minutes, rows
from pyspark.sql import functions as F

from surveyspark.operators import contracts as ct
from surveyspark.operators import events as evt
from surveyspark.operators import evidence as ev
from surveyspark.operators import intervals as iv
from surveyspark.operators import tracks as tr
from surveyspark.plans import audit as plan
from surveyspark.sources import ingest

POINTS = "session_file string, seq bigint, timestamp timestamp_ntz, lat double, lon double, segment_id string"
EVENTS = "event_id int, timestamp timestamp_ntz, event_type string, species string, lat double, lon double"


def track(spark, matched, total=120):
    times = minutes("2026-08-20 20:00", total)
    return spark.createDataFrame(
        [("a.gpx", i, t, 28.1, 129.3, "s" if i < matched else None) for i, t in enumerate(times)], POINTS
    )


def no_events(spark):
    return spark.createDataFrame([], EVENTS)


@pytest.mark.parametrize(
    "matched, label, strict", [(120, "NO_CAPTURE_OBSERVED", True), (95, "Unknown", False), (96, "NO_CAPTURE_OBSERVED", True)]
)
def test_track_nights(spark, matched, label, strict):
    points = track(spark, matched)
    audit = ev.gpx_gate(ev.night_audit(points, no_events(spark)), points).collect()
    assert len(audit) == 1
    assert audit[0]["classification"] == "ACTUAL_GPX"
    assert audit[0]["night_observation_label"] == label
    assert audit[0]["usable_road_10min_train"] is strict
    assert audit[0]["usable_road"] is True


def test_ordinary_events_add_no_night_but_markers_do(spark):
    lone = spark.createDataFrame([(1, at("2026-08-20 22:00"), "roadkill_sighting", "カエル", None, None)], EVENTS)
    assert ev.night_audit(track(spark, 0).limit(0), lone).isEmpty()
    marker = spark.createDataFrame([(1, at("2026-08-21 02:52"), "search_end", None, None, None)], EVENTS)
    audit = ev.night_audit(track(spark, 0).limit(0), marker).collect()
    assert [(r[ev.NIGHT], r.classification, r.night_observation_label) for r in audit] == [
        ("2026-08-20", "UNRECONSTRUCTABLE", "Unknown")
    ]


HISTORY = "timestamp timestamp_ntz, lat double, lon double, segment_id string, match_distance_m double, strict_temporal_route_verified boolean"


@pytest.mark.parametrize(
    "matched, verified, strict", [(0, False, False), (30, False, False), (30, True, True), (15, True, False)]
)
def test_dense_history(spark, matched, verified, strict):
    times = minutes("2026-08-20 20:00", 30, 8)
    history = spark.createDataFrame(
        [(t, 28.1, 129.3, "s" if i < matched else None, 10.0, verified) for i, t in enumerate(times)], HISTORY
    )
    r = ev.night_audit(track(spark, 0).limit(0), no_events(spark), history).first()
    assert r.classification == "RECONSTRUCTED_GPS_HIGH"
    assert r.can_generate_no_capture_observed is strict
    assert (r.route_confidence, r.time_confidence) == (0.85, 0.82)


@pytest.mark.parametrize("count, name", [(5, "RECONSTRUCTED_PARTIAL"), (2, "SPATIAL_ONLY_RECONSTRUCTION")])
def test_sparse_history(spark, count, name):
    history = spark.createDataFrame(
        [(t, 28.1, 129.3) for t in minutes("2026-08-20 20:00", count, 22)], "timestamp timestamp_ntz, lat double, lon double"
    )
    r = ev.night_audit(track(spark, 0).limit(0), no_events(spark), history).first()
    assert r.classification == name and r.gps_anchor_count == count


def test_history_summary_same_when_the_night_is_cut(spark):
    times = minutes("2026-08-20 20:00", 40, 3) + minutes("2026-08-20 20:01", 9, 11)
    history = spark.createDataFrame(
        [(t, 28.1, 129.3 + i, "s" if i % 3 else None, float(i), True) for i, t in enumerate(times)], HISTORY
    )
    whole, cut = (rows(ev.history_night_summary(history, group_rows=g)) for g in (None, 4))
    assert whole == cut and len(whole) == 1


def test_positive_night(spark):
    caught = spark.createDataFrame([(1, at("2026-08-20 22:00"), "捕獲", "ハブ", 28.1, 129.3)], EVENTS)
    r = ev.night_audit(track(spark, 120), caught).first()
    assert (r.night_observation_label, r.capture_outcome, r.capture_count) == ("Positive", "CAPTURED", 1)


def test_strong_nights(spark):
    df = spark.createDataFrame(
        [
            (at("2026-05-01 22:00"), "capture", None),
            (at("2026-05-02 22:00"), "no_capture", None),
            (at("2026-05-03 22:00"), "capture_or_sighting", None),
            (at("2026-05-04 22:00"), "capture", " TRUE "),
            (at("2026-05-05 22:00"), "capture", "他者捕獲"),
        ],
        "timestamp timestamp_ntz, event_type string, other_capture string",
    )
    assert rows(ev.strong_nights(df)) == [("2026-05-01",), ("2026-05-02",)]


def test_dense_nights(spark):
    times = ["2026-05-02 20:00", "2026-05-02 20:30", "2026-05-02 21:00", "2026-05-02 21:40", "2026-05-02 22:04"]
    night = [(at(t), "sighting", f"p{i % 4}") for i, t in enumerate(times)]
    short = [(at(f"2026-05-09 20:0{i}"), "sighting", "p") for i in range(4)]
    late = [(at(f"2026-07-27 0{i}:10"), "weather", f"p{i}") for i in range(5)]
    blank = [(at(f"2026-07-30 2{i % 4}:1{i}"), "weather", " ") for i in range(5)]
    df = spark.createDataFrame(night + short + late + blank, "timestamp timestamp_ntz, event_type string, place string")
    assert rows(ev.dense_nights(df)) == [("2026-05-02",), ("2026-07-26",)]
    assert ("2026-07-30",) in rows(ev.dense_nights(df.drop("place")))


def conflicts(spark):
    raw = spark.createDataFrame(
        [
            ("2026-05-01", "SOURCE_CONFLICT", "false", None, "x"),
            ("2026-05-02", "WEAK_EVENT_ONLY", " Yes", "r", "x"),
            ("2026-05-03", "DUPLICATE_SUSPECT", "", "r", "x"),
            ("2026-05-04", "CONFIRMED", "0", "r", "x"),
        ],
        f"{ev.NIGHT} string, status string, include_by_default string, reason string, source_evidence string",
    )
    return ingest.parse_conflicts(raw)


def test_quarantine(spark):
    nights = spark.createDataFrame([(f"2026-05-0{i}",) for i in (1, 2, 3, 4)], f"{ev.NIGHT} string")
    kept, removed = ev.quarantine(nights, conflicts(spark))
    assert rows(kept) == [("2026-05-02",), ("2026-05-04",)]
    assert rows(removed, ev.NIGHT) == [("2026-05-01",), ("2026-05-03",)]
    merged = ev.merge_quarantine(removed, conflicts(spark).withColumn("status", F.lit("later")))
    assert rows(merged, ev.NIGHT, "status")[:2] == [("2026-05-01", "SOURCE_CONFLICT"), ("2026-05-02", "later")]


def test_whole_audit_and_checks(spark):
    points = track(spark, 96)
    events = spark.createDataFrame([(1, at("2026-05-01 22:00"), "capture", "ハブ", None, None)], EVENTS)
    imported = spark.createDataFrame([("2026-05-03",), ("2026-05-09",)], f"{ev.NIGHT} string")
    audit = plan.evidence_audit(points, events, None, conflicts(spark), imported)
    assert rows(audit, ev.NIGHT, "classification") == [("2026-05-09", "UNRECONSTRUCTABLE"), ("2026-08-20", "ACTUAL_GPX")]
    summary = {r.classification: r.night_count for r in ev.audit_summary(audit).collect()}
    assert summary["ACTUAL_GPX"] == 1 and summary["RECONSTRUCTED_PARTIAL"] == 0 and len(summary) == 5
    check = ev.audit_checks(audit, conflicts(spark), expected_nights=2).first()
    assert check.expected_count_met and check.classes_complete and check.duplicated_nights == 0
    assert check.conflict_nights_in_audit == 0
    assert not ev.audit_checks(audit, conflicts(spark), expected_nights=3).first().expected_count_met


@pytest.mark.parametrize("flags, kept", [("1" * 7 + "0" * 3, 0), ("1" * 8 + "0" * 2, 8)])
def test_session_gate(spark, flags, kept):
    df = spark.createDataFrame([("a", "s" if f == "1" else None) for f in flags], "session_file string, segment_id string")
    out = tr.session_gate(df)
    assert out.count() == 10 and out.where("segment_id is not null").count() == kept


def test_history_match_summary(spark):
    df = spark.createDataFrame(
        [(at(f"2026-08-20 20:0{i}"), "s" if d else None, d) for i, d in enumerate([5.0, 10.0, 15.0, 20.0, None])],
        "timestamp timestamp_ntz, segment_id string, match_distance_m double",
    )
    r = ev.history_match_summary(df).first()
    assert (r.anchor_count, r.matched_anchor_count, r.match_ratio, r.median_match_distance_m) == (5, 4, 0.8, 12.5)
    assert tuple(ev.strict_history_nights(ev.history_match_summary(df)).first()) == (1, 1)


def test_intervals(spark):
    df = spark.createDataFrame(
        [
            (1, at("2026-08-20 21:01"), at("2026-08-20 21:09"), "UNIQUE_ROUTE"),
            (2, at("2026-08-20 21:08"), at("2026-08-20 21:11"), "確定一本道区間"),
            (3, at("2026-08-20 21:01"), at("2026-08-20 21:02"), "ALTERNATIVE"),
            (4, at("2026-08-20 21:05"), None, "UNIQUE_ROUTE"),
        ],
        "pair_no int, start_time timestamp_ntz, end_time timestamp_ntz, route_class string",
    )
    verified = iv.verify_intervals(df)
    assert [r[0] for r in verified.orderBy("pair_no").select("verification_reason").collect()] == [
        "unique_route_inside_single_10min_bin", "crosses_10min_bin", "route_not_unique", "invalid_or_missing_anchor_time",
    ]
    events = spark.createDataFrame(
        [(1, at("2026-08-20 21:09"), "capture", "ハブ", None, None), (2, at("2026-08-20 21:03"), "sighting", "ヒメハブ", None, None)],
        EVENTS,
    )
    with pytest.raises(ValueError):
        iv.label_intervals(verified, events, interval_id=["pair_no"])
    strict = verified.where("strict_road10_verified")
    labelled = iv.label_intervals(strict, events, interval_id=["pair_no"]).first()
    assert (labelled.label, labelled.target_event_types) == ("Positive", "capture")
    other = iv.label_intervals(strict, events.where("event_id = 2"), interval_id=["pair_no"]).first()
    assert (other.label, other.target_event_types, other.target_event_count) == ("NO_CAPTURE_OBSERVED", "", 0)


def test_dedupe_keeps_count_and_rows_without_position(spark):
    base = (at("2026-08-20 21:00"), "ハブ", "捕獲", 28.1, 129.3, 2, "t")
    lost = (at("2026-08-20 22:00"), "ハブ", "捕獲", None, None, 1, "a")
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate([base, base, lost, (*lost[:6], "b")])],
        "event_id int, timestamp timestamp_ntz, species string, event_type string, lat double, lon double, individual_count int, raw_text string",
    )
    out = evt.dedupe_events(df, ["event_id"])
    assert rows(out, "event_id", "individual_count", "copies") == [(0, 2, 2), (2, 1, 1), (3, 1, 1)]


def test_tie_collapse(spark):
    df = spark.createDataFrame([(0, "B", 12.0), (0, "A", 12.0), (1, "C", 8.0)], "src int, segment_id string, event_match_distance_m double")
    assert rows(evt.tie_collapse(df, "src"), "src", "segment_id") == [(0, "A"), (1, "C")]


def test_frozen_windows(spark):
    snap = spark.createDataFrame([("2026-08-28", 3), ("2026-08-29", 2)], "d string, point_prediction bigint").select(
        F.col("d").cast("date").alias("operational_date"), "point_prediction"
    )
    times = ["2026-08-28 22:06", "2026-08-28 22:45", "2026-08-29 01:22", "2026-08-29 02:26"]
    events = spark.createDataFrame(
        [(at(t), "ハブ", "捕獲", 1) for t in times], "timestamp timestamp_ntz, species string, event_type string, individual_count int"
    )
    scored = evt.score_frozen_windows(snap, events, main=(1040, 1100), secondary=(1115, 1175))
    r, quiet = scored.orderBy("operational_date_0700").collect()
    assert (quiet.point_prediction, quiet.main_events, quiet.status) == (2, None, "no-holdout-events")
    assert (r.main_events, r.main_hit, r.secondary_events, r.secondary_hit) == (0, False, 1, True)
    assert (r.actual_individuals, r.range_hit, r.point_error) == (4, True, 1)


def test_contracts_flag_each_rule_once(spark):
    captures = spark.createDataFrame(
        [("a", "capture", "ヒメハブ", 1), ("b", "sighting", " ", 1), ("c", "sighting", "カエル", 0), ("d", "capture", "ハブ", 1)],
        "event_id string, event_type string, species string, individual_count int",
    )
    assert rows(ct.violations(captures, "event_id", ct.event_rules())) == [
        ("a", "capture_of_other_species"), ("b", "species_blank"), ("c", "count_below_one"),
    ]
    forecasts = spark.createDataFrame([("x", -1.0), ("y", 1.5), ("z", 2.0)], "id string, point_prediction double")
    assert [r[0] for r in rows(ct.violations(forecasts, "id", ct.forecast_rules()))] == ["x", "y"]
    modes = spark.createDataFrame([("m", "ML_ONLY", "prediction_influence"), ("n", "ML_ONLY", "explanation_only")], "id string, prediction_mode string, influence string")
    assert [r[0] for r in rows(ct.violations(modes, "id", ct.influence_rules()))] == ["m"]
    presence = spark.createDataFrame([("p", at("2026-08-20 21:00"), None), ("q", None, None)], "id string, actual_presence_at timestamp_ntz, presence_time_source string")
    assert [r[0] for r in rows(ct.violations(presence, "id", ct.presence_rules()))] == ["p"]
    sessions = spark.createDataFrame([("s", at("2026-08-20 21:00"), at("2026-08-20 20:00")), ("t", at("2026-08-20 21:00"), None)], "id string, started_at timestamp_ntz, ended_at timestamp_ntz")
    assert [r[0] for r in rows(ct.violations(sessions, "id", ct.session_rules()))] == ["s"]
