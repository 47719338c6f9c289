"""The nightly flow: matched tracks to learning rows, and a whole run with its model, forecast, layers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as evt
from ..operators import features as ft
from ..operators import mapmatch as mm
from ..operators import model as md
from ..operators import report as rp
from ..operators import roads as rd
from ..operators import tracks as tr
from ..operators import weather as we
from ..operators.contracts import RowGuard
from ..operators.recovery import RecoveryRules, recover_roads
from ..params import DEFAULTS, TARGET_SPECIES, Params
from ..session import checkpointed, shuffled
from ..sources import sinks

VISIT_KEY = ["session_file", "visit_index"]


def visit_features(
    visits: DataFrame,
    weather: DataFrame,
    events: DataFrame,
    p: Params = DEFAULTS,
    *,
    measure: DataFrame | None = None,
    assigned: DataFrame | None = None,
) -> DataFrame:
    """Visits with terrain, weather, outcome and exposure columns.

    `assigned` names each segment's weather station where there are several.

    `measure` is the point table the visits come from: its groups bound those of the visits.
    """
    by_session = None if measure is None else measure.select("session_file")
    by_segment = None if measure is None else measure.select("segment_id")
    sloped = ft.slope_relief(visits, measure=by_session)
    report = we.hours_since_rain(we.rolling_rain(weather))
    with_weather = we.join_weather(sloped, report, p=p, assigned=assigned).drop("timestamp")
    labelled = evt.label_outcomes(with_weather, events, visit_id=VISIT_KEY, p=p)
    return ft.exposure_features(labelled, measure=by_segment)


def learning_table(
    points: DataFrame,
    road_parts: DataFrame,
    events: DataFrame,
    weather: DataFrame,
    context: DataFrame | None = None,
    context_classes: tuple[str, ...] = (),
    p: Params = DEFAULTS,
    rules: RecoveryRules = RecoveryRules(),
    stations: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All tables of one run: segments, matched points, visits, events and learning rows.

    Roads are recovered from ungated matches; only then are weak sessions taken out. Copies of events
    go first; a match that gives more events than went in is an error.
    """
    guard = RowGuard()
    if "event_signature" not in events.columns:
        events = evt.dedupe_events(events, ["event_id"])
    events = checkpointed(guard.watched(events, "events"))
    base = checkpointed(rd.road_segments(road_parts, p))
    tracked = tr.track_dynamics(points)
    first = checkpointed(mm.map_match(tracked, base, p))
    noted = mm.event_nearest_road(events, base, p=p)
    supplemental = recover_roads(first, noted, p, rules).segments
    segments = checkpointed(rd.combine_roads(base, supplemental))
    matched = checkpointed(tr.session_gate(mm.map_match(tracked, segments, p), p))
    visits = tr.segment_visits(matched)
    placed = checkpointed(guard.watched(mm.event_nearest_road(events, segments, p=p), "matched events"))
    guard.not_more("matched events", "events")
    assigned = None if stations is None else shuffled(we.nearest_stations(segments, stations))
    learning = visit_features(visits, weather, placed, p, measure=matched, assigned=assigned)
    learning = ft.static_join(
        learning,
        shuffled(segments),
        ["highway", "length_m", "bearing_deg", "curvature_deg", "segment_x_m", "segment_y_m"],
    )
    learning = ft.bio_counts(learning, evt.context_events(placed), visit_id=VISIT_KEY, p=p)
    codes = rd.road_class_codes(segments).select("segment_id", "road_class_code")
    learning = learning.join(shuffled(codes), "segment_id", "left")
    learning = learning.join(
        shuffled(ft.road_distance_features(segments, rd.junctions(segments))), "segment_id", "left"
    )
    if context is not None:
        near = ft.nearest_context(segments, context, classes=context_classes)
        learning = learning.join(shuffled(near), "segment_id", "left")
    return {
        "segments": segments,
        "points": matched,
        "visits": visits,
        "events": placed,
        "learning": learning,
        "unmatched_events": placed.where(F.col("segment_id").isNull()),
    }


def run(
    points: DataFrame,
    road_parts: DataFrame,
    events: DataFrame,
    weather: DataFrame,
    folder: str,
    *,
    context: DataFrame | None = None,
    context_classes: tuple[str, ...] = (),
    p: Params = DEFAULTS,
    rules: RecoveryRules = RecoveryRules(),
    stations: DataFrame | None = None,
    snapshots: DataFrame | None = None,
    main: tuple[int, int] = (0, 1440),
    secondary: tuple[int, int] = (0, 1440),
    expected: tuple[int, int] | None = None,
) -> dict[str, DataFrame]:
    """A whole run: tables, model, hold-out and frozen scores, forecast, map layers and quality reports.

    Everything is written below `folder` and returned by name. `snapshots` are frozen forecasts, scored in the
    windows `main` and `secondary` (minutes after the start of the night); `expected` is passed to the
    status of the steps. A fit with one class writes no model, and its report says so.
    """
    made = learning_table(points, road_parts, events, weather, context, context_classes, p, rules, stations)
    learning = checkpointed(made["learning"])
    cutoff = F.lit(p.baseline_cutoff).cast("timestamp_ntz")
    place = ["session_file", "visit_index"]
    sinks.write_table(learning, f"{folder}/tables/learning", "entered_at", order=["entered_at", *place])
    sinks.write_table(made["visits"], f"{folder}/tables/visits", "entered_at", order=["entered_at", *place])
    sinks.write_table(made["points"], f"{folder}/tables/points", "timestamp", order=["session_file", "seq"])
    sinks.write_table(made["events"], f"{folder}/tables/events", "timestamp", order=["timestamp", "event_id"])
    sinks.write_table(made["unmatched_events"], f"{folder}/tables/events_unmatched", order=["timestamp", "event_id"])

    train, hold = evt.split_cutoff(learning, "entered_at", p)
    fitted = md.fit_model(train)
    model, folds = md.model_report(train, fitted)
    frozen = None
    if snapshots is not None:
        frozen = evt.score_frozen_windows(snapshots, made["events"], main=main, secondary=secondary)
    scored = frozen is not None and bool(frozen.where(F.col("status") == "scored").limit(1).count())
    reports = {
        "model": model,
        "folds": folds,
        "forecast": rp.forecast_summary(train),
        "ranking": rp.rank_segments(train),
        "qa": rp.qa_counts(points, events, made["events"], learning, cutoff),
        "steps": rp.step_status(learning, made["events"], cutoff, scored=scored, expected=expected),
        "unmatched": rp.unmatched_captures(made["events"], cutoff),
    }
    if fitted is not None:
        fitted.pipeline().write().overwrite().save(f"{folder}/model")
        reports["coefficients"] = md.coefficient_table(fitted, learning.sparkSession)
        reports["holdout"] = md.score_holdout(fitted, hold)
    if frozen is not None:
        reports["frozen"] = frozen
    for name, report in reports.items():
        sinks.write_summary(report, f"{folder}/reports/{name}")

    risk = rp.segment_risk(made["segments"], train)
    sinks.write_lines(sinks.segment_layer(made["segments"], risk, p), f"{folder}/layers/segments")
    located = sinks.event_layer(made["events"], cutoff, TARGET_SPECIES)
    dot = sinks.point_geometry(F.col("lon"), F.col("lat"))
    shown = ["event_id", "species", "event_type", "is_holdout", "is_large_target"]
    sinks.write_lines(sinks.geojson_features(located, dot, shown), f"{folder}/layers/events")
    latest = points.where(F.col("timestamp") >= F.lit(p.holdout_start).cast("timestamp_ntz"))
    sinks.write_text(sinks.route_text(latest), f"{folder}/layers/latest_route", sinks.ROUTE_ORDER)
    return {**made, "learning": learning, "risk": risk, **reports}
