"""Which nights were surveyed, how well, and whether silence may count as a negative."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import require_columns, with_default_columns
from ..functions.timeops import night_key, seconds_between
from ..params import (
    CAPTURE_TYPES,
    DEFAULTS,
    MARKER_TYPES,
    NIGHT_CLASSES,
    QUARANTINE_STATUSES,
    SEQUENCE_TYPES,
    TARGET_SPECIES,
    ZERO_TYPES,
    Params,
)
from .ordered import aggregate_with_quantiles, arrange

NIGHT = "operational_date_0700"


@dataclass(frozen=True)
class AuditRules:
    """Thresholds of the night classes."""

    track_points: int = 100
    track_minutes: float = 30.0
    history_anchors: int = 20
    history_minutes: float = 90.0
    history_gap_minutes: float = 10.0
    partial_anchors: int = 4
    area_confidence: float = 0.40
    road_confidence: float = 0.65
    strict_route: float = 0.85
    strict_time: float = 0.80


RULES = AuditRules()


def with_night(df: DataFrame, time_col: str = "timestamp") -> DataFrame:
    return df.withColumn(NIGHT, night_key(F.col(time_col)))


def minutes_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / 60.0


def truthy(column: Column) -> Column:
    text = F.lower(F.trim(column.cast("string")))
    return F.coalesce(text.isin("true", "1", "y", "yes"), F.lit(False))


# --- night summaries -------------------------------------------------------------------


def gpx_night_summary(points: DataFrame) -> DataFrame:
    """Volume, sources, span and matched points of the recorded tracks per night."""
    nightly = with_night(
        with_default_columns(
            points, session_file=("unknown.gpx", "string"), segment_id=(None, "string")
        )
    )
    # Two steps, so the names shipped to the last one are one per night and source.
    per_file = nightly.groupBy(NIGHT, "session_file").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("t0"),
        F.max("timestamp").alias("t1"),
        F.count("segment_id").alias("matched"),
    )
    return (
        per_file.groupBy(NIGHT)
        .agg(
            F.sum("n").alias("actual_gpx_points"),
            F.array_join(F.array_sort(F.collect_list("session_file")), " | ").alias(
                "gpx_session_files"
            ),
            F.min("t0").alias("gpx_start"),
            F.max("t1").alias("gpx_end"),
            F.sum("matched").alias("matched_segment_points"),
        )
        .withColumn("gpx_duration_minutes", minutes_between(F.col("gpx_start"), F.col("gpx_end")))
    )


def event_night_summary(events: DataFrame, species: str = TARGET_SPECIES) -> DataFrame:
    known = with_default_columns(
        events,
        event_type=("unknown", "string"),
        species=("unknown", "string"),
        lat=(None, "double"),
        lon=(None, "double"),
    )
    captured = F.col("event_type").isin(*CAPTURE_TYPES) & (F.col("species") == species)
    return (
        with_night(known)
        .groupBy(NIGHT)
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_if(captured).alias("capture_count"),
            F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias(
                "gps_anchor_count"
            ),
        )
    )


def history_night_summary(history: DataFrame, *, group_rows: int | None = None) -> DataFrame:
    """Anchors, gaps and map-match quality of the device location history per night.

    Only anchors with coordinates count; a night without any keeps a row of zeros.
    """
    known = with_night(
        with_default_columns(
            history,
            segment_id=(None, "string"),
            match_distance_m=(None, "double"),
            strict_temporal_route_verified=(False, "boolean"),
        )
    )
    ids = [c for c in ("event_id", "seq", "anchor_id") if c in known.columns]
    nights = known.groupBy(NIGHT).agg(F.count(F.lit(1)).alias("_rows"))
    anchors = known.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    measure = known.select(NIGHT)
    gapped = (
        arrange(
            anchors.withColumn("_spread", F.xxhash64("timestamp", "lat", "lon")),
            [NIGHT],
            ["timestamp", *ids, "_spread"],
            group_rows=group_rows,
            measure=measure,
        )
        .lag(_prev=F.col("timestamp"))
        .done()
        .withColumn("_gap", minutes_between(F.col("_prev"), F.col("timestamp")))
    )
    matched = F.col("segment_id").isNotNull()
    summary = aggregate_with_quantiles(
        gapped,
        [NIGHT],
        [
            F.count(F.lit(1)).alias("history_anchor_count"),
            F.min("timestamp").alias("history_start"),
            F.max("timestamp").alias("history_end"),
            F.count("segment_id").alias("history_matched_anchor_count"),
            F.bool_and(F.coalesce("strict_temporal_route_verified", F.lit(False))).alias(
                "strict_temporal_route_verified"
            ),
        ],
        {
            "history_median_gap_minutes": (F.col("_gap"), 0.5),
            "history_median_match_distance_m": (F.when(matched, F.col("match_distance_m")), 0.5),
        },
        group_rows=group_rows,
        measure=measure,
    )
    filled = nights.join(summary, NIGHT, "left").drop("_rows")
    count = F.coalesce("history_anchor_count", F.lit(0))
    return filled.withColumns(
        {
            "history_anchor_count": count,
            "history_matched_anchor_count": F.coalesce("history_matched_anchor_count", F.lit(0)),
            "history_span_minutes": F.coalesce(
                minutes_between(F.col("history_start"), F.col("history_end")), F.lit(0.0)
            ),
            "history_match_ratio": F.coalesce(
                F.try_divide("history_matched_anchor_count", "history_anchor_count"), F.lit(0.0)
            ),
            "strict_temporal_route_verified": F.coalesce(
                "strict_temporal_route_verified", F.lit(False)
            ),
        }
    )


def match_quality(points: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Share of map-matched points per night and whether it passes the gate."""
    known = with_night(with_default_columns(points, segment_id=(None, "string")))
    counted = known.groupBy(NIGHT).agg(
        F.count(F.lit(1)).alias("actual_gpx_total_points_for_gate"),
        F.count("segment_id").alias("actual_gpx_matched_points_for_gate"),
    )
    ratio = F.col("actual_gpx_matched_points_for_gate") / F.col("actual_gpx_total_points_for_gate")
    return counted.withColumn("actual_gpx_match_ratio", ratio).withColumn(
        "actual_gpx_map_match_ready", F.col("actual_gpx_match_ratio") >= p.min_match_ratio
    )


def history_match_summary(matched: DataFrame, *, group_rows: int | None = None) -> DataFrame:
    known = with_night(
        with_default_columns(
            matched, segment_id=(None, "string"), match_distance_m=(None, "double")
        )
    )
    is_matched = F.col("segment_id").isNotNull()
    out = aggregate_with_quantiles(
        known,
        [NIGHT],
        [
            F.count(F.lit(1)).alias("anchor_count"),
            F.count("segment_id").alias("matched_anchor_count"),
        ],
        {"median_match_distance_m": (F.when(is_matched, F.col("match_distance_m")), 0.5)},
        group_rows=group_rows,
        measure=known.select(NIGHT),
    )
    return out.withColumn("match_ratio", F.col("matched_anchor_count") / F.col("anchor_count"))


def strict_history_nights(summary: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """How many history nights pass both map-match limits."""
    passed = (F.col("match_ratio") >= p.min_match_ratio) & (
        F.col("median_match_distance_m") <= p.max_median_match_m
    )
    return summary.agg(
        F.count(F.lit(1)).alias("night_count"), F.count_if(passed).alias("strict_pass_count")
    )


# --- sets of nights --------------------------------------------------------------------


def nights_of(df: DataFrame) -> DataFrame:
    return df.select(NIGHT).where(F.col(NIGHT).isNotNull()).distinct()


def night_semi(df: DataFrame, nights: DataFrame | None) -> DataFrame:
    """Rows of the listed nights; all rows when there is no list."""
    return df if nights is None else df.join(nights, NIGHT, "left_semi")


def marker_nights(events: DataFrame) -> DataFrame:
    """Nights with an explicit start or end of a search."""
    return nights_of(with_night(events.where(F.col("event_type").isin(*MARKER_TYPES))))


def strong_nights(events: DataFrame) -> DataFrame:
    """Nights proven by an own capture or an explicit zero record."""
    strong = events.where(F.col("event_type").isin(*CAPTURE_TYPES, *ZERO_TYPES))
    if "other_capture" in events.columns:
        other = F.col("other_capture")
        by_others = truthy(other) | F.coalesce(
            F.trim(other.cast("string")) == "他者捕獲", F.lit(False)
        )
        strong = strong.where(~by_others)
    return nights_of(with_night(strong.where(F.col("timestamp").isNotNull())))


def dense_nights(
    events: DataFrame, min_events: int = 5, min_minutes: float = 45.0, min_places: int = 2
) -> DataFrame:
    """Nights on which many field notes were taken over a sustained time at several places."""
    eligible = with_night(
        events.where(F.col("event_type").isin(*SEQUENCE_TYPES) & F.col("timestamp").isNotNull())
    )
    facts = [
        F.sum("n").alias("n"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
    ]
    keep = (F.col("n") >= min_events) & (minutes_between(F.col("t0"), F.col("t1")) >= min_minutes)
    if "place" not in events.columns:
        counted = eligible.groupBy(NIGHT).agg(
            F.count(F.lit(1)).alias("n"),
            F.min("timestamp").alias("t0"),
            F.max("timestamp").alias("t1"),
        )
        return counted.where(keep).select(NIGHT)
    # Grouping by place first makes the distinct count a plain count of groups.
    per_place = (
        eligible.withColumn("_place", F.nullif(F.trim("place"), F.lit("")))
        .groupBy(NIGHT, "_place")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("timestamp").alias("t0"),
            F.max("timestamp").alias("t1"),
        )
    )
    counted = per_place.groupBy(NIGHT).agg(*facts, F.count("_place").alias("places"))
    return counted.where(keep & (F.col("places") >= min_places)).select(NIGHT)


def merge_nights(*sources: DataFrame) -> DataFrame:
    merged = sources[0].select(NIGHT)
    for source in sources[1:]:
        merged = merged.unionByName(source.select(NIGHT))
    return nights_of(merged)


def unresolved(conflicts: DataFrame) -> DataFrame:
    require_columns(conflicts, [NIGHT, "status", "include_by_default"], "conflict registry")
    return conflicts.where(
        F.col("status").isin(*QUARANTINE_STATUSES) & ~F.col("include_by_default")
    )


def quarantine(nights: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nights kept, and the registry rows of the nights held back."""
    open_cases = unresolved(conflicts)
    kept = nights_of(nights).join(open_cases.select(NIGHT), NIGHT, "left_anti")
    removed = open_cases.join(nights_of(nights), NIGHT, "left_semi")
    return kept, removed


def merge_quarantine(*frames: DataFrame) -> DataFrame:
    """One registry row per night; the earlier frame wins, then the lesser row."""
    ranked = None
    for rank, frame in enumerate(frames):
        part = frame.withColumn("_rank", F.lit(rank))
        ranked = part if ranked is None else ranked.unionByName(part, allowMissingColumns=True)
    columns = [c for c in ranked.columns if c not in ("_rank", NIGHT)]
    best = F.min(F.struct("_rank", *columns)).alias("_best")
    return ranked.groupBy(NIGHT).agg(best).select(NIGHT, *[f"_best.{c}" for c in columns])


# --- classification --------------------------------------------------------------------


def _whole(value: Column) -> Column:
    return F.bround(value, 0).cast("bigint").cast("string")


def _tenths(value: Column) -> Column:
    return F.format_string("%.1f", F.bround(value, 1))


def classify_nights(facts: DataFrame, rules: AuditRules = RULES, p: Params = DEFAULTS) -> DataFrame:
    """Decision list over the joined night summaries."""
    c = F.col
    points, minutes = c("actual_gpx_points"), c("gpx_duration_minutes")
    anchors, event_gps = c("history_anchor_count"), c("gps_anchor_count")
    ratio = F.least(F.lit(1.0), c("matched_segment_points") / F.greatest(points, F.lit(1)))
    tracked = (points >= rules.track_points) & (minutes >= rules.track_minutes)
    dense_history = (
        (anchors >= rules.history_anchors)
        & (c("history_span_minutes") >= rules.history_minutes)
        & F.coalesce(c("history_median_gap_minutes") <= rules.history_gap_minutes, F.lit(False))
    )
    few = (anchors >= rules.partial_anchors) | (event_gps >= rules.partial_anchors)
    any_anchor = (anchors >= 1) | (event_gps >= 1)
    history_ready = (
        c("strict_temporal_route_verified")
        & (c("history_match_ratio") >= p.min_match_ratio)
        & F.coalesce(c("history_median_match_distance_m") <= p.max_median_match_m, F.lit(False))
    )

    def by_class(track, high, partial, spatial, none) -> Column:
        return (
            F.when(tracked, track)
            .when(dense_history, high)
            .when(few, partial)
            .when(any_anchor, spatial)
            .otherwise(none)
        )

    strict_ready = by_class(
        ratio >= p.min_match_ratio, history_ready, F.lit(True), F.lit(True), F.lit(True)
    )
    route = by_class(
        F.greatest(F.lit(0.90), 0.90 + 0.10 * ratio), F.lit(0.85), F.lit(0.65), F.lit(0.45), F.lit(0.0)
    )
    time = by_class(F.lit(0.99), F.lit(0.82), F.lit(0.55), F.lit(0.20), F.lit(0.0))
    strict = strict_ready & (route >= rules.strict_route) & (time >= rules.strict_time)
    distance_text = F.coalesce(
        F.concat(_tenths(c("history_median_match_distance_m")), F.lit("m")), F.lit("n/a")
    )
    evidence = by_class(
        F.concat(
            F.lit("recorded track: "), points, F.lit(" points / "), _whole(minutes),
            F.lit(" min / matched "), _tenths(ratio * 100), F.lit("%"),
        ),
        F.concat(
            F.lit("location history: "), anchors, F.lit(" anchors / "),
            _whole(c("history_span_minutes")), F.lit(" min / median gap "),
            _tenths(c("history_median_gap_minutes")), F.lit(" min / matched "),
            _whole(c("history_match_ratio") * 100), F.lit("%, median distance "), distance_text,
            F.lit(" / route verified "), c("strict_temporal_route_verified").cast("string"),
        ),
        F.concat(F.lit("partial anchors: history="), anchors, F.lit(", event="), event_gps),
        F.concat(F.lit("spatial anchors only: history="), anchors, F.lit(", event="), event_gps),
        F.lit("night confirmed, no trajectory or anchors"),
    )
    limitation = by_class(
        F.when(strict_ready, F.lit("")).otherwise(F.lit("track match share below the strict limit")),
        F.when(strict_ready, F.lit("")).otherwise(
            F.lit("needs map-match quality and a verified route between anchors")
        ),
        F.lit("only well-evidenced stretches may be used in time"),
        F.lit("not valid for strict negatives"),
        F.lit("unknown until more evidence is supplied"),
    )
    captured = c("capture_count") > 0
    return facts.select(
        NIGHT,
        by_class(*[F.lit(name) for name in NIGHT_CLASSES]).alias("classification"),
        evidence.alias("evidence_summary"),
        points.alias("actual_gpx_points"),
        (anchors + event_gps).alias("gps_anchor_count"),
        F.bround(route, 3).alias("route_confidence"),
        F.bround(time, 3).alias("time_confidence"),
        (route >= rules.area_confidence).alias("usable_1km_area"),
        (route >= rules.road_confidence).alias("usable_road"),
        strict.alias("usable_road_10min_train"),
        strict.alias("usable_road_10min_eval"),
        strict.alias("can_generate_no_capture_observed"),
        c("capture_count"),
        c("event_count"),
        limitation.alias("limitation_reason"),
        F.when(captured, "CAPTURED").otherwise("NO_CAPTURE_RECORDED").alias("capture_outcome"),
        F.when(captured, "Positive")
        .when(strict, "NO_CAPTURE_OBSERVED")
        .otherwise("Unknown")
        .alias("night_observation_label"),
    )


def night_facts(
    points: DataFrame,
    events: DataFrame,
    history: DataFrame | None,
    nights: DataFrame | None,
    *,
    group_rows: int | None = None,
) -> DataFrame:
    """The night population with all three summaries; ordinary events never add a night."""
    gpx = gpx_night_summary(points)
    noted = event_night_summary(events)
    sources = [gpx.select(NIGHT), marker_nights(events)]
    if nights is not None:
        sources.append(nights)
    facts_defaults: dict[str, tuple[object, str]] = {
        "history_anchor_count": (0, "bigint"),
        "history_span_minutes": (0.0, "double"),
        "history_median_gap_minutes": (None, "double"),
        "history_match_ratio": (0.0, "double"),
        "history_median_match_distance_m": (None, "double"),
        "strict_temporal_route_verified": (False, "boolean"),
    }
    if history is not None:
        device = history_night_summary(history, group_rows=group_rows)
        sources.append(history.transform(with_night).select(NIGHT))
    base = merge_nights(*sources).join(gpx, NIGHT, "left").join(noted, NIGHT, "left")
    if history is not None:
        base = base.join(device, NIGHT, "left")
    base = with_default_columns(base, **facts_defaults)
    zeros = {
        c: 0
        for c in (
            "actual_gpx_points",
            "matched_segment_points",
            "gpx_duration_minutes",
            "event_count",
            "capture_count",
            "gps_anchor_count",
            "history_anchor_count",
            "history_span_minutes",
            "history_match_ratio",
        )
    }
    return base.fillna(zeros).fillna({"strict_temporal_route_verified": False})


def night_audit(
    points: DataFrame,
    events: DataFrame,
    history: DataFrame | None = None,
    nights: DataFrame | None = None,
    rules: AuditRules = RULES,
    p: Params = DEFAULTS,
    *,
    group_rows: int | None = None,
) -> DataFrame:
    return classify_nights(
        night_facts(points, events, history, nights, group_rows=group_rows), rules, p
    )


def gpx_gate(audit: DataFrame, points: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Takes strict use away from recorded-track nights whose points are not map-matched."""
    gated = (
        audit.join(match_quality(points, p), NIGHT, "left")
        .fillna({"actual_gpx_match_ratio": 0.0})
        .fillna({"actual_gpx_map_match_ready": False})
    )
    blocked = (F.col("classification") == NIGHT_CLASSES[0]) & ~F.col("actual_gpx_map_match_ready")
    flags = ("usable_road_10min_train", "usable_road_10min_eval", "can_generate_no_capture_observed")
    return gated.withColumns(
        {flag: F.col(flag) & ~blocked for flag in flags}
        | {
            "night_observation_label": F.when(
                blocked & (F.col("capture_count") == 0), "Unknown"
            ).otherwise(F.col("night_observation_label")),
            "limitation_reason": F.when(
                blocked, "track is continuous, but too few points are map-matched for strict use"
            ).otherwise(F.col("limitation_reason")),
        }
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    """Nights per class, with zeros for absent classes, and the label counts of each class."""
    spark = audit.sparkSession
    classes = spark.createDataFrame([(c,) for c in NIGHT_CLASSES], "classification string")
    counted = audit.groupBy("classification").agg(
        F.count(F.lit(1)).alias("night_count"),
        F.count_if("usable_road_10min_train").alias("road_10min_train_usable"),
        F.count_if("usable_road_10min_eval").alias("road_10min_eval_usable"),
        F.count_if(F.col("night_observation_label") == "NO_CAPTURE_OBSERVED").alias(
            "no_capture_observed_nights"
        ),
        F.count_if(F.col("night_observation_label") == "Unknown").alias("unknown_nights"),
    )
    return classes.join(counted, "classification", "left").fillna(0)


def audit_checks(audit: DataFrame, conflicts: DataFrame, expected_nights: int | None = None) -> DataFrame:
    """One row of consistency facts: unique nights, known classes, registry against population."""
    per_night = audit.groupBy(NIGHT).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("classification").isin(*NIGHT_CLASSES)).alias("classified"),
    )
    totals = per_night.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("night_rows"),
        F.count(F.lit(1)).alias("distinct_nights"),
        F.count_if(F.col("n") > 1).alias("duplicated_nights"),
        F.coalesce(F.sum("classified"), F.lit(0)).alias("classified_rows"),
    )
    held = nights_of(unresolved(conflicts)).join(nights_of(audit), NIGHT, "left_semi")
    rejoined = held.agg(F.count(F.lit(1)).alias("n")).scalar()
    expected = F.lit(expected_nights).cast("bigint")
    return totals.select(
        "*",
        (F.col("night_rows") == F.col("classified_rows")).alias("classes_complete"),
        rejoined.alias("conflict_nights_in_audit"),
        F.coalesce(F.col("night_rows") == expected, F.lit(True)).alias("expected_count_met"),
    )
