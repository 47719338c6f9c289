"""Intervals between timed anchors: verification, labels and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import require_columns
from ..functions.timeops import bin_start, seconds_between
from ..params import TARGET_EVENT_TYPES, TARGET_SPECIES, UNIQUE_ROUTE_CLASSES
from .joins import interval_sums


def verify_intervals(intervals: DataFrame, minutes: int = 10) -> DataFrame:
    """Strict only when times are in order, the route is unique and one time bin holds it all."""
    require_columns(intervals, ["start_time", "end_time", "route_class"], "interval table")
    start, end = F.col("start_time"), F.col("end_time")
    valid = F.coalesce(end >= start, F.lit(False))
    unique = F.coalesce(F.col("route_class").isin(*UNIQUE_ROUTE_CLASSES), F.lit(False))
    same_bin = F.coalesce(bin_start(start, minutes) == bin_start(end, minutes), F.lit(False))
    strict = valid & unique & same_bin
    return intervals.withColumns(
        {
            "interval_minutes": seconds_between(start, end) / 60.0,
            "road10_bin_start": bin_start(start, minutes),
            "strict_road10_verified": strict,
            "can_generate_no_capture_observed": strict,
            "verification_reason": F.when(~valid, "invalid_or_missing_anchor_time")
            .when(~unique, "route_not_unique")
            .when(~same_bin, "crosses_10min_bin")
            .otherwise("unique_route_inside_single_10min_bin"),
        }
    )


def interval_summary(verified: DataFrame, night: str = "operational_date_0700") -> DataFrame:
    require_columns(verified, [night, "strict_road10_verified"], "verified intervals")
    return (
        verified.groupBy(night)
        .agg(
            F.count(F.lit(1)).alias("interval_count"),
            F.count_if("strict_road10_verified").alias("strict_interval_count"),
        )
        .withColumn("strict_interval_ratio", F.col("strict_interval_count") / F.col("interval_count"))
    )


def label_intervals(
    intervals: DataFrame,
    events: DataFrame,
    *,
    interval_id: list[str],
    species: str = TARGET_SPECIES,
    types: tuple[str, ...] = TARGET_EVENT_TYPES,
    group_rows: int | None = None,
) -> DataFrame:
    """Positive when an event of the target falls inside the interval, ends included.

    Event types come from a fixed list, so each has a counter of its own in the sweep and the
    list of types found needs no set per interval.
    """
    require_columns(intervals, ["start_time", "end_time", "strict_road10_verified"], "intervals")
    require_columns(events, ["timestamp", "event_type", "species"], "events")
    unverified = intervals.where(~F.coalesce("strict_road10_verified", F.lit(False)))
    if not unverified.isEmpty():
        raise ValueError("all intervals must be verified before they are labelled")
    targets = events.where((F.col("species") == species) & F.col("event_type").isin(*types))
    counters = {f"_type_{i}": name for i, name in enumerate(sorted(types))}
    counted = interval_sums(
        intervals,
        targets,
        probe_id=interval_id,
        lo=F.col("start_time"),
        hi=F.col("end_time"),
        at=F.col("timestamp"),
        measures={
            "target_event_count": F.lit(1),
            **{c: F.when(F.col("event_type") == name, 1).otherwise(0) for c, name in counters.items()},
        },
        group_rows=group_rows,
    )
    found = F.concat_ws(" | ", *[F.when(F.col(c) > 0, name) for c, name in counters.items()])
    return counted.withColumns(
        {
            "label": F.when(F.col("target_event_count") > 0, "Positive").otherwise(
                "NO_CAPTURE_OBSERVED"
            ),
            "target_event_types": found,
        }
    ).drop(*counters)
