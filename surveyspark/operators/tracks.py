"""Tracks: dynamics of consecutive points, segment visits, gaps, gates and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import geodesic_step
from ..functions.timeops import night_key, seconds_between
from ..params import DEFAULTS, Params
from .ordered import aggregate_with_quantiles, arrange

SESSION = "session_file"


def number_points(points: DataFrame, session: str, order: list[str], *, group_rows=None) -> DataFrame:
    """Dense 0-based `seq` per session for sources that do not carry one."""
    measure = points.select(session)
    return arrange(points, [session], order, group_rows=group_rows, measure=measure).index("seq").done()


def _by_seq(points: DataFrame, group_rows: int | None, measure: DataFrame | None = None):
    return arrange(
        points,
        [SESSION],
        ["seq"],
        group_rows=group_rows,
        position="seq",
        measure=(points if measure is None else measure).select(SESSION),
    )


def track_dynamics(points: DataFrame, *, group_rows: int | None = None) -> DataFrame:
    """Adds `step_m`, `heading_deg`, `speed_mps` relative to the previous point."""
    lagged = (
        _by_seq(points, group_rows)
        .lag(_lat=F.col("lat"), _lon=F.col("lon"), _ts=F.col("timestamp"))
        .done()
    )
    step, heading = geodesic_step("_lat", "_lon", "lat", "lon")
    elapsed = F.nullif(seconds_between(F.col("_ts"), F.col("timestamp")), F.lit(0.0))
    return (
        lagged.withColumns({"step_m": step, "heading_deg": heading})
        .withColumn("speed_mps", F.col("step_m") / elapsed)
        .drop("_lat", "_lon", "_ts")
    )


def number_visits(matched: DataFrame, *, group_rows: int | None = None) -> DataFrame:
    """Matched points with `visit_index`, growing by one whenever the segment changes."""
    arranged = _by_seq(matched.where(F.col("segment_id").isNotNull()), group_rows).lag(
        _prev=F.col("segment_id")
    )
    changed = F.when(F.col("segment_id").eqNullSafe(F.col("_prev")), 0).otherwise(1).cast("bigint")
    return arranged.running_sum(visit_index=changed).done().drop("_prev")


def segment_visits(matched: DataFrame, *, group_rows: int | None = None) -> DataFrame:
    """Runs of consecutive points on one segment, as one row each."""
    numbered = number_visits(matched, group_rows=group_rows)
    visits = aggregate_with_quantiles(
        numbered,
        [SESSION, "visit_index", "segment_id"],
        [
            F.min("timestamp").alias("entered_at"),
            F.max("timestamp").alias("exited_at"),
            F.count("seq").alias("point_count"),
            F.avg("speed_mps").alias("mean_speed_mps"),
            F.avg("match_distance_m").alias("mean_match_distance_m"),
        ],
        {"elevation_m": (F.col("elevation_m"), 0.5)},
        group_rows=group_rows,
        # a visit is part of a session, so bounded sessions bound the visits
        measure=matched.select(SESSION),
        measure_keys=[SESSION],
    )
    stay = seconds_between(F.col("entered_at"), F.col("exited_at"))
    return visits.withColumn("duration_s", F.greatest(stay, F.lit(0.0)))


def unmatched_runs(matched: DataFrame, min_points: int = 20, *, group_rows=None) -> DataFrame:
    """Points of unmatched stretches of at least `min_points`, with `run_id` per session.

    `run_id` counts the matched points seen so far, which is constant inside a stretch.
    """
    lonely = F.col("segment_id").isNull()
    numbered = (
        _by_seq(matched, group_rows)
        .running_sum(run_id=F.when(lonely, 0).otherwise(1).cast("bigint"))
        .done()
        .where(lonely)
    )
    long_enough = (
        numbered.groupBy(SESSION, "run_id")
        .agg(F.count(F.lit(1)).alias("run_points"))
        .where(F.col("run_points") >= min_points)
    )
    return numbered.join(long_enough, [SESSION, "run_id"])


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy(SESSION, "run_id").agg(
        F.count(F.lit(1)).alias("run_points"),
        F.min("seq").alias("seq_start"),
        F.max("seq").alias("seq_end"),
        F.min("timestamp").alias("time_start"),
        F.max("timestamp").alias("time_end"),
    )


def session_gate(matched: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Clears every segment of a session whose matched share is too low; rows stay."""
    share = matched.groupBy(SESSION).agg(
        F.avg(F.col("segment_id").isNotNull().cast("double")).alias("session_map_match_ratio")
    )
    return (
        matched.join(share, SESSION)
        .withColumn("strict_session_eligible", F.col("session_map_match_ratio") >= p.min_match_ratio)
        .withColumn("segment_id", F.when(F.col("strict_session_eligible"), F.col("segment_id")))
    )


def track_qc(points: DataFrame, *, gap_limit_s: float = 300.0, group_rows=None) -> DataFrame:
    """Per night: volume, duration, distance and the spread of time gaps between points."""
    nightly = points.withColumn("operational_date_0700", night_key(F.col("timestamp")))
    keys = [SESSION, "operational_date_0700"]
    lagged = (
        arrange(
            nightly,
            keys,
            ["seq"],
            group_rows=group_rows,
            position="seq",
            measure=nightly.select(*keys),
        )
        .lag(_ts=F.col("timestamp"), _lat=F.col("lat"), _lon=F.col("lon"))
        .done()
    )
    step, _ = geodesic_step("_lat", "_lon", "lat", "lon")
    gapped = lagged.withColumns(
        {"gap_s": seconds_between(F.col("_ts"), F.col("timestamp")), "step_m": step}
    )
    qc = aggregate_with_quantiles(
        gapped,
        ["operational_date_0700"],
        [
            F.count(F.lit(1)).alias("gps_points"),
            F.min("timestamp").alias("start_time"),
            F.max("timestamp").alias("end_time"),
            (F.coalesce(F.sum("step_m"), F.lit(0.0)) / 1000).alias("distance_km"),
            F.max("gap_s").alias("max_gap_s"),
            F.count_if(F.col("gap_s") > gap_limit_s).alias("gaps_over_limit"),
        ],
        {"median_gap_s": (F.col("gap_s"), 0.5), "p95_gap_s": (F.col("gap_s"), 0.95)},
        group_rows=group_rows,
        measure=nightly.select("operational_date_0700"),
    )
    hours = seconds_between(F.col("start_time"), F.col("end_time")) / 3600
    return qc.withColumn("duration_h", hours)


def route_lines(points: DataFrame) -> DataFrame:
    """Ordered coordinates per session, one row each, for sessions with at least two points.

    A line is one record of the layer it is written to, so its points meet in one row.
    """
    vertex = F.struct("seq", "lon", "lat").alias("vertex")
    lines = points.groupBy(SESSION).agg(F.array_sort(F.collect_list(vertex)).alias("v"))
    return lines.where(F.size("v") > 1).select(
        SESSION,
        F.transform("v", lambda v: F.struct(v["lon"].alias("x"), v["lat"].alias("y"))).alias("line"),
    )
