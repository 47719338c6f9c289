"""Field events: text fields, deduplication, ties, target filters and frozen forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.timeops import night_date, night_key
from ..params import CAPTURE_TYPES, DEFAULTS, SNAKES, TARGET_SPECIES, Params
from .joins import interval_sums


def event_fields(notes: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Type, species, count, size, wetness and last position of each note block."""
    text = F.col(text_col)
    return (
        notes.withColumn("_lines", tx.lines_of(text))
        .withColumns(
            {
                "event_type": tx.event_type(F.col("_lines")),
                "species": tx.species(text),
                "individual_count": tx.individual_count(text),
                "size": tx.size_class(text),
                "wetness": tx.wetness(text),
                "lat": tx.last_number_line(F.col("_lines"), tx.LATITUDE_LINE),
                "lon": tx.last_number_line(F.col("_lines"), tx.LONGITUDE_LINE),
            }
        )
        .drop("_lines")
    )


def is_target_capture(species: str = TARGET_SPECIES) -> Column:
    return F.coalesce(
        (F.col("species") == species) & F.col("event_type").isin(*CAPTURE_TYPES), F.lit(False)
    )


def capture_filter(events: DataFrame, species: str = TARGET_SPECIES) -> DataFrame:
    return events.where(is_target_capture(species))


def context_events(events: DataFrame) -> DataFrame:
    """Events of species other than the snakes; an unknown species stays in."""
    return events.where(~F.coalesce(F.col("species").isin(*SNAKES), F.lit(False)))


def signature(events: DataFrame) -> Column:
    """Text identity of an event; missing parts are empty, so they never merge rows wrongly."""

    def part(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit(""))

    return F.concat_ws(
        "|",
        part(F.col("timestamp")),
        part(F.col("species")),
        part(F.col("event_type")),
        part(F.round("lat", 7)),
        part(F.round("lon", 7)),
        part(F.col("raw_text")),
    )


def dedupe_events(events: DataFrame, order: list[str]) -> DataFrame:
    """First event of each signature. Copies collapse before the shuffle (partial `min_by`)."""
    columns = events.columns
    row = F.struct(*[F.col(c) for c in columns])
    return (
        events.withColumn("event_signature", signature(events))
        .groupBy("event_signature")
        .agg(F.min_by(row, F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("copies"))
        .select("_first.*", "event_signature", "copies")
    )


def tie_collapse(
    matches: DataFrame,
    source_id: str,
    distance: str = "event_match_distance_m",
    segment: str = "segment_id",
) -> DataFrame:
    """One match per source row: least distance (unknown last), then least segment."""
    row = F.struct(*[F.col(c) for c in matches.columns])
    unknown_last = F.coalesce(F.col(distance), F.lit(float("inf")))
    return (
        matches.groupBy(source_id)
        .agg(F.min_by(row, F.struct(unknown_last, F.coalesce(segment, F.lit("")))).alias("_best"))
        .select("_best.*")
    )


def split_cutoff(df: DataFrame, time_col: str, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Rows before the baseline cutoff, and rows from the hold-out start on."""
    ts = F.col(time_col)
    return (
        df.where(ts < F.lit(p.baseline_cutoff).cast("timestamp_ntz")),
        df.where(ts >= F.lit(p.holdout_start).cast("timestamp_ntz")),
    )


def score_frozen_windows(
    snapshots: DataFrame,
    events: DataFrame,
    *,
    species: str = TARGET_SPECIES,
    main: tuple[int, int],
    secondary: tuple[int, int],
    spread: int = 1,
) -> DataFrame:
    """Frozen nightly forecasts against what was captured.

    Windows are given in minutes after the start of the night and are inclusive. The forecast
    range is the point plus or minus `spread`. A night without captures keeps its forecast with the
    status `no-holdout-events` and nothing scored.
    """
    captures = capture_filter(events, species).select(
        night_date(F.col("timestamp")).alias("operational_date"),
        "timestamp",
        F.coalesce(F.col("individual_count"), F.lit(1)).cast("bigint").alias("individuals"),
    )
    # A night has three spans at most, so each is one conditional sum of the nightly group.
    start = F.col("operational_date").cast("timestamp_ntz") + F.expr("INTERVAL '7' HOUR")

    def inside(window: tuple[int, int]) -> Column:
        low = start + F.make_dt_interval(mins=F.lit(window[0]))
        high = start + F.make_dt_interval(mins=F.lit(window[1]))
        return F.col("timestamp").between(low, high)

    nightly = captures.groupBy("operational_date").agg(
        F.count(F.lit(1)).alias("actual_capture_events"),
        F.sum("individuals").alias("actual_individuals"),
        F.count_if(inside(main)).alias("main_events"),
        F.count_if(inside(secondary)).alias("secondary_events"),
    )
    scored = snapshots.join(nightly, "operational_date", "left")
    point = F.col("point_prediction")
    return scored.select(
        F.col("operational_date").cast("string").alias("operational_date_0700"),
        point,
        "actual_capture_events",
        "actual_individuals",
        "main_events",
        (F.col("main_events") > 0).alias("main_hit"),
        "secondary_events",
        (F.col("secondary_events") > 0).alias("secondary_hit"),
        F.col("actual_individuals").between(point - spread, point + spread).alias("range_hit"),
        (F.col("actual_individuals") - point).alias("point_error"),
        F.when(F.col("actual_capture_events").isNull(), "no-holdout-events").otherwise("scored").alias("status"),
    )


def nearby_event_sums(
    visits: DataFrame,
    events: DataFrame,
    *,
    visit_id: list[str],
    window_s: int,
    group_rows: int | None = None,
) -> DataFrame:
    """Per visit, target events and individuals on its segment within the window, both ways."""
    half = F.make_dt_interval(secs=F.lit(window_s))
    return interval_sums(
        visits,
        events,
        probe_id=visit_id,
        lo=F.col("entered_at") - half,
        hi=F.col("entered_at") + half,
        at=F.col("timestamp"),
        keys=["segment_id"],
        measures={
            "nearby_events": F.lit(1),
            "nearby_individuals": F.coalesce(F.col("individual_count"), F.lit(1)),
        },
        group_rows=group_rows,
    )


def label_outcomes(
    visits: DataFrame,
    events: DataFrame,
    *,
    visit_id: list[str],
    species: str = TARGET_SPECIES,
    p: Params = DEFAULTS,
    group_rows: int | None = None,
) -> DataFrame:
    """`target_capture` and `target_individuals` of each visit."""
    summed = nearby_event_sums(
        visits,
        capture_filter(events, species),
        visit_id=visit_id,
        window_s=p.outcome_window_s,
        group_rows=group_rows,
    )
    return summed.withColumns(
        {
            "target_capture": F.when(F.col("nearby_events") > 0, 1).otherwise(0),
            "target_individuals": F.col("nearby_individuals"),
        }
    ).drop("nearby_events", "nearby_individuals")


def operational_night(events: DataFrame) -> DataFrame:
    """Adds the survey night under both of its names."""
    night = night_key(F.col("timestamp"))
    return events.withColumns({"night_date": night, "operational_date_0700": night})
