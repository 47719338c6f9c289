"""Rankings, peak hours, risk layers, data-quality reports and scores of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import is_target_capture
from .ordered import arrange


def segment_stats(learning: DataFrame) -> DataFrame:
    return learning.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("visits"),
        F.sum("target_capture").alias("captures"),
        F.sum("target_individuals").alias("individuals"),
    )


def _global_rate(stats: DataFrame) -> Column:
    """Capture rate of the whole table, slightly pulled to one in a hundred; a scalar subquery."""
    return stats.agg(
        ((F.coalesce(F.sum("captures"), F.lit(0)) + 1) / (F.coalesce(F.sum("visits"), F.lit(0)) + 100)).alias("g")
    ).scalar()


def rank_segments(learning: DataFrame, k: int = 30) -> DataFrame:
    """The k segments with the highest smoothed capture rate."""
    stats = segment_stats(learning)
    rate = (F.col("captures") + _global_rate(stats) * 20) / (F.col("visits") + 20)
    return (
        stats.withColumn("smoothed_rate", rate)
        .orderBy(F.desc("smoothed_rate"), "segment_id")
        .limit(k)
    )


def peak_hour(learning: DataFrame) -> DataFrame:
    """Hour of day with the highest smoothed rate; the earliest one on ties. At most 24 groups."""
    rate = (F.sum("target_capture") + 0.5) / (F.count(F.lit(1)) + 5)
    by_hour = learning.groupBy(F.hour("entered_at").alias("hour")).agg(rate.alias("rate"))
    best = by_hour.orderBy(F.desc("rate"), "hour").limit(1)

    def clock(hour: Column) -> Column:
        return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))

    return best.select(
        clock(F.col("hour")).alias("provisional_peak_start"),
        clock((F.col("hour") + 1) % 24).alias("provisional_peak_end"),
        "rate",
    )


def forecast_summary(learning: DataFrame, k: int = 30) -> DataFrame:
    """One row: the provisional peak hour and the ids of the k best segments, best first.

    An empty table gives the status `no-data` and no ids. At most k ids meet in the row.
    """
    best = F.struct((-F.col("smoothed_rate")).alias("rate"), "segment_id")
    top = rank_segments(learning, k).agg(
        F.transform(F.array_sort(F.collect_list(best)), lambda s: s["segment_id"]).alias("top_segment_ids")
    )
    peak = peak_hour(learning)
    return top.select(
        F.when(F.size("top_segment_ids") > 0, "ok").otherwise("no-data").alias("status"),
        F.lit("smoothed capture rate of segment passages").alias("method"),
        *[peak.select(c).scalar().alias(c) for c in ("provisional_peak_start", "provisional_peak_end")],
        "top_segment_ids",
        F.lit("the peak hour is provisional until exposure has been checked on more nights").alias("warning"),
    )


def segment_risk(segments: DataFrame, learning: DataFrame) -> DataFrame:
    """Risk of every segment, visited or not; the global rate is taken over the whole layer."""
    layer = (
        segments.select("segment_id")
        .join(segment_stats(learning), "segment_id", "left")
        .fillna(0, subset=["visits", "captures", "individuals"])
    )
    return layer.withColumns(
        {
            "risk": (F.col("captures") + _global_rate(layer) * 20) / (F.col("visits") + 20),
            "unvisited": F.when(F.col("visits") == 0, 1).otherwise(0),
        }
    )


def missing_rates(learning: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Share of nulls per listed feature in one pass; features the table lacks are reported too."""
    listed = [(g, c) for g, columns in groups.items() for c in columns]
    present = [c for _, c in listed if c in learning.columns]
    one = learning.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in present])
    entries = [
        F.struct(
            F.lit(g).alias("feature_group"),
            F.lit(c).alias("feature"),
            F.lit(c in learning.columns).alias("present"),
            (F.col(c) if c in learning.columns else F.lit(None).cast("double")).alias("missing_rate"),
        )
        for g, c in listed
    ]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def qa_counts(
    points: DataFrame,
    raw_events: DataFrame,
    events: DataFrame,
    learning: DataFrame,
    cutoff: Column,
) -> DataFrame:
    """One row of volumes before the cutoff. Each table is aggregated once, on its own."""
    tracks = points.agg(
        F.count_distinct("session_file").alias("gpx_sessions"), F.count(F.lit(1)).alias("gpx_points")
    )
    raw = raw_events.agg(F.count(F.lit(1)).alias("n"))
    before = F.col("timestamp") < cutoff
    target = before & is_target_capture()
    matched = target & F.col("segment_id").isNotNull()
    unmatched = target & F.col("segment_id").isNull()
    number = F.coalesce(F.col("individual_count"), F.lit(1))
    noted = events.agg(
        F.count(F.lit(1)).alias("deduplicated_event_rows"),
        F.count_if(target).alias("baseline_capture_events"),
        F.sum(F.when(target, number).otherwise(0)).alias("baseline_individuals"),
        F.count_if(matched).alias("baseline_matched_capture_events"),
        F.sum(F.when(matched, number).otherwise(0)).alias("baseline_matched_individuals"),
        F.count_if(unmatched).alias("baseline_unmatched_capture_events"),
        F.sum(F.when(unmatched, number).otherwise(0)).alias("baseline_unmatched_individuals"),
    )
    rows = learning.where(F.col("entered_at") < cutoff).agg(
        F.count(F.lit(1)).alias("learning_rows"),
        F.coalesce(F.sum("target_capture"), F.lit(0)).alias("positive_rows"),
        F.count_distinct("segment_id").alias("visited_segments"),
    )

    def one(df: DataFrame, column: str) -> Column:
        return df.select(column).scalar()

    return noted.select(
        *[one(tracks, c).alias(c) for c in tracks.columns],
        one(raw, "n").alias("raw_event_rows"),
        "*",
        (one(raw, "n") - F.col("deduplicated_event_rows")).alias("duplicates_removed"),
        *[one(rows, c).alias(c) for c in rows.columns],
        (one(rows, "learning_rows") - one(rows, "positive_rows")).alias("zero_rows"),
    )


def unmatched_captures(events: DataFrame, cutoff: Column) -> DataFrame:
    """Captures of the target before the cutoff that no road is near enough to, with the way to the nearest."""
    return events.where((F.col("timestamp") < cutoff) & is_target_capture() & F.col("segment_id").isNull()).select(
        "timestamp",
        "lat",
        "lon",
        F.col("event_match_distance_m").alias("nearest_road_distance_m"),
        F.lit("nearest road exceeds the match limit").alias("reason"),
    )


# Fixed column names that a step needs to be called complete.
WEATHER_COLUMNS = (
    "rain_1h_mm",
    "rain_3h_mm",
    "rain_6h_mm",
    "rain_12h_mm",
    "rain_24h_mm",
    "rain_48h_mm",
    "temperature_c",
    "humidity_pct",
    "dew_point_c",
    "hours_since_rain",
)
TERRAIN_COLUMNS = (
    "slope_observed_deg",
    "junction_distance_m",
    "stream_distance_m",
    "forest_distance_m",
    "residential_distance_m",
)


def step_status(
    learning: DataFrame,
    events: DataFrame,
    cutoff: Column,
    *,
    scored: bool,
    expected: tuple[int, int] | None = None,
) -> DataFrame:
    """How far each of the seven steps of a run has come: `step`, `status`.

    `expected` are the captures and individuals known for the time before the cutoff; without it the second
    step asks only that every capture lies on a segment. `scored` says whether frozen forecasts were
    compared with a hold-out night. Both tables are read once.
    """
    rows = learning.where(F.col("entered_at") < cutoff).agg(
        F.coalesce(F.bool_or(F.col("target_capture") == 0), F.lit(False)).alias("zeros")
    )
    number = F.coalesce(F.col("individual_count"), F.lit(1))
    noted = events.where((F.col("timestamp") < cutoff) & is_target_capture()).agg(
        F.count(F.lit(1)).alias("captures"),
        F.coalesce(F.sum(number), F.lit(0)).alias("individuals"),
        F.count_if(F.col("segment_id").isNull()).alias("lost"),
    )
    placed = F.col("lost") == 0
    if expected is not None:
        placed = placed & (F.col("captures") == expected[0]) & (F.col("individuals") == expected[1])
    has = set(learning.columns)
    bio = any(c.startswith("bio_") and ("_count" in c or "nearest_m" in c) for c in has)

    def step(name: str, done: Column, otherwise: str) -> Column:
        return F.struct(F.lit(name).alias("step"), F.when(done, "complete").otherwise(otherwise).alias("status"))

    steps = [
        step("1_zero_data", rows.select("zeros").scalar(), "incomplete"),
        step("2_captures_on_segments", placed, "partial"),
        step("3_exposure_corrected_time", F.lit(True), "incomplete"),
        step("4_weather_join", F.lit(has.issuperset(WEATHER_COLUMNS)), "incomplete"),
        step("5_bio_time_and_distance", F.lit(bio), "incomplete"),
        step("6_terrain_features", F.lit(has.issuperset(TERRAIN_COLUMNS)), "partial"),
        step("7_prediction_actual_scoring", F.lit(scored), "incomplete"),
    ]
    return noted.select(F.explode(F.array(*steps)).alias("s")).select("s.*")


def brier(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean squared error of `probability` against the 0/1 `label`."""
    error = F.col("probability") - F.col("label")
    return scored.groupBy(*(keys or [])).agg(F.avg(error * error).alias("brier"))


def average_precision(
    scored: DataFrame, keys: list[str] | None = None, *, group_rows: int | None = None
) -> DataFrame:
    """Step-wise average precision; rows of equal score enter together. Null without positives."""
    keys = keys or []
    steps = scored.groupBy(*keys, (-F.col("probability")).alias("_s")).agg(
        F.sum(F.col("label").cast("bigint")).alias("_p"), F.count(F.lit(1)).alias("_n")
    )
    ranked = (
        arrange(steps, keys, ["_s"], group_rows=group_rows)
        .running_sum(_tp=F.col("_p"), _seen=F.col("_n"))
        .done()
    )
    gained = F.sum(F.col("_p") * F.col("_tp") / F.col("_seen"))
    return ranked.groupBy(*keys).agg(
        F.try_divide(gained, F.sum("_p")).alias("average_precision")
    )
