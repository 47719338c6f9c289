"""Registered queries of reports, contracts and scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import contracts as ct
from ..operators import events as evt
from ..operators import report as rp
from ..sources import sinks
from .registry import Tables, query, rounded

# Every located event counts as one passage of its kilometre square.
EXPOSURES_SQL = """
select concat('cell_', cast(floor(x_m / 1000) as bigint), '_', cast(floor(y_m / 1000) as bigint)) as segment_id, timestamp as entered_at,
       case when event_type = 'capture' and species = 'ハブ' then 1 else 0 end as target_capture,
       case when event_type = 'capture' and species = 'ハブ' then individual_count else 0 end as target_individuals,
       case when individual_count = 1 then null else x_m end as elevation_m, other_capture as rain_1h_mm
from field_events where x_m is not null"""
CELLS_SQL = """
select distinct concat('cell_', cast(floor(x0 / 1000) as bigint), '_', cast(floor(y0 / 1000) as bigint)) as segment_id from road_lines"""
STATS_SQL = """
select segment_id, count(*) as visits, cast(sum(target_capture) as bigint) as captures,
       cast(sum(target_individuals) as bigint) as individuals from exposures group by 1"""


def _cell(x: str, y: str):
    square = [F.floor(F.col(c) / 1000).cast("bigint").cast("string") for c in (x, y)]
    return F.concat(F.lit("cell_"), square[0], F.lit("_"), square[1]).alias("segment_id")


def exposures(t: Tables):
    hit = evt.is_target_capture()
    return t.field_events.where("x_m is not null").select(
        _cell("x_m", "y_m"),
        F.col("timestamp").alias("entered_at"),
        F.when(hit, 1).otherwise(0).alias("target_capture"),
        F.when(hit, F.col("individual_count")).otherwise(0).alias("target_individuals"),
        F.when(F.col("individual_count") != 1, F.col("x_m")).alias("elevation_m"),
        F.col("other_capture").alias("rain_1h_mm"),
    )


@query(
    "rank_segments",
    """select segment_id, visits, captures, individuals, round((captures + g * 20) / (visits + 20), 8) as smoothed_rate
       from stats, (select (sum(captures) + 1) / (sum(visits) + 100) as g from stats)
       order by round((captures + g * 20) / (visits + 20), 12) desc, segment_id limit 30""",
    ("exposures", EXPOSURES_SQL),
    ("stats", STATS_SQL),
)
def _(t: Tables):
    return rounded(rp.rank_segments(exposures(t)), "smoothed_rate", digits=8)


@query(
    "peak_hour",
    """select lpad(cast(h as varchar), 2, '0') || ':00' as provisional_peak_start,
              lpad(cast((h + 1) % 24 as varchar), 2, '0') || ':00' as provisional_peak_end, round(r, 8) as rate
       from (select extract(hour from entered_at) as h, (sum(target_capture) + 0.5) / (count(*) + 5) as r
             from exposures group by 1) order by r desc, h limit 1""",
    ("exposures", EXPOSURES_SQL),
)
def _(t: Tables):
    return rounded(rp.peak_hour(exposures(t)), "rate", digits=8)


@query(
    "forecast_summary",
    """select 'ok' as status, a.start as provisional_peak_start, a.stop as provisional_peak_end, b.ids as top_segment_ids
       from (select lpad(cast(h as varchar), 2, '0') || ':00' as start, lpad(cast((h + 1) % 24 as varchar), 2, '0') || ':00' as stop
             from (select extract(hour from entered_at) as h, (sum(target_capture) + 0.5) / (count(*) + 5) as r
                   from exposures group by 1) order by r desc, h limit 1) a,
            (select string_agg(segment_id, ',' order by r desc, segment_id) as ids
             from (select segment_id, round((captures + g * 20) / (visits + 20), 12) as r
                   from stats, (select (sum(captures) + 1) / (sum(visits) + 100) as g from stats)
                   order by r desc, segment_id limit 30)) b""",
    ("exposures", EXPOSURES_SQL),
    ("stats", STATS_SQL),
)
def _(t: Tables):
    found = rp.forecast_summary(exposures(t)).drop("method", "warning")
    return found.withColumn("top_segment_ids", F.array_join("top_segment_ids", ","))


@query(
    "segment_risk",
    """select segment_id, v as visits, c as captures, i as individuals, round((c + g * 20) / (v + 20), 8) as risk,
              case when v = 0 then 1 else 0 end as unvisited
       from layer, (select (sum(c) + 1) / (sum(v) + 100) as g from layer)""",
    ("exposures", EXPOSURES_SQL),
    ("stats", STATS_SQL),
    ("cells", CELLS_SQL),
    (
        "layer",
        """select segment_id, coalesce(visits, 0) as v, coalesce(captures, 0) as c, coalesce(individuals, 0) as i
           from cells left join stats using (segment_id)""",
    ),
)
def _(t: Tables):
    cells = t.road_lines.select(_cell("x0", "y0")).distinct()
    return rounded(rp.segment_risk(cells, exposures(t)), "risk", digits=8)


GROUPS = {"terrain": ["elevation_m", "curvature_deg"], "weather": ["rain_1h_mm"], "time": ["entered_at"]}


@query(
    "feature_missing_rates",
    """select 'terrain' as feature_group, 'elevation_m' as feature, true as present, round(avg(case when elevation_m is null then 1 else 0 end), 8) as missing_rate from exposures
       union all select 'terrain', 'curvature_deg', false, null
       union all select 'weather', 'rain_1h_mm', true, round(avg(case when rain_1h_mm is null then 1 else 0 end), 8) from exposures
       union all select 'time', 'entered_at', true, round(avg(case when entered_at is null then 1 else 0 end), 8) from exposures""",
    ("exposures", EXPOSURES_SQL),
)
def _(t: Tables):
    return rounded(rp.missing_rates(exposures(t), GROUPS), "missing_rate", digits=8)


QA_EVENTS_SQL = "select * replace (case when other_capture is null then segment_id end as segment_id) from field_events"
def _qa_cutoff():
    return F.lit(datetime(2024, 1, 20, 7)).cast("timestamp_ntz")


def _qa_events(t: Tables):
    return t.field_events.withColumn("segment_id", F.when(F.col("other_capture").isNull(), F.col("segment_id")))


TARGET = "timestamp < timestamp '2024-01-20 07:00:00' and species = 'ハブ' and event_type in ('捕獲', 'capture')"


@query(
    "qa_counts",
    f"""select (select count(distinct session_file) from point_rows) as gpx_sessions, (select count(*) from point_rows) as gpx_points,
              (select count(*) from field_events) as raw_event_rows, count(*) as deduplicated_event_rows,
              count(*) filter (where {TARGET}) as baseline_capture_events,
              cast(sum(individual_count) filter (where {TARGET}) as bigint) as baseline_individuals,
              count(segment_id) filter (where {TARGET}) as baseline_matched_capture_events,
              cast(sum(individual_count) filter (where {TARGET} and segment_id is not null) as bigint) as baseline_matched_individuals,
              count(*) filter (where {TARGET} and segment_id is null) as baseline_unmatched_capture_events,
              cast(coalesce(sum(individual_count) filter (where {TARGET} and segment_id is null), 0) as bigint) as baseline_unmatched_individuals,
              (select count(*) from field_events) - count(*) as duplicates_removed,
              (select count(*) from exposures where entered_at < timestamp '2024-01-20 07:00:00') as learning_rows,
              (select cast(sum(target_capture) as bigint) from exposures where entered_at < timestamp '2024-01-20 07:00:00') as positive_rows,
              (select count(distinct segment_id) from exposures where entered_at < timestamp '2024-01-20 07:00:00') as visited_segments,
              (select cast(sum(1 - target_capture) as bigint) from exposures where entered_at < timestamp '2024-01-20 07:00:00') as zero_rows
       from qa_events""",
    ("exposures", EXPOSURES_SQL),
    ("qa_events", QA_EVENTS_SQL),
)
def _(t: Tables):
    events = _qa_events(t)
    distinct_events = evt.dedupe_events(events, ["event_id"])
    return rp.qa_counts(t.point_rows, events, distinct_events, exposures(t), _qa_cutoff())


@query(
    "step_status",
    f"""select unnest(['1_zero_data', '2_captures_on_segments', '3_exposure_corrected_time', '4_weather_join',
                      '5_bio_time_and_distance', '6_terrain_features', '7_prediction_actual_scoring']) as step,
              unnest([case when (select count(*) from exposures where entered_at < timestamp '2024-01-20 07:00:00' and target_capture = 0) > 0
                           then 'complete' else 'incomplete' end,
                      case when count(*) filter (where segment_id is null) = 0 then 'complete' else 'partial' end,
                      'complete', 'incomplete', 'incomplete', 'partial', 'complete']) as status
       from qa_events where {TARGET}""",
    ("exposures", EXPOSURES_SQL),
    ("qa_events", QA_EVENTS_SQL),
)
def _(t: Tables):
    return rp.step_status(exposures(t), _qa_events(t), _qa_cutoff(), scored=True)


@query(
    "unmatched_captures",
    f"""select timestamp, round(lat, 6) as lat, round(lon, 6) as lon, cast(null as double) as nearest_road_distance_m,
              'nearest road exceeds the match limit' as reason from qa_events where segment_id is null and {TARGET}""",
    ("qa_events", QA_EVENTS_SQL),
)
def _(t: Tables):
    events = _qa_events(t).withColumn("event_match_distance_m", F.lit(None).cast("double"))
    return rounded(rp.unmatched_captures(events, _qa_cutoff()), "lat", "lon")


SCORED_SQL = """
select event_id, cast(cast(ts - interval '7' hour as date) as string) as night, case when event_type = 'purchase' then 1 else 0 end as label,
       1 - exp(-value / 50) as probability from events"""


def scored(t: Tables):
    from ..functions.timeops import night_key

    return t.events.select(
        "event_id",
        night_key(F.col("ts")).alias("night"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
        (1 - F.exp(-F.col("value") / 50)).alias("probability"),
    )


@query(
    "brier",
    "select night, round(avg((probability - label) * (probability - label)), 8) as brier from scored group by 1",
    ("scored", SCORED_SQL),
)
def _(t: Tables):
    return rounded(rp.brier(scored(t), ["night"]), "brier", digits=8)


def ap_sql(keys: str) -> str:
    part = f"partition by {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""
select {head}round(sum(p * tp / seen) / sum(p), 8) as average_precision
from (select *, sum(p) over ({part} order by probability desc) as tp, sum(n) over ({part} order by probability desc) as seen
      from (select {head}probability, sum(label) as p, count(*) as n from scored group by {head}probability))
{f'group by {keys}' if keys else ''}"""


@query("average_precision", ap_sql(""), ("scored", SCORED_SQL))
def _(t: Tables):
    return rounded(rp.average_precision(scored(t)), "average_precision", digits=8)


@query("average_precision_by_night", ap_sql("night"), ("scored", SCORED_SQL))
def _(t: Tables):
    return rounded(rp.average_precision(scored(t), ["night"]), "average_precision", digits=8)


# --- contracts -------------------------------------------------------------------------


@query(
    "contract_violations",
    """select cast(event_id as varchar) as record_id, 'capture_of_other_species' as rule from field_events
       where event_type = 'capture' and species <> 'ハブ'
       union all select cast(event_id as varchar), 'count_below_one' from field_events where individual_count < 1
       union all select cast(event_id as varchar), 'presence_time_without_source' from field_events
         where event_type = 'roadkill_sighting' and coalesce(trim(other_capture), '') = ''
       union all select cast(pair_no as varchar), 'end_before_start' from route_intervals where end_time < start_time
       union all select cast(operational_date as varchar), 'point_not_whole_non_negative' from forecast_snapshots where point_prediction - 2 < 0
       union all select cast(event_id as varchar), 'undeclared_influence' from field_events where event_type = 'weather' and species = 'カエル'
       union all select cast(p_partkey as varchar), 'label_blank' from part where p_size > 49""",
)
def _(t: Tables):
    road_finds = t.field_events.select(
        "event_id",
        F.when(F.col("event_type") == "roadkill_sighting", F.col("timestamp")).alias("actual_presence_at"),
        F.col("other_capture").alias("presence_time_source"),
    )
    shifted = t.forecast_snapshots.select(
        F.col("operational_date").cast("string").alias("id"),
        (F.col("point_prediction") - 2).alias("point_prediction"),
    )
    modes = t.field_events.select(
        "event_id",
        F.when(F.col("event_type") == "weather", "ML_ONLY").otherwise("ML_PLUS").alias("prediction_mode"),
        F.when(F.col("species") == "カエル", "prediction_influence").otherwise("explanation_only").alias("influence"),
    )
    options = t.part.select(
        F.col("p_partkey").cast("string").alias("option_id"),
        F.col("p_brand").alias("category"),
        F.when(F.col("p_size") <= 49, F.col("p_name")).otherwise(" ").alias("label"),
    )
    return (
        ct.violations(t.field_events, "event_id", ct.event_rules())
        .unionByName(ct.violations(road_finds, "event_id", ct.presence_rules()))
        .unionByName(ct.violations(t.route_intervals, "pair_no", ct.session_rules("start_time", "end_time")))
        .unionByName(ct.violations(shifted, "id", ct.forecast_rules()))
        .unionByName(ct.violations(modes, "event_id", ct.influence_rules()))
        .unionByName(ct.violations(options, "option_id", ct.option_rules()))
    )


@query(
    "relabelled_options",
    """select cast(p_partkey as varchar) as option_id, p_name as old_label, p_brand || p_name as new_label from part where p_size > 25""",
)
def _(t: Tables):
    before = t.part.select(F.col("p_partkey").cast("string").alias("option_id"), F.col("p_name").alias("label"))
    renamed = F.when(F.col("p_size") > 25, F.concat("p_brand", "p_name")).otherwise(F.col("p_name"))
    after = t.part.select(F.col("p_partkey").cast("string").alias("option_id"), renamed.alias("label"))
    return ct.relabelled_options(before, after)


@query(
    "join_expansion",
    """select cast(o_custkey as varchar) as k, count(*) as rows_after, cast(1 as bigint) as rows_before from orders
       join customer on o_custkey = c_custkey group by 1 having count(*) > 1""",
)
def _(t: Tables):
    before = t.customer.select(F.col("c_custkey").cast("string").alias("k"))
    after = before.join(t.orders.select(F.col("o_custkey").cast("string").alias("k")), "k")
    return ct.expansion(before, after, "k")


# --- layers ----------------------------------------------------------------------------


@query(
    "geojson_features",
    """select event_id, round(lon, 6) as lon, round(lat, 6) as lat,
              case when timestamp >= timestamp '2024-01-20 07:00:00' then 1 else 0 end as is_holdout,
              case when species = 'ハブ' and individual_count = 3 then 1 else 0 end as is_large_target
       from field_events where lat is not null""",
)
def _(t: Tables):
    cutoff = F.lit(datetime(2024, 1, 20, 7)).cast("timestamp_ntz")
    sized = t.field_events.withColumn("size", F.when(F.col("individual_count") == 3, "大"))
    layer = sinks.event_layer(sized, cutoff, "ハブ")
    features = sinks.geojson_features(
        layer, sinks.point_geometry(F.col("lon"), F.col("lat")), ["event_id", "is_holdout", "is_large_target"]
    )
    # read the written form back, as a map would
    parsed = features.select(
        F.from_json(
            "value",
            "type string, geometry struct<type:string,coordinates:array<double>>,"
            "properties struct<event_id:bigint,is_holdout:int,is_large_target:int>",
        ).alias("f")
    )
    place = F.col("f.geometry.coordinates")
    return parsed.select(
        "f.properties.event_id",
        F.round(place[0], 6).alias("lon"),
        F.round(place[1], 6).alias("lat"),
        "f.properties.is_holdout",
        "f.properties.is_large_target",
    )
