"""Registered queries of tracks, events, text fields and intervals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import timeops as to
from ..functions.geodesy import angle_difference, axis_difference, geodesic_step, with_plane
from ..operators import events as evt
from ..operators import intervals as iv
from ..operators import tracks as tr
from ..params import Params
from .registry import Tables, query, rounded

NIGHT_SQL = "cast(cast(timestamp - interval '7' hour as date) as string)"


def seconds_sql(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b}) / 1e6)"


def step_sql(la1: str, lo1: str, la2: str, lo2: str) -> tuple[str, str]:
    """Distance and azimuth of a short step, written out for the checker."""
    e2 = "0.0066943799901413165"
    mid = f"radians(({la1} + {la2}) / 2)"
    w = f"(1 - {e2} * sin({mid}) * sin({mid}))"
    north = f"(6378137.0 * (1 - {e2}) / ({w} * sqrt({w})) * radians({la2} - {la1}))"
    east = f"(6378137.0 / sqrt({w}) * cos({mid}) * radians({lo2} - {lo1}))"
    dist = f"sqrt({north} * {north} + {east} * {east})"
    az = f"degrees(atan2({east}, {north}) - radians({lo2} - {lo1}) * sin({mid}) / 2)"
    return dist, f"(({az} + 360) % 360)"


STEP, AZIMUTH = step_sql("la", "lo", "lat", "lon")

DYNAMICS_SQL = f"""
select *, {STEP} as step_m, {AZIMUTH} as heading_deg,
       {STEP} / nullif({seconds_sql('tp', 'timestamp')}, 0) as speed_mps
from (select *, lag(lat) over w as la, lag(lon) over w as lo, lag(timestamp) over w as tp
      from points window w as (partition by session_file order by seq))"""

VISITS_SQL = """
select session_file, visit_index, segment_id, min(timestamp) as entered_at, max(timestamp) as exited_at,
       count(seq) as point_count, avg(speed_mps) as mean_speed_mps,
       avg(match_distance_m) as mean_match_distance_m, median(elevation_m) as elevation_m,
       date_diff('microsecond', min(timestamp), max(timestamp)) / 1e6 as duration_s
from (select *, cast(sum(case when segment_id = prev then 0 else 1 end)
                     over (partition by session_file order by seq) as bigint) as visit_index
      from (select *, lag(segment_id) over (partition by session_file order by seq) as prev
            from dynamics where segment_id is not null))
group by 1, 2, 3"""


def dynamics(t: Tables):
    return tr.track_dynamics(t.points)


def visits(t: Tables):
    return tr.segment_visits(dynamics(t))


@query(
    "op_night",
    f"select event_id, {NIGHT_SQL} as night_date, {NIGHT_SQL} as operational_date_0700 from field_events",
)
def _(t: Tables):
    return evt.operational_night(t.field_events).select(
        "event_id", "night_date", "operational_date_0700"
    )


@query("bin_10min", "select event_id, time_bucket(interval '10 minutes', ts) as bin_start from events")
def _(t: Tables):
    return t.events.select("event_id", to.bin_start(F.col("ts")).alias("bin_start"))


@query(
    "cyclic_hour",
    """select event_id, round(h, 6) as hour, round(sin(2 * pi() * h / 24), 6) as sin_hour,
              round(cos(2 * pi() * h / 24), 6) as cos_hour
       from (select event_id, extract(hour from ts) + extract(minute from ts) / 60.0 as h from events)""",
)
def _(t: Tables):
    hour, sin, cos = to.cyclic_hour(F.col("ts"))
    return rounded(
        t.events.select("event_id", hour.alias("hour"), sin.alias("sin_hour"), cos.alias("cos_hour")),
        "hour", "sin_hour", "cos_hour",
    )


SPECIES_SQL = "case " + " ".join(
    f"when contains({{c}}, '{w}') then '{w}'" for w in tx.SPECIES_WORDS
) + f" else '{tx.OTHER_SPECIES}' end"
COUNT_SQL = (
    "coalesce(try_cast(nullif(regexp_extract(translate({c}, '０１２３４５６７８９', '0123456789'),"
    " '([0-9]+)匹', 1), '') as bigint), 1)"
)


@query("species_extract", f"select event_id, {SPECIES_SQL.format(c='raw_text')} as species from field_notes")
def _(t: Tables):
    return t.field_notes.select("event_id", tx.species(F.col("raw_text")).alias("species"))


@query("count_extract", f"select event_id, {COUNT_SQL.format(c='raw_text')} as individual_count from field_notes")
def _(t: Tables):
    return t.field_notes.select(
        "event_id", tx.individual_count(F.col("raw_text")).alias("individual_count")
    )


STRIPPED = r"regexp_replace(x, '^[\s　]+|[\s　]+$', '', 'g')"
FIELDS_SQL = f"""
select event_id,
       case when list_contains(l, '捕獲') then '捕獲' when list_contains(l, '轢死') then '轢死'
            when list_contains(l, '目撃') then '目撃' end as event_type,
       {SPECIES_SQL.format(c='raw_text')} as species, {COUNT_SQL.format(c='raw_text')} as individual_count,
       case when contains(raw_text, 'ハブ捕獲大') then '大' when contains(raw_text, 'ハブ捕獲中') then '中'
            when contains(raw_text, 'ハブ捕獲小') then '小' when contains(raw_text, '極小') then '極小' end as size,
       case when contains(raw_text, 'ソークド(水跳ね)') then 'ソークド(水跳ね)' when contains(raw_text, 'ウェット') then 'ウェット'
            when contains(raw_text, 'ウエット') then 'ウエット' when contains(raw_text, '湿り') then '湿り'
            when contains(raw_text, 'ドライ') then 'ドライ' end as wetness,
       cast(list_filter(l, lambda x: regexp_full_match(x, '28\\.[0-9]+'))[-1] as double) as lat,
       cast(list_filter(l, lambda x: regexp_full_match(x, '129\\.[0-9]+'))[-1] as double) as lon
from (select *, list_transform(string_split(raw_text, chr(10)), lambda x: {STRIPPED}) as l from field_notes)"""


@query("event_fields", FIELDS_SQL)
def _(t: Tables):
    return evt.event_fields(t.field_notes.select("event_id", "raw_text")).drop("raw_text")


GEO_STEP = step_sql("28.1456", "129.32", "lat", "lon")


@query(
    "geo_step",
    f"select event_id, round({GEO_STEP[0]}, 5) as distance_m, round({GEO_STEP[1]}, 6) as azimuth_deg from point_rows",
)
def _(t: Tables):
    dist, az = geodesic_step("28.1456D", "129.32D", "lat", "lon")
    return t.point_rows.select(
        "event_id", F.round(dist, 5).alias("distance_m"), F.round(az, 6).alias("azimuth_deg")
    )


@query(
    "angle_diff",
    """select event_id, round(d, 6) as angle_deg, round(least(d, abs(180 - d)), 6) as axis_deg
       from (select event_id, case when value is null then 0.0 else
                    least(abs(value * 7.3 - event_id) % 360, 360 - abs(value * 7.3 - event_id) % 360) end as d from events)""",
)
def _(t: Tables):
    a, b = F.col("value") * F.lit(7.3), F.col("event_id").cast("double")
    return t.events.select(
        "event_id",
        F.round(angle_difference(a, b), 6).alias("angle_deg"),
        F.round(axis_difference(a, b), 6).alias("axis_deg"),
    )


def project_sql(lat: str, lon: str) -> tuple[str, list[tuple[str, str]]]:
    """Krüger series of order four about 129.5 E, 33 N, scale 0.9999, written out in steps."""
    n = 1 / 298.257222101 / (2 - 1 / 298.257222101)
    alpha = (
        n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
        13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
        61 / 240 * n**3 - 103 / 140 * n**4,
        49561 / 161280 * n**4,
    )
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)

    def north(xi: str, eta: str) -> str:
        return f"{xi} + " + " + ".join(
            f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)
        )

    east = "eta + " + " + ".join(
        f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1)
    )
    conformal = "sinh(atanh(sin({p})) - {e!r} * atanh({e!r} * sin({p})))"
    steps = [
        ("tm_t", f"select *, {conformal.format(p=f'radians({lat})', e=e)} as tt, radians({lon} - 129.5) as dl from point_rows"),
        ("tm_xi", "select *, atan2(tt, cos(dl)) as xi, atanh(sin(dl) / sqrt(1 + tt * tt)) as eta from tm_t"),
        ("tm_0", f"select atan({conformal.format(p='radians(33.0)', e=e)}) as xi"),
    ]
    sql = (
        f"select event_id, round({0.9999 * radius!r} * ({east}), 4) as x_m,"
        f" round({0.9999 * radius!r} * (({north('xi', 'eta')}) - (select {north('xi', '0')} from tm_0)), 4) as y_m from tm_xi"
    )
    return sql, steps


PROJECT_SQL, PROJECT_STEPS = project_sql("lat", "lon")


@query("project_tm", PROJECT_SQL, *PROJECT_STEPS)
def _(t: Tables):
    placed = with_plane(t.point_rows.drop("x_m", "y_m"))
    return rounded(placed.select("event_id", "x_m", "y_m"), "x_m", "y_m", digits=4)


@query(
    "activity_time",
    """select event_id, case when event_type = 'roadkill_sighting'
              then case when individual_count > 1 then timestamp - interval '2' hour end
              else timestamp end as activity_at from field_events""",
)
def _(t: Tables):
    kind = F.when(F.col("event_type") == "roadkill_sighting", "road_event").otherwise("other")
    presence = F.when(F.col("individual_count") > 1, F.col("timestamp") - F.expr("INTERVAL '2' HOUR"))
    return t.field_events.select(
        "event_id", to.activity_time(kind, F.col("timestamp"), presence).alias("activity_at")
    )


@query(
    "capture_filter",
    "select event_id, individual_count from field_events where species = 'ハブ' and event_type in ('捕獲', 'capture')",
)
def _(t: Tables):
    return evt.capture_filter(t.field_events).select("event_id", "individual_count")


@query("context_filter", "select event_id, species from field_events where species not in ('ハブ', 'アカマタ')")
def _(t: Tables):
    return evt.context_events(t.field_events).select("event_id", "species")


SPLIT = Params(
    baseline_cutoff=datetime(2024, 1, 20, 7),
    holdout_start=datetime(2024, 1, 20, 7),
)


@query(
    "split_cutoff",
    """select event_id, case when timestamp < timestamp '2024-01-20 07:00:00' then 'train' else 'holdout' end as part
       from field_events""",
)
def _(t: Tables):
    train, hold = evt.split_cutoff(t.field_events, "timestamp", SPLIT)
    return train.select("event_id", F.lit("train").alias("part")).unionByName(
        hold.select("event_id", F.lit("holdout").alias("part"))
    )


# The given events are distinct, so the check coarsens them to make copies.
COARSE_SQL = """
select event_id, date_trunc('hour', timestamp) as timestamp, species, event_type,
       case when event_id % 7 = 0 then null else 28.1 end as lat, case when event_id % 7 = 0 then null else 129.3 end as lon,
       case when individual_count = 1 then null else concat('n', individual_count) end as raw_text from field_events"""


@query(
    "dedupe_events",
    """select min(event_id) as event_id, count(*) as copies from coarse
       group by timestamp, species, event_type, coalesce(lat, 0), coalesce(lon, 0), coalesce(raw_text, '')""",
    ("coarse", COARSE_SQL),
)
def _(t: Tables):
    missing = F.col("event_id") % 7 == 0
    coarse = t.field_events.select(
        "event_id",
        to.bin_start(F.col("timestamp"), 60).alias("timestamp"),
        "species",
        "event_type",
        F.when(~missing, 28.1).alias("lat"),
        F.when(~missing, 129.3).alias("lon"),
        F.when(F.col("individual_count") != 1, F.concat(F.lit("n"), "individual_count")).alias("raw_text"),
    )
    return evt.dedupe_events(coarse, ["event_id"]).select("event_id", "copies")


@query(
    "tie_collapse",
    """select source_id, segment_id, event_match_distance_m from (
         select *, row_number() over (partition by source_id order by event_match_distance_m nulls last, coalesce(segment_id, '')) as rn
         from (select distinct event_id // 4 as source_id, segment_id, floor(match_distance_m / 8) as event_match_distance_m from point_rows))
       where rn = 1""",
)
def _(t: Tables):
    matches = t.point_rows.select(
        F.floor(F.col("event_id") / 4).alias("source_id"),
        "segment_id",
        F.floor(F.col("match_distance_m") / 8).cast("double").alias("event_match_distance_m"),
    )
    return evt.tie_collapse(matches, "source_id")


@query(
    "score_frozen_windows",
    f"""select cast(operational_date as string) as operational_date_0700, point_prediction,
              count(*) as actual_capture_events, cast(sum(individual_count) as bigint) as actual_individuals,
              count(*) filter (where m between 900 and 1020) as main_events,
              count(*) filter (where m between 900 and 1020) > 0 as main_hit,
              count(*) filter (where m between 1115 and 1175) as secondary_events,
              count(*) filter (where m between 1115 and 1175) > 0 as secondary_hit,
              sum(individual_count) between point_prediction - 1 and point_prediction + 1 as range_hit,
              cast(sum(individual_count) - point_prediction as bigint) as point_error, 'scored' as status
       from (select f.*, e.individual_count,
                    date_diff('microsecond', cast(f.operational_date as timestamp) + interval '7' hour, e.timestamp) / 60e6 as m
             from forecast_snapshots f join field_events e
               on f.operational_date = cast(e.timestamp - interval '7' hour as date)
             where e.species = 'ハブ' and e.event_type in ('捕獲', 'capture')) group by operational_date, point_prediction
       union all
       select cast(operational_date as string), point_prediction, null, null, null, null, null, null, null, null, 'no-holdout-events'
       from forecast_snapshots f where not exists (
         select 1 from field_events e where f.operational_date = cast(e.timestamp - interval '7' hour as date)
           and e.species = 'ハブ' and e.event_type in ('捕獲', 'capture'))""",
)
def _(t: Tables):
    return evt.score_frozen_windows(
        t.forecast_snapshots, t.field_events, main=(900, 1020), secondary=(1115, 1175)
    )


@query(
    "track_dynamics",
    f"select event_id, session_file, seq, round(step_m, 5) as step_m, round(heading_deg, 6) as heading_deg,"
    f" round(speed_mps, 6) as speed_mps from dynamics",
    ("dynamics", DYNAMICS_SQL),
)
def _(t: Tables):
    out = dynamics(t).select("event_id", "session_file", "seq", "step_m", "heading_deg", "speed_mps")
    return rounded(rounded(out, "heading_deg", "speed_mps"), "step_m", digits=5)


@query(
    "segment_visits",
    "select * replace (round(mean_speed_mps, 6) as mean_speed_mps, round(mean_match_distance_m, 6) as"
    " mean_match_distance_m, round(elevation_m, 6) as elevation_m, round(duration_s, 6) as duration_s) from visits",
    ("dynamics", DYNAMICS_SQL),
    ("visits", VISITS_SQL),
)
def _(t: Tables):
    return rounded(visits(t), "mean_speed_mps", "mean_match_distance_m", "elevation_m", "duration_s")


RUNS_SQL = """
select session_file, run_id, count(*) as run_points, min(seq) as seq_start, max(seq) as seq_end,
       min(timestamp) as time_start, max(timestamp) as time_end
from (select *, cast(sum(case when segment_id is null then 0 else 1 end) over (partition by session_file order by seq) as bigint) as run_id
      from points) where segment_id is null group by 1, 2 having count(*) >= 3"""


@query("unmatched_runs", RUNS_SQL)
def _(t: Tables):
    return tr.run_summary(tr.unmatched_runs(t.points, min_points=3))


@query(
    "session_gate",
    """select event_id, case when r >= 0.8 then segment_id end as segment_id,
              round(r, 6) as session_map_match_ratio, r >= 0.8 as strict_session_eligible
       from (select *, count(segment_id) over (partition by session_file) / count(*) over (partition by session_file) as r from point_rows)""",
)
def _(t: Tables):
    out = tr.session_gate(t.point_rows).select(
        "event_id", "segment_id", "session_map_match_ratio", "strict_session_eligible"
    )
    return rounded(out, "session_map_match_ratio")


@query(
    "track_qc",
    f"""select operational_date_0700, count(*) as gps_points, min(timestamp) as start_time, max(timestamp) as end_time,
              round(coalesce(sum(step), 0) / 1000, 4) as distance_km, max(gap) as max_gap_s,
              count(*) filter (where gap > 300) as gaps_over_limit, round(median(gap), 3) as median_gap_s,
              round(quantile_cont(gap, 0.95), 3) as p95_gap_s,
              round(date_diff('microsecond', min(timestamp), max(timestamp)) / 3600e6, 6) as duration_h
       from (select *, {STEP} as step, {seconds_sql('tp', 'timestamp')} as gap
             from (select *, lag(lat) over w as la, lag(lon) over w as lo, lag(timestamp) over w as tp
                   from (select *, {NIGHT_SQL} as operational_date_0700 from points)
                   window w as (partition by session_file, operational_date_0700 order by seq))) group by 1""",
)
def _(t: Tables):
    # half microseconds occur in medians, so gaps are compared to the millisecond
    gaps = rounded(tr.track_qc(t.points), "median_gap_s", "p95_gap_s", digits=3)
    return rounded(rounded(gaps, "duration_h"), "distance_km", digits=4)


@query(
    "route_lines",
    """select session_file, count(*) as vertices, arg_min(lon, seq) as first_lon, arg_max(lat, seq) as last_lat
       from points group by 1 having count(*) > 1""",
)
def _(t: Tables):
    return tr.route_lines(t.points).select(
        "session_file",
        F.size("line").cast("bigint").alias("vertices"),
        F.col("line")[0]["x"].alias("first_lon"),
        F.element_at("line", -1)["y"].alias("last_lat"),
    )


VERIFIED_SQL = """
select *, date_diff('microsecond', start_time, end_time) / 60e6 as interval_minutes,
       time_bucket(interval '10 minutes', start_time) as road10_bin_start,
       end_time >= start_time and route_class in ('確定一本道区間', 'UNIQUE_ROUTE')
         and time_bucket(interval '10 minutes', start_time) = time_bucket(interval '10 minutes', end_time) as strict_road10_verified,
       end_time >= start_time and route_class in ('確定一本道区間', 'UNIQUE_ROUTE')
         and time_bucket(interval '10 minutes', start_time) = time_bucket(interval '10 minutes', end_time) as can_generate_no_capture_observed,
       case when not end_time >= start_time then 'invalid_or_missing_anchor_time'
            when not route_class in ('確定一本道区間', 'UNIQUE_ROUTE') then 'route_not_unique'
            when time_bucket(interval '10 minutes', start_time) <> time_bucket(interval '10 minutes', end_time) then 'crosses_10min_bin'
            else 'unique_route_inside_single_10min_bin' end as verification_reason
from route_intervals"""


@query("verify_intervals", VERIFIED_SQL)
def _(t: Tables):
    return iv.verify_intervals(t.route_intervals)


@query(
    "interval_summary",
    """select operational_date_0700, count(*) as interval_count,
              count(*) filter (where strict_road10_verified) as strict_interval_count,
              count(*) filter (where strict_road10_verified) / count(*) as strict_interval_ratio
       from verified group by 1""",
    ("verified", VERIFIED_SQL),
)
def _(t: Tables):
    return iv.interval_summary(iv.verify_intervals(t.route_intervals))


@query(
    "label_intervals",
    """select pair_no, count(e.event_id) as target_event_count,
              case when count(e.event_id) > 0 then 'Positive' else 'NO_CAPTURE_OBSERVED' end as label,
              coalesce(string_agg(distinct e.event_type, ' | ' order by e.event_type), '') as target_event_types
       from verified v left join (select * from field_events where species = 'ハブ' and event_type in
              ('捕獲', 'capture', '目撃', 'sighting', '轢死', 'roadkill_sighting')) e
         on e.timestamp between v.start_time and v.end_time
       where strict_road10_verified group by pair_no""",
    ("verified", VERIFIED_SQL),
)
def _(t: Tables):
    strict = iv.verify_intervals(t.route_intervals).where("strict_road10_verified")
    return iv.label_intervals(strict, t.field_events, interval_id=["pair_no"]).select(
        "pair_no", "target_event_count", "label", "target_event_types"
    )


WIDE = Params(outcome_window_s=6 * 3600)


@query(
    "label_outcomes",
    """select session_file, visit_index, case when count(e.event_id) > 0 then 1 else 0 end as target_capture,
              cast(coalesce(sum(e.individual_count), 0) as bigint) as target_individuals
       from visits v left join (select * from field_events where species = 'ハブ' and event_type in ('捕獲', 'capture')) e
         on e.segment_id = v.segment_id and e.timestamp between v.entered_at - interval '6' hour and v.entered_at + interval '6' hour
       group by 1, 2""",
    ("dynamics", DYNAMICS_SQL),
    ("visits", VISITS_SQL),
)
def _(t: Tables):
    # visits are hours apart in the given tables, hence the wide window
    return evt.label_outcomes(
        visits(t), t.field_events, visit_id=["session_file", "visit_index"], p=WIDE
    ).select("session_file", "visit_index", "target_capture", "target_individuals")
