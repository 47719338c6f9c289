"""Registered queries of roads, map matching, weather and visit features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import polyline as pl
from ..operators import features as ft
from ..operators.areas import inside_areas
from ..operators.joins import edge_rows
from ..operators import mapmatch as mm
from ..operators import roads as rd
from ..operators import weather as we
from ..operators.tracks import track_dynamics
from ..params import BIO_SPECIES
from ..session import stored

from .queries_tracks import DYNAMICS_SQL, VISITS_SQL, visits
from .registry import Tables, query, rounded

VISIT_TABLES = (("dynamics", DYNAMICS_SQL), ("visits", VISITS_SQL))
VISIT_KEY = ["session_file", "visit_index"]

# --- roads -----------------------------------------------------------------------------

PIECES_SQL = """
select *, 'OSM_' || way_id || '_0_' || i as segment_id, least((i + 1) * 10.0, len) - i * 10.0 as length_m,
       x0 + i * 10.0 / len * (x1 - x0) as sx, y0 + i * 10.0 / len * (y1 - y0) as sy,
       x0 + least((i + 1) * 10.0, len) / len * (x1 - x0) as ex, y0 + least((i + 1) * 10.0, len) / len * (y1 - y0) as ey
from (select *, unnest(range(0, greatest(1, cast(ceil(len / 10) as bigint)))) as i
      from (select *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as len from road_lines) where len > 0)"""


def parts(t: Tables):
    return t.road_lines.select(
        "way_id",
        F.lit(0).alias("part_index"),
        "highway",
        F.expr(pl.straight("x0", "y0", "x1", "y1")).alias("line"),
    )


def segments(t: Tables):
    return rd.road_segments(parts(t))


@query(
    "segment_lines",
    """select segment_id, way_id, i as segment_index, round(length_m, 6) as length_m, round(sx, 6) as sx, round(sy, 6) as sy,
              round(ex, 6) as ex, round(ey, 6) as ey from pieces""",
    ("pieces", PIECES_SQL),
)
def _(t: Tables):
    line = F.col("line")
    out = segments(t).select(
        "segment_id",
        "way_id",
        "segment_index",
        "length_m",
        line[0]["x"].alias("sx"),
        line[0]["y"].alias("sy"),
        F.element_at(line, -1)["x"].alias("ex"),
        F.element_at(line, -1)["y"].alias("ey"),
    )
    return rounded(out, "length_m", "sx", "sy", "ex", "ey")


BEND_SQL = """
select way_id, (degrees(atan2(x1 - x0, y1 - y0)) + 360) % 360 as b1,
       (degrees(atan2(y1 - y0 + 1 - (x1 - x0), x1 - x0 + 40 - (y1 - y0))) + 360) % 360 as b2,
       (degrees(atan2(y1 - y0 + 1, x1 - x0 + 40)) + 360) % 360 as whole from road_lines"""


@query(
    "seg_bearing",
    """select way_id, round(whole, 6) as bearing_deg,
              round(least(abs(b1 - b2), 360 - abs(b1 - b2)), 6) as curvature_deg from bends""",
    ("bends", BEND_SQL),
)
def _(t: Tables):
    # each road with one more vertex, so that it has a bend
    third = pl.vertex("x0 + (y1 - y0) + 1", "y0 + (x1 - x0) + 40")
    bent = F.expr(f"concat({pl.straight('x0', 'y0', 'x1', 'y1')}, array({third}))")
    out = t.road_lines.select("way_id", bent.alias("line")).select(
        "way_id",
        F.expr(pl.line_bearing("line")).alias("bearing_deg"),
        F.expr(pl.curvature("line")).alias("curvature_deg"),
    )
    return rounded(out, "bearing_deg", "curvature_deg")


@query(
    "road_class_code",
    "select way_id, cast(dense_rank() over (order by highway) - 1 as double) as road_class_code from road_lines",
)
def _(t: Tables):
    return rd.road_class_codes(t.road_lines).select("way_id", "road_class_code")


@query(
    "junctions",
    """select x, y, count(*) as degree from (
         select round_even(sx, 1) as x, round_even(sy, 1) as y from pieces
         union all select round_even(ex, 1), round_even(ey, 1) from pieces) group by 1, 2 having count(*) >= 2""",
    ("pieces", PIECES_SQL),
)
def _(t: Tables):
    return rd.junctions(segments(t), min_degree=2)


@query(
    "combine_roads",
    """select segment_id, length_m, road_source, highway from (
         select segment_id, round(length_m, 6) as length_m, 'osm' as road_source, highway from pieces
         union all select 'X_' || way_id, round(len, 6), 'gpx_recovered', null from
           (select *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as len from road_lines) where len > 0)""",
    ("pieces", PIECES_SQL),
)
def _(t: Tables):
    extra = (
        parts(t)
        .select(
            F.concat(F.lit("X_"), "way_id").alias("segment_id"),
            F.expr(pl.length("line")).alias("length_m"),
            F.lit("gpx_recovered").alias("road_source"),
        )
        .where("length_m > 0")
    )
    base = segments(t).select("segment_id", "length_m", "highway")
    return rounded(rd.combine_roads(base, extra), "length_m")


@query(
    "static_join",
    """select v.session_file, v.visit_index, r.highway, r.x0 as road_x from visits v left join
         (select *, 'seg_' || (cast(substr(way_id, 2) as bigint) - 1) as segment_id from road_lines) r using (segment_id)""",
    *VISIT_TABLES,
)
def _(t: Tables):
    roads = t.road_lines.select(
        F.concat(F.lit("seg_"), (F.substring("way_id", 2, 20).cast("bigint") - 1).cast("string")).alias(
            "segment_id"
        ),
        "highway",
        F.col("x0").alias("road_x"),
    )
    return ft.static_join(visits(t), roads, ["highway", "road_x"]).select(
        *VISIT_KEY, "highway", "road_x"
    )


# --- map matching ----------------------------------------------------------------------

CANDIDATES_SQL = """
select *, match_distance_m + 12.0 * (least(turn, abs(180 - turn)) / 90.0) as base_score from (
  select session_file, seq, segment_id, match_distance_m,
         coalesce(least(abs(heading_deg - bearing) % 360, 360 - abs(heading_deg - bearing) % 360), 0.0) as turn
  from (select p.session_file, p.seq, p.heading_deg, s.segment_id,
               (degrees(atan2(ex - sx, ey - sy)) + 360) % 360 as bearing,
               sqrt((px - (sx + t * dx)) * (px - (sx + t * dx)) + (py - (sy + t * dy)) * (py - (sy + t * dy))) as match_distance_m
        from (select p.*, s.*, least(1.0, greatest(0.0, ((px - sx) * dx + (py - sy) * dy) / (dx * dx + dy * dy))) as t
              from (select session_file, seq, heading_deg, x_m as px, y_m as py from dynamics) p
              join (select segment_id, sx, sy, ex, ey, ex - sx as dx, ey - sy as dy from pieces) s
                on px between least(sx, ex) - 35 and greatest(sx, ex) + 35
               and py between least(sy, ey) - 35 and greatest(sy, ey) + 35) as p(session_file, seq, heading_deg, px, py, segment_id, sx, sy, ex, ey, dx, dy, t),
             lateral (select segment_id) s)
  where match_distance_m <= 35)"""

MATCH_TABLES = (("dynamics", DYNAMICS_SQL), ("pieces", PIECES_SQL), ("candidates", CANDIDATES_SQL))


def located_points(t: Tables):
    return track_dynamics(t.points.drop("segment_id", "match_distance_m"))


@query(
    "map_match_candidates",
    """select session_file, seq, segment_id, round(match_distance_m, 6) as match_distance_m,
              round(base_score, 5) as base_score from candidates""",
    *MATCH_TABLES,
)
def _(t: Tables):
    out = mm.map_match_candidates(located_points(t), segments(t))
    return rounded(rounded(out, "match_distance_m"), "base_score", digits=5)


MATCH_SQL = """
with recursive walk as (
  select session_file, cast(-1 as bigint) as seq, cast(null as varchar) as segment_id, cast(null as double) as match_distance_m,
         cast(null as double) as match_score, cast(null as varchar) as held
  from (select distinct session_file from dynamics)
  union all
  select session_file, seq, b.id, b.d, b.s, coalesce(b.id, held)
  from (select w.session_file, p.seq, w.held,
               min(case when c.segment_id is not null then struct_pack(
                 s := c.base_score + case when w.held is null or w.held = c.segment_id then 0.0 else 8.0 end,
                 id := c.segment_id, d := c.match_distance_m) end) as b
        from walk w join dynamics p on p.session_file = w.session_file and p.seq = w.seq + 1
        left join candidates c on c.session_file = p.session_file and c.seq = p.seq
        group by w.session_file, p.seq, w.held))
select session_file, seq, segment_id, round(match_distance_m, 6) as match_distance_m, round(match_score, 5) as match_score
from walk where seq >= 0"""


@query("map_match", "select * from matched", *MATCH_TABLES, ("matched", MATCH_SQL))
def _(t: Tables):
    out = mm.map_match(located_points(t), segments(t)).select(
        "session_file", "seq", "segment_id", "match_distance_m", "match_score"
    )
    return rounded(rounded(out, "match_distance_m"), "match_score", digits=5)


EDGE_DISTANCE = """sqrt((px - (x0 + t * (x1 - x0))) * (px - (x0 + t * (x1 - x0)))
                      + (py - (y0 + t * (y1 - y0))) * (py - (y0 + t * (y1 - y0))))"""
ALONG = """case when x1 = x0 and y1 = y0 then 0.0 else least(1.0, greatest(0.0,
             ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) end"""


# whole roads first, then the ten-metre pieces of those as near as the nearest one
@query(
    "event_nearest_road",
    f"""select event_id, case when b.d <= 50 then b.id end as segment_id, round(b.d, 6) as event_match_distance_m,
               case when b.d <= 50 then '' else 'nearest road exceeds the match limit' end as unmatched_reason
        from (select event_id, min(struct_pack(d := {EDGE_DISTANCE}, id := segment_id)) as b
              from (select *, {ALONG} as t
                    from (select event_id, px, py, p.segment_id, p.sx as x0, p.sy as y0, p.ex as x1, p.ey as y1
                          from near_roads n join pieces p using (way_id)))
              group by event_id)""",
    ("pieces", PIECES_SQL),
    (
        "near_roads",
        f"""select event_id, px, py, way_id from (
              select event_id, px, py, way_id, {EDGE_DISTANCE} as d, min({EDGE_DISTANCE}) over (partition by event_id) as least_d
              from (select *, {ALONG} as t from (select event_id, x_m as px, y_m as py from field_events where x_m is not null) e,
                           (select * from road_lines where x0 <> x1 or y0 <> y1) r))
            where d <= least_d + 1e-6""",
    ),
)
def _(t: Tables):
    out = mm.event_nearest_road(t.field_events, segments(t)).select(
        "event_id", "segment_id", "event_match_distance_m", "unmatched_reason"
    )
    return rounded(out, "event_match_distance_m")


@query("events_without_position", "select event_id from field_events where x_m is null")
def _(t: Tables):
    return mm.events_without_position(t.field_events).select("event_id")


# --- weather ---------------------------------------------------------------------------


@query(
    "rolling_rain",
    "select station, timestamp, precip_mm as rain_1h_mm, "
    + ", ".join(
        f"sum(precip_mm) over (partition by station order by timestamp rows between {n - 1} preceding and current row)"
        f" as rain_{n}h_mm"
        for n in we.RAIN_ROWS
    )
    + " from weather_hourly",
)
def _(t: Tables):
    return we.rolling_rain(t.weather_hourly).drop("precip_mm", "temperature_c")


@query(
    "hours_since_rain",
    """select station, timestamp, round(date_diff('second', last_value(case when precip_mm > 0 then timestamp end ignore nulls)
              over (partition by station order by timestamp rows between unbounded preceding and current row), timestamp) / 3600.0, 6)
         as hours_since_rain from weather_hourly""",
)
def _(t: Tables):
    out = we.hours_since_rain(t.weather_hourly).select("station", "timestamp", "hours_since_rain")
    return rounded(out, "hours_since_rain")


# The track points name three segments; they lie where the first three roads do.
SEGMENT_PLACES_SQL = """
select 'seg_' || (cast(substr(way_id, 2) as bigint) - 1) as segment_id, (x0 + x1) / 2 as segment_x_m, (y0 + y1) / 2 as segment_y_m
from road_lines where way_id in ('P1', 'P2', 'P3')"""
ASSIGNED_SQL = """
select segment_id, arg_min(station, struct_pack(
         d := sqrt((x_m - segment_x_m) * (x_m - segment_x_m) + (y_m - segment_y_m) * (y_m - segment_y_m)), s := station)) as station,
       min(sqrt((x_m - segment_x_m) * (x_m - segment_x_m) + (y_m - segment_y_m) * (y_m - segment_y_m))) as station_distance_m
from segment_places, stations group by 1"""
STATION_TABLES = (("segment_places", SEGMENT_PLACES_SQL), ("assigned", ASSIGNED_SQL))


def segment_places(t: Tables):
    number = F.substring("way_id", 2, 20).cast("bigint") - 1
    return t.road_lines.where(F.col("way_id").isin("P1", "P2", "P3")).select(
        F.concat(F.lit("seg_"), number.cast("string")).alias("segment_id"),
        ((F.col("x0") + F.col("x1")) / 2).alias("segment_x_m"),
        ((F.col("y0") + F.col("y1")) / 2).alias("segment_y_m"),
    )


@query(
    "nearest_stations",
    """select segment_id, s.station, round(s.d, 6) as station_distance_m from (
         select p.segment_id, min(struct_pack(
                d := sqrt((x_m - (sx + ex) / 2) * (x_m - (sx + ex) / 2) + (y_m - (sy + ey) / 2) * (y_m - (sy + ey) / 2)), station := station)) as s
         from pieces p, stations group by 1)""",
    ("pieces", PIECES_SQL),
)
def _(t: Tables):
    return rounded(we.nearest_stations(segments(t), t.stations), "station_distance_m")


@query(
    "asof_weather",
    """select session_file, visit_index, a.station, w.timestamp as weather_at, w.temperature_c
       from visits v left join assigned a using (segment_id) left join lateral (
         select * from weather_hourly w
         where w.station = a.station and abs(date_diff('microsecond', w.timestamp, v.entered_at)) <= 2400000000
         order by abs(date_diff('microsecond', w.timestamp, v.entered_at)), w.timestamp limit 1) w on true""",
    *VISIT_TABLES,
    *STATION_TABLES,
)
def _(t: Tables):
    assigned = we.nearest_stations(segment_places(t), t.stations)
    return we.join_weather(visits(t), t.weather_hourly, assigned=assigned).select(
        *VISIT_KEY, "station", F.col("timestamp").alias("weather_at"), "temperature_c"
    )


# --- visit features --------------------------------------------------------------------


@query(
    "prior_visits",
    """select session_file, visit_index, cast(row_number() over (partition by segment_id
              order by entered_at, session_file, visit_index) - 1 as bigint) as segment_prior_visits from visits""",
    *VISIT_TABLES,
)
def _(t: Tables):
    return ft.prior_visits(visits(t), measure=t.point_rows.select("segment_id")).select(
        *VISIT_KEY, "segment_prior_visits"
    )


@query(
    "slope_relief",
    """select session_file, visit_index, round(elevation_m - before, 6) as elevation_delta_m,
              round(degrees(atan2(greatest(-20.0, least(20.0, elevation_m - before)), 10.0)) + 0 * before, 6) as slope_observed_deg,
              round(elevation_m - case when n >= 3 then med end, 6) as local_relief_proxy_m
       from (select *, lag(elevation_m) over s as before, count(elevation_m) over f as n, median(elevation_m) over f as med from visits
             window s as (partition by session_file order by entered_at, visit_index),
                    f as (partition by session_file order by entered_at, visit_index rows between 5 preceding and 5 following))""",
    *VISIT_TABLES,
)
def _(t: Tables):
    out = ft.slope_relief(visits(t), measure=t.point_rows.select("session_file")).select(
        *VISIT_KEY, "elevation_delta_m", "slope_observed_deg", "local_relief_proxy_m"
    )
    return rounded(out, "elevation_delta_m", "slope_observed_deg", "local_relief_proxy_m")


CONTEXT_CLASSES = ("stream", "coast", "forest", "farmland", "residential")


def context_lines(t: Tables):
    """Points, lines and rings of the context table as rows of lines."""
    x, y, w, h = (F.col(c) for c in ("cx", "cy", "half_w", "half_h"))

    def at(dx, dy):
        return F.struct((x + dx).alias("x"), (y + dy).alias("y"))

    def ring(share: float):
        corners = ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
        return F.array(*[at(i * w * share, j * h * share) for i, j in corners])

    area = F.when(w.isNotNull(), F.col("feature_id"))
    lines = (
        F.when(w.isNotNull() & F.col("has_hole"), F.array(ring(1.0), ring(0.5)))
        .when(w.isNotNull(), F.array(ring(1.0)))
        .when(F.col("context_class") == "stream", F.array(F.array(at(F.lit(0.0), F.lit(0.0)), at(F.lit(120.0), F.lit(-60.0)))))
        .otherwise(F.array(F.array(at(F.lit(0.0), F.lit(0.0)))))
    )
    return t.context.select("feature_id", "context_class", area.alias("area_id"), F.explode(lines).alias("line"))


CONTEXT_EDGES_SQL = """
select feature_id, context_class, false as area, cx as x0, cy as y0,
       case when context_class = 'stream' then cx + 120.0 else cx end as x1, case when context_class = 'stream' then cy - 60.0 else cy end as y1
from context where half_w is null
union all
select feature_id, context_class, true, cx + i0 * half_w * share, cy + j0 * half_h * share, cx + i1 * half_w * share, cy + j1 * half_h * share
from context, (values (-1, -1, 1, -1), (1, -1, 1, 1), (1, 1, -1, 1), (-1, 1, -1, -1)) as e(i0, j0, i1, j1), (values (1.0::double), (0.5::double)) as s(share)
where half_w is not null and (share = 1.0 or has_hole)"""


@query(
    "nearest_context",
    "select segment_id, "
    + ", ".join(f"round(min(d) filter (where context_class = '{c}'), 5) as {c}_distance_m" for c in CONTEXT_CLASSES)
    + f""" from (select segment_id, context_class, feature_id, case when sum(crossed) % 2 = 1 then 0.0 else min({EDGE_DISTANCE}) end as d
                from (select *, {ALONG} as t,
                             case when area and (y0 > py) <> (y1 > py) and px < (x1 - x0) * (py - y0) / (y1 - y0) + x0 then 1 else 0 end as crossed
                      from (select segment_id, (sx + ex) / 2 as px, (sy + ey) / 2 as py from pieces) p, context_edges)
                group by all) group by 1""".replace("group by all", "group by segment_id, context_class, feature_id"),
    ("pieces", PIECES_SQL),
    ("context_edges", CONTEXT_EDGES_SQL),
)
def _(t: Tables):
    out = ft.nearest_context(segments(t), context_lines(t), classes=CONTEXT_CLASSES)
    return rounded(out, *[f"{c}_distance_m" for c in CONTEXT_CLASSES], digits=5)


@query(
    "context_areas",
    """select segment_id, context_class, feature_id from (
         select segment_id, context_class, feature_id,
                sum(case when (y0 > py) <> (y1 > py) and px < (x1 - x0) * (py - y0) / (y1 - y0) + x0 then 1 else 0 end) as n
         from (select segment_id, (sx + ex) / 2 as px, (sy + ey) / 2 as py from pieces) p, (select * from context_edges where area) group by 1, 2, 3)
       where n % 2 = 1""",
    ("pieces", PIECES_SQL),
    ("context_edges", CONTEXT_EDGES_SQL),
)
def _(t: Tables):
    rings = edge_rows(context_lines(t).where("area_id is not null"))
    places = stored(segments(t).select("segment_id", "segment_x_m", "segment_y_m"))
    found = inside_areas(places, rings, point_id=["segment_id"], area_id=["context_class", "area_id"], point_xy=("segment_x_m", "segment_y_m"))
    return found.withColumnRenamed("area_id", "feature_id")


# Every species; windows and distances are wider than in the field, as the given events are sparse.
BIO = BIO_SPECIES
BIO_WINDOWS = (30, 60, 120, 360)
BIO_DISTANCES = (100.0, 250.0, 500.0, 1000.0)
BIO_NAMES = ", ".join(f"'{s}'" for s in BIO)

# Every matched point counts as a visit of its own place here.
PLACED_SQL = """
select event_id as visit_id, timestamp as entered_at, x_m as segment_x_m, y_m as segment_y_m
from point_rows where segment_id is not null"""


def placed_visits(t: Tables):
    return t.point_rows.where("segment_id is not null").select(
        F.col("event_id").alias("visit_id"),
        F.col("timestamp").alias("entered_at"),
        F.col("x_m").alias("segment_x_m"),
        F.col("y_m").alias("segment_y_m"),
    )


def bio_sql() -> str:
    columns = []
    for s in BIO:
        for m in BIO_WINDOWS:
            hit = f"species = '{s}' and age <= {m * 60}"
            for d in BIO_DISTANCES:
                columns.append(
                    f"cast(coalesce(sum(individual_count) filter (where {hit} and d <= {d}), 0) as bigint) as \"bio_{s}_{m}m_{int(d)}m_count\""
                )
            columns.append(
                f"cast(coalesce(sum(individual_count) filter (where {hit} and d <= {max(BIO_DISTANCES)}), 0) as bigint) as \"bio_{s}_{m}m\""
            )
            columns.append(f"round(min(d) filter (where {hit}), 5) as \"bio_{s}_{m}m_nearest_m\"")
    return f"""
select visit_id, {', '.join(columns)} from (
  select v.visit_id, e.species, e.individual_count, date_diff('microsecond', e.timestamp, v.entered_at) / 1e6 as age,
         sqrt((e.x_m - segment_x_m) * (e.x_m - segment_x_m) + (e.y_m - segment_y_m) * (e.y_m - segment_y_m)) as d
  from placed v left join (select * from field_events where x_m is not null and species in ({BIO_NAMES})) e
    on e.timestamp between v.entered_at - interval '360' minute and v.entered_at) group by visit_id"""


@query("bio_counts", bio_sql(), ("placed", PLACED_SQL))
def _(t: Tables):
    out = ft.bio_counts(
        placed_visits(t),
        t.field_events,
        visit_id=["visit_id"],
        species=BIO,
        windows_min=BIO_WINDOWS,
        distances_m=BIO_DISTANCES,
    ).drop("entered_at", "segment_x_m", "segment_y_m")
    return rounded(out, *[c for c in out.columns if c.endswith("_nearest_m")], digits=5)


@query(
    "bio_counts_time",
    "select visit_id, "
    + ", ".join(
        f"cast(coalesce(sum(individual_count) filter (where species = '{s}' and age <= {m * 60}), 0) as bigint) as \"bio_{s}_{m}m\""
        for s in BIO
        for m in BIO_WINDOWS
    )
    + """ from (select visit_id, species, individual_count, date_diff('microsecond', timestamp, entered_at) / 1e6 as age
                from placed left join field_events e on e.timestamp between entered_at - interval '360' minute and entered_at) group by 1""",
    ("placed", PLACED_SQL),
)
def _(t: Tables):
    return ft.bio_counts_time(
        placed_visits(t).select("visit_id", "entered_at"),
        t.field_events,
        visit_id=["visit_id"],
        species=BIO,
        windows_min=BIO_WINDOWS,
    ).drop("entered_at")
