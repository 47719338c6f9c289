"""Survey tables derived from the given parquet tables.

The given tables hold no coordinates or field notes, so each survey table is a deterministic
view over all rows of one of them. The SQL below runs unchanged in Spark and in the checker.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tracks import number_points
from ..session import prepare

_NIGHT_DAY = "cast(ts - interval '7' hour as date)"

VIEWS: dict[str, str] = {
    # one session per user; every moment of the input becomes a track point
    "point_rows": """
select event_id, concat('s', user_id) as session_file, ts as timestamp,
       28.12  + cast((event_id * 7919)   % 1000 as double) / 10000 as lat,
       129.27 + cast((event_id * 104729) % 1000 as double) / 10000 as lon,
       cast((event_id * 7919)   % 120011 as double) / 10 as x_m,
       cast((event_id * 104729) % 120011 as double) / 10 as y_m,
       value as elevation_m,
       case when event_type = 'error' then null else concat('seg_', (event_id * 31) % 3) end as segment_id,
       case when event_type = 'error' then null else cast(event_id % 40 as double) end as match_distance_m
from events""",
    "points": """
select *, cast(row_number() over (partition by session_file order by timestamp, event_id) - 1 as bigint) as seq
from point_rows""",
    "field_events": """
select event_id, ts as timestamp,
       case event_type when 'purchase' then 'capture' when 'view' then 'sighting'
            when 'click' then 'roadkill_sighting' when 'signup' then 'search_start' else 'weather' end as event_type,
       case event_id % 12 when 2 then 'カエル' when 6 then 'オットンガエル' when 10 then 'カエル' when 3 then 'ネズミ'
            when 7 then 'ヤマシギ' when 11 then 'クロウサギ' else case event_id % 4 when 0 then 'ハブ' else 'アカマタ' end end as species,
       event_id % 3 + 1 as individual_count,
       case when event_id % 7 = 0 then null else 28.12  + cast((event_id * 7919)   % 1000 as double) / 10000 end as lat,
       case when event_id % 7 = 0 then null else 129.27 + cast((event_id * 104729) % 1000 as double) / 10000 end as lon,
       case when event_id % 7 = 0 then null else cast((event_id * 7919)   % 120011 as double) / 10 end as x_m,
       case when event_id % 7 = 0 then null else cast((event_id * 104729) % 120011 as double) / 10 end as y_m,
       case when value > 60 then ' Yes ' when value > 40 then 'other' else null end as other_capture,
       concat('place_', user_id) as place,
       concat('seg_', (event_id * 31) % 3) as segment_id,
       props as raw_text
from events""",
    # three stations; the last one reports every third hour only, for all that happened in between
    "weather_hourly": """
select station, cast(hour as timestamp) as timestamp,
       case when count(*) % 5 = 0 then null else cast(count(*) % 4 as double) end as precip_mm,
       cast(count(*) as double) as temperature_c
from (select concat('st', user_id % 3) as station,
             date_trunc('hour', ts) - case when user_id % 3 = 2 then extract(hour from ts) % 3 else 0 end * interval '1' hour as hour
      from events) group by station, hour""",
    "stations": """
select distinct concat('st', s_nationkey % 3) as station,
       cast(500 + s_nationkey % 3 * 3000 as double) as x_m, cast(400 + s_nationkey % 3 * 2000 as double) as y_m
from supplier""",
    "road_lines": """
select concat('P', p_partkey) as way_id,
       cast((p_partkey * 37) % 12007 as double) as x0, cast((p_partkey * 61) % 12007 as double) as y0,
       cast((p_partkey * 37) % 12007 + (p_size % 5) * 30 as double) as x1,
       cast((p_partkey * 61) % 12007 + (p_size % 7) * 40 as double) as y1,
       p_type as highway
from part""",
    # points, lines, and rectangles of which every second one has a hole of half its size
    "context": """
select s_suppkey as feature_id,
       case s_nationkey % 5 when 0 then 'stream' when 1 then 'coast' when 2 then 'forest'
            when 3 then 'farmland' else 'residential' end as context_class,
       cast((s_suppkey * 97) % 12007 as double) as cx, cast((s_suppkey * 193) % 12007 as double) as cy,
       case when s_nationkey % 5 >= 2 then cast(60 + s_suppkey % 9 * 70 as double) end as half_w,
       case when s_nationkey % 5 >= 2 then cast(50 + s_suppkey % 7 * 90 as double) end as half_h,
       s_suppkey % 2 = 0 as has_hole
from supplier""",
    "route_intervals": f"""
select event_id as pair_no, cast({_NIGHT_DAY} as string) as operational_date_0700,
       ts as start_time, ts + (event_id % 15) * interval '1' minute as end_time,
       case when event_type in ('view', 'click') then 'UNIQUE_ROUTE' else 'ALTERNATIVE' end as route_class
from events""",
    "gps_history": """
select event_id, ts as timestamp,
       28.12  + cast((event_id * 7919)   % 1000 as double) / 10000 as lat,
       129.27 + cast((event_id * 104729) % 1000 as double) / 10000 as lon,
       case when value > 70 then null else concat('seg_', (event_id * 31) % 3) end as segment_id,
       cast(event_id % 40 as double) as match_distance_m,
       value < 80 as strict_temporal_route_verified
from events""",
    "population_conflicts": f"""
select distinct cast({_NIGHT_DAY} as string) as operational_date_0700,
       case extract(day from ts - interval '7' hour) % 4 when 0 then 'SOURCE_CONFLICT'
            when 1 then 'DUPLICATE_SUSPECT' when 2 then 'WEAK_EVENT_ONLY' else 'CONFIRMED' end as status,
       extract(day from ts - interval '7' hour) % 3 = 0 as include_by_default,
       'reviewed' as reason, 'registry' as source_evidence
from events""",
    # candidate nights from an outside list: the order dates, none of which has a track
    "imported_nights": """
select distinct cast(cast(o_orderdate as date) as string) as operational_date_0700 from orders""",
    "forecast_snapshots": f"""
select distinct {_NIGHT_DAY} as operational_date,
       cast(extract(day from ts - interval '7' hour) % 5 as bigint) as point_prediction
from events""",
    # note blocks as a field log writes them: a date line, then one fact per line
    "field_notes": """
select event_id, ts as timestamp,
       concat('2024/', cast(extract(month from ts) as string), '/', cast(extract(day from ts) as string), ' ',
              cast(extract(hour from ts) as string), ':', lpad(cast(extract(minute from ts) as string), 2, '0'), chr(10),
              case event_id % 11 when 0 then 'ハブ捕獲大' when 1 then 'ヒメハブ' when 2 then 'アカマタ 2匹'
                   when 3 then '　ネズミ３匹' when 4 then 'オットンガエル' when 5 then 'カエル5匹以上'
                   when 6 then 'ガラスヒヴァ ウェット' when 7 then 'クロウサギ 12匹' when 8 then 'ハブ捕獲中 ドライ'
                   when 9 then 'ハブ 極小 湿り' else props end, chr(10),
              case event_type when 'purchase' then '捕獲' when 'view' then ' 目撃　' when 'click' then '轢死'
                   when 'signup' then 'エリア探索開始' else 'メモ' end, chr(10),
              case when event_id % 7 = 0 then 'no fix' else concat('28.', cast(1000 + event_id % 1000 as string)) end, chr(10),
              case when event_id % 5 = 0 then '28.1129.2' else concat('129.', cast(2000 + event_id % 1000 as string)) end) as raw_text
from events""",
}

_TABLES = (
    "events", "part", "supplier", "orders", "documents", "conversations", "customer",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One survey table over the tables of `sf_dir`."""
    if name in _TABLES:
        return load(spark, sf_dir, name)
    if name == "points":
        return number_points(
            derive(spark, sf_dir, "point_rows"), "session_file", ["timestamp", "event_id"]
        )
    text = VIEWS[name]
    args = {t: load(spark, sf_dir, t) for t in _TABLES if re.search(rf"\b(from|join) {t}\b", text)}
    out = spark.sql(re.sub(r"\b(from|join) (\w+)", _placeholder, text), **args)
    if name == "weather_hourly":
        out = out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return out


def _placeholder(match: re.Match) -> str:
    word, table = match.groups()
    return f"{word} {{{table}}}" if table in _TABLES else match.group(0)


def with_views(sql: str, *extra: tuple[str, str]) -> str:
    """`sql` for the checker, preceded by the views it uses and the extra named queries."""
    parts = list(extra)
    known = {name for name, _ in parts}
    text = sql + " ".join(body for _, body in parts)
    pending = [v for v in VIEWS if re.search(rf"\b{v}\b", text)]
    needed: list[str] = []
    while pending:
        view = pending.pop()
        if view in needed or view in known:
            continue
        needed.append(view)
        pending += [v for v in VIEWS if v != view and re.search(rf"\b{v}\b", VIEWS[view])]
    ctes = [f"{v} as ({VIEWS[v]})" for v in VIEWS if v in needed]
    ctes += [f"{name} as materialized ({body})" for name, body in parts]
    return f"with {', '.join(ctes)}\n{sql}" if ctes else sql
