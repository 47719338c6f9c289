"""Writers: columnar tables by night, GeoJSON layers with one feature per line, JSON summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import inverse_stages, on_vertices
from ..functions.timeops import night_key
from ..params import DEFAULTS, Params


#: Rows of one written file, about.
FILE_ROWS = 1_000_000


def write_table(
    df: DataFrame,
    path: str,
    night_of: str | None = None,
    fmt: str = "parquet",
    *,
    order: list[str] | None = None,
    file_rows: int = FILE_ROWS,
) -> None:
    """Writes a table in files of about `file_rows` rows, partitioned by night when a time column is named.

    Rows are range-partitioned by (night, order), so a busy night is shared among tasks and quiet nights
    share one; a night has as many files as its rows ask for, not one per task. With `order` the rows of a
    night, or of the whole table, stand in that order by file name and place in the file.
    """
    order = order or []
    nightly = df if night_of is None else df.withColumn("night", night_key(F.col(night_of)))
    keys = ([] if night_of is None else ["night"]) + order
    if keys:
        parts = max(1, -(-nightly.count() // file_rows))
        # without an order the time itself cuts a busy night
        cuts = keys if order else [*keys, night_of]
        nightly = nightly.repartitionByRange(parts, *cuts).sortWithinPartitions(*cuts)
    writer = _writer(nightly, fmt).option("maxRecordsPerFile", 2 * file_rows)
    (writer if night_of is None else writer.partitionBy("night")).save(path)


def _writer(df: DataFrame, fmt: str):
    writer = df.write.mode("overwrite").format(fmt)
    return writer.option("header", True) if fmt == "csv" else writer


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def line_geometry(line: Column) -> Column:
    """Geometry of a line whose vertices are already degrees (x east, y north)."""
    return F.struct(
        F.lit("LineString").alias("type"),
        F.transform(line, lambda v: F.array(v["x"], v["y"])).alias("coordinates"),
    )


def plane_line_geometry(line: str, p: Params = DEFAULTS) -> Column:
    """Geometry of a line in plane metres, turned back into degrees."""
    degrees = F.expr(f"transform({on_vertices(line, inverse_stages(p))}, d -> array(d.lon, d.lat))")
    return F.struct(F.lit("LineString").alias("type"), degrees.alias("coordinates"))


def geojson_features(df: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row, in column `value`."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        geometry.alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return df.select(F.to_json(feature).alias("value"))


def event_layer(events: DataFrame, cutoff: Column, species: str) -> DataFrame:
    """Located events with the flags the map shows."""
    located = events.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return located.withColumns(
        {
            "is_holdout": F.when(F.col("timestamp") >= cutoff, 1).otherwise(0),
            "is_large_target": F.when(
                (F.col("species") == species) & (F.col("size") == "大"), 1
            ).otherwise(0),
        }
    )


def segment_layer(segments: DataFrame, risk: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Every segment with its passages, captures and risk, one GeoJSON feature per row."""
    placed = segments.select("segment_id", "line").join(risk, "segment_id")
    properties = ["segment_id", "visits", "captures", "individuals", "risk", "unvisited"]
    return geojson_features(placed, plane_line_geometry("line", p), properties)


#: Order of the rows of `route_text`.
ROUTE_ORDER = ["part", "session_file", "seq"]


def route_text(points: DataFrame) -> DataFrame:
    """The route layer as the lines of one GeoJSON document, a line per vertex: `value`, ordered by `ROUTE_ORDER`.

    A session of any length stays spread over rows: its first vertex carries the head of the feature and
    its last the end, so no route is ever one row or one task. Points without a position are left out, as are
    sessions with fewer than two; `seq` is unique in a session. Degrees have seven decimals.
    """
    placed = points.where("lon is not null and lat is not null and seq is not null").select(
        "session_file", "seq", F.format_string("[%.7f,%.7f]", "lon", "lat").alias("place")
    )
    ends = placed.groupBy("session_file").agg(F.min("seq").alias("_first"), F.max("seq").alias("_last"))
    ends = ends.where("_first < _last")
    first_session = ends.agg(F.min("session_file")).scalar()
    name = F.to_json(F.struct("session_file"))
    head = F.concat(
        F.when(F.col("session_file") == first_session, "").otherwise(","),
        F.lit('{"type":"Feature","properties":'),
        name,
        F.lit(',"geometry":{"type":"LineString","coordinates":['),
    )
    value = F.concat(
        F.when(F.col("seq") == F.col("_first"), head).otherwise(""),
        "place",
        F.when(F.col("seq") == F.col("_last"), "]}}").otherwise(","),
    )
    vertices = placed.join(ends, "session_file").select(F.lit(1).alias("part"), "session_file", "seq", value.alias("value"))
    frame = points.sparkSession.createDataFrame(
        [(0, '{"type":"FeatureCollection","features":['), (2, "]}")], "part int, value string"
    ).select("part", F.lit("").alias("session_file"), F.lit(0).cast(points.schema["seq"].dataType).alias("seq"), "value")
    return vertices.unionByName(frame)


def write_text(df: DataFrame, path: str, order: list[str], file_rows: int = FILE_ROWS) -> None:
    """Writes `value` in the stated order; the files, joined by name, are the document."""
    parts = max(1, -(-df.count() // file_rows))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.select("value").write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
