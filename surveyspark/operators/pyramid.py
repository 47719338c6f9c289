"""Nearest shapes by a pyramid of occupied cells, without a distance limit and without rounds.

Edges are cut into pieces about as long as the finest cell is wide, so every piece belongs to one cell.
A table holds the occupied cells of all levels, each four times as wide as those below, with the tight
box around what lies in it and one place that is truly there. A search walks down from the top: the
boxes bound the distance from below, the places from above, and only cells that may hold the nearest
piece are followed. What is left on the finest level, or in cells of a single piece, is measured exactly.

The levels are a fixed number of joins in one plan, whatever the distances are. A far dense cluster is
entered only at the cells that face the point. Upper levels are small tables, which Spark broadcasts by
their measured size; lower ones are joined by cell, where a busy cell has at most sixteen partners.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.polyline import gap, point_to_edge
from ..session import scratch_folder, shuffled

EDGE = ("ax", "ay", "bx", "by")
#: Distances that differ by less are followed on both sides; the exact step decides.
SLACK = 1e-6
#: Cells beside each other that one cell of the next level covers, as a power of two.
WIDER = 2


@dataclass(frozen=True)
class Pyramid:
    """`pieces` of edges with their finest cell, and the occupied `cells` of every level."""

    pieces: DataFrame
    cells: DataFrame
    keys: tuple[str, ...]
    shape_id: str
    top: int
    timed: bool

    def level(self, number: int) -> DataFrame:
        return self.cells.where(F.col("level") == number).drop("level")


def build(shapes: DataFrame, *, shape_id: str, keys: list[str] | None = None, moment: str | None = None) -> Pyramid | None:
    """The pyramid of edge rows (`ax, ay, bx, by`), one for each value of `keys`; None without edges.

    With `moment`, a whole number per edge, searches may ask for edges between two moments.
    """
    keys = list(keys or [])
    wide = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    found = shapes.agg(
        F.count("ax").alias("n"),
        F.avg(wide).alias("mean"),
        *[F.min(F.least(f"a{c}", f"b{c}")).alias(f"low_{c}") for c in "xy"],
        *[F.max(F.greatest(f"a{c}", f"b{c}")).alias(f"high_{c}") for c in "xy"],
    ).first()
    if not found["n"]:
        return None
    span = max(found["high_x"] - found["low_x"], found["high_y"] - found["low_y"]) + 1.0
    # twice the mean extent keeps the pieces below one and a half times the edges
    finest = max(2 * found["mean"], span / (16 * math.sqrt(found["n"])))
    top = max(0, math.ceil(math.log(span / finest, 1 << WIDER) + 1e-9))
    parts = shapes.where("ax is not null").withColumn("_n", F.greatest(F.lit(1), F.ceil(wide / F.lit(finest))).cast("int"))
    parts = parts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def along(axis: str, step: str) -> str:
        return f"(a{axis} + (_k + {step}) / _n * (b{axis} - a{axis}))"

    cell = {f"c{c}": F.floor((F.expr(along(c, "0.5D")) - F.lit(found[f"low_{c}"])) / F.lit(finest)).cast("bigint") for c in "xy"}
    pieces = parts.withColumns(cell)
    places = "named_struct('x', {}, 'y', {})".format(along("x", "0.5D"), along("y", "0.5D"))
    boxed = pieces.withColumns(
        {f"_{c}0": F.expr(f"least({along(c, '0D')}, {along(c, '1D')})") for c in "xy"}
        | {f"_{c}1": F.expr(f"greatest({along(c, '0D')}, {along(c, '1D')})") for c in "xy"}
        | {"_place": F.expr(places), "level": F.explode(F.sequence(F.lit(0), F.lit(top)))}
    )
    up = [F.expr(f"shiftright(c{c}, {WIDER} * level)").alias(f"c{c}") for c in "xy"]
    seen = [F.min("_place").alias("place")]
    if moment is not None:
        dated = F.struct(F.col(moment).alias("at"), F.col("_place").alias("place"))
        seen = [F.min(dated).alias("first"), F.max(dated).alias("last")]
    cells = boxed.groupBy("level", *keys, *up).agg(
        *[F.min(f"_{c}0").alias(f"{c}0") for c in "xy"],
        *[F.max(f"_{c}1").alias(f"{c}1") for c in "xy"],
        *seen,
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(*EDGE, shape_id, *([moment] if moment else []))).alias("edge"),
    )
    spark = shapes.sparkSession
    path = f"{scratch_folder(spark)}/cells-{uuid.uuid4().hex}"
    cells.write.partitionBy("level").parquet(path)
    kept = spark.read.schema(cells.schema).parquet(path)
    held = pieces.select(*keys, "cx", "cy", *EDGE, shape_id, *([F.col(moment).alias("_at")] if moment else []))
    return Pyramid(held, kept, tuple(keys), shape_id, top, moment is not None)


def nearest(
    points: DataFrame,
    pyramid: Pyramid,
    *,
    point_id: list[str],
    point_xy: tuple[str, str],
    given: list[str] | None = None,
    between: tuple[str, str] | None = None,
) -> DataFrame:
    """The nearest edge of each `point_id` and each key: `keys, point_id, shape_id, distance_m`.

    `given` are the keys that points bring (all by default); for the others every value is searched.
    `between` names two columns of points: only edges with a moment from the first to the second count.
    Such a search may ask in several rows, with different keys given; keys that are given then do not
    part the answers. An ask must not begin and end inside one value of a given key that also holds
    moments before and after it.
    """
    keys = list(pyramid.keys)
    given = keys if given is None else given
    parted = [k for k in keys if k not in given] if between else keys
    x, y = "_px", "_py"
    ends = ["_lo", "_hi"] if between else []
    limits = [F.col(c).alias(n) for c, n in zip(between or (), ends)]
    own = [*point_id, x, y, *ends]
    box = "sqrt(pow(greatest(x0 - {0}, {0} - x1, 0D), 2) + pow(greatest(y0 - {1}, {1} - y1, 0D), 2))".format(x, y)
    exact = point_to_edge(x, y, *[f"edge.{c}" for c in EDGE])
    reach = gap(x, y, "place.x", "place.y")
    if between:
        seen = [
            f"case when {side}.at between _lo and _hi then {gap(x, y, f'{side}.place.x', f'{side}.place.y')} end"
            for side in ("first", "last")
        ]
        reach = f"least({seen[0]}, {seen[1]})"
    shape = pyramid.shape_id
    far = f"case when n = 1 and {reach} is not null then {exact} else {reach} end"
    # rows that are measured already look for a cell that no grid has, spread over the tasks
    spread = F.shiftright(F.xxhash64(*point_id), 33) - (1 << 31)
    kind = f"struct<distance_m:double,{shape}:{pyramid.pieces.schema[shape].dataType.simpleString()}>"

    placed = points.where(F.col(point_xy[0]).isNotNull() & F.col(point_xy[1]).isNotNull())
    placed = placed.select(*given, *point_id, F.col(point_xy[0]).alias(x), F.col(point_xy[1]).alias(y), *limits)
    # the one cell of the top level; a place outside the grid starts at its rim
    start = {f"_u{c}": F.least(F.lit(0), F.greatest(F.lit(0), F.floor(F.col(f"_p{c}")))).cast("bigint") for c in "xy"}
    frontier = placed.withColumns(start | {"_far": F.lit(None).cast("double"), "_found": F.lit(None).cast(kind)})
    on = given
    group = Window.partitionBy(*parted, *point_id)
    for number in range(pyramid.top - 1, -1, -1):
        below = pyramid.level(number).withColumns({f"_u{c}": F.shiftright(f"c{c}", WIDER) for c in "xy"})
        met = frontier.join(below, [*on, "_ux", "_uy"], "left").withColumn("_far", F.coalesce("_far", F.expr(far)))
        # the window below ends the expressions here, so no level repeats those of another
        met = met.withColumn("_bound", F.min("_far").over(group))
        near = F.when(F.col("_found").isNotNull() | (F.col("n") == 1), F.col("_far")).otherwise(F.expr(box))
        met = met.where(near <= F.col("_bound") + SLACK)
        one = F.when(F.col("n") == 1, F.struct(F.col("_far").alias("distance_m"), F.col(f"edge.{shape}").alias(shape)).cast(kind))
        frontier = met.withColumn("_found", F.coalesce("_found", one)).select(
            *keys,
            *own,
            F.when(F.col("_found").isNull(), F.col("cx")).otherwise(spread).alias("_ux"),
            F.when(F.col("_found").isNull(), F.col("cy")).otherwise(spread).alias("_uy"),
            F.when(F.col("_found").isNotNull(), F.col("_far")).alias("_far"),
            "_found",
        )
        on = keys
    left = pyramid.pieces.withColumnsRenamed({"cx": "_ux", "cy": "_uy"})
    met = frontier.join(shuffled(left), [*on, "_ux", "_uy"], "left")
    counts = F.col(shape).isNotNull()
    if between:
        counts = counts & F.col("_at").between(F.col("_lo"), F.col("_hi"))
    exactly = F.struct(F.expr(point_to_edge(x, y, *EDGE)).alias("distance_m"), F.col(shape)).cast(kind)
    best = F.min(F.coalesce("_found", F.when(counts, exactly)))
    out = met.groupBy(*parted, *point_id).agg(best.alias("_found")).where("_found is not null")
    return out.select(*parted, *point_id, f"_found.{shape}", "_found.distance_m")
