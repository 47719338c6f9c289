"""Polylines as `array<struct<x:double,y:double>>` in metres, and distances to them.

Ten-metre pieces nearly always have two vertices. Each function answers that case with plain
arithmetic, which stays in generated code; array lambdas run only for lines with bends.

Arguments are SQL expressions (usually column names) and results are SQL text: one parse is far
cheaper to build than hundreds of column objects. Wrap them with `F.expr`.
"""

from __future__ import annotations

import itertools

LINE_TYPE = "array<struct<x:double,y:double>>"
_names = itertools.count()


def _fresh() -> str:
    """Lambda variable that no surrounding lambda uses."""
    return f"v{next(_names)}"


def vertex(x: str, y: str) -> str:
    return f"named_struct('x', cast({x} as double), 'y', cast({y} as double))"


def straight(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"array({vertex(x0, y0)}, {vertex(x1, y1)})"


def by_shape(line: str, two_vertices: str, otherwise: str) -> str:
    return f"(case when size({line}) = 2 then {two_vertices} else {otherwise} end)"


def edges(line: str) -> str:
    """Consecutive vertex pairs."""
    count = f"greatest(size({line}) - 1, 0)"
    return (
        f"zip_with(slice({line}, 1, {count}), slice({line}, 2, {count}),"
        " (a, b) -> named_struct('a', a, 'b', b))"
    )


def gap(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"sqrt(({x1} - {x0}) * ({x1} - {x0}) + ({y1} - {y0}) * ({y1} - {y0}))"


def _edge_gap(e: str) -> str:
    return gap(f"{e}.a.x", f"{e}.a.y", f"{e}.b.x", f"{e}.b.y")


def length(line: str) -> str:
    total, e = _fresh(), _fresh()
    walked = f"aggregate({edges(line)}, 0D, ({total}, {e}) -> {total} + {_edge_gap(e)})"
    return by_shape(line, gap(f"{line}[0].x", f"{line}[0].y", f"{line}[1].x", f"{line}[1].y"), walked)


def point_to_edge(px: str, py: str, x0: str, y0: str, x1: str, y1: str) -> str:
    squared = f"(({x1} - {x0}) * ({x1} - {x0}) + ({y1} - {y0}) * ({y1} - {y0}))"
    along = f"((({px} - {x0}) * ({x1} - {x0}) + ({py} - {y0}) * ({y1} - {y0})) / nullif({squared}, 0D))"
    t = f"least(1D, greatest(0D, coalesce({along}, 0D)))"
    return gap(px, py, f"({x0} + {t} * ({x1} - {x0}))", f"({y0} + {t} * ({y1} - {y0}))")


def point_to_line(px: str, py: str, line: str) -> str:
    """Distance to the nearest place on the polyline; a lone vertex counts as a point."""
    e = _fresh()
    ends = [f"{line}[0].x", f"{line}[0].y", f"{line}[1].x", f"{line}[1].y"]
    bent = f"array_min(transform({edges(line)}, {e} -> " + point_to_edge(
        px, py, f"{e}.a.x", f"{e}.a.y", f"{e}.b.x", f"{e}.b.y"
    ) + "))"
    return (
        f"(case when size({line}) = 2 then {point_to_edge(px, py, *ends)}"
        f" when size({line}) = 1 then {gap(px, py, *ends[:2])} else {bent} end)"
    )


def hausdorff(a: str, b: str) -> str:
    """Largest distance from a vertex of either line to the other line."""

    def one_way(source: str, target: str) -> str:
        p = _fresh()
        return f"array_max(transform({source}, {p} -> {point_to_line(f'{p}.x', f'{p}.y', target)}))"

    return f"greatest({one_way(a, b)}, {one_way(b, a)})"


def bearing(a: str, b: str) -> str:
    """Direction from one vertex to another in degrees, 0 to 360."""
    return f"pmod(degrees(atan2({b}.x - {a}.x, {b}.y - {a}.y)) + 360D, 360D)"


def line_bearing(line: str) -> str:
    return f"(case when size({line}) >= 2 then {bearing(f'{line}[0]', f'element_at({line}, -1)')} end)"


def curvature(line: str) -> str:
    """Turn between the first half and the second half of the vertex list."""
    middle = f"{line}[cast(size({line}) div 2 as int)]"
    turn = f"abs({bearing(f'{line}[0]', middle)} - {bearing(middle, f'element_at({line}, -1)')})"
    return f"(case when size({line}) < 3 then 0D else least({turn}, 360D - {turn}) end)"


def centroid(line: str) -> tuple[str, str]:
    """Length-weighted middle of the edges; the first vertex when the line has no length."""

    def middle(axis: str) -> str:
        total, e = _fresh(), _fresh()
        weighted = (
            f"aggregate({edges(line)}, 0D, ({total}, {e}) -> {total}"
            f" + ({e}.a.{axis} + {e}.b.{axis}) / 2 * {_edge_gap(e)})"
        )
        along = f"coalesce({weighted} / nullif({length(line)}, 0D), {line}[0].{axis})"
        return by_shape(line, f"({line}[0].{axis} + {line}[1].{axis}) / 2", along)

    return middle("x"), middle("y")


def bounds(line: str) -> dict[str, str]:
    """Bounding box as expressions named `x0, y0, x1, y1`."""

    def side(axis: str, low: bool) -> str:
        v = _fresh()
        pick, fold = ("least", "array_min") if low else ("greatest", "array_max")
        pair = f"{pick}({line}[0].{axis}, {line}[1].{axis})"
        return by_shape(line, pair, f"{fold}(transform({line}, {v} -> {v}.{axis}))")

    return {"x0": side("x", True), "y0": side("y", True), "x1": side("x", False), "y1": side("y", False)}


def measured(line: str) -> str:
    """Vertices with their distance `m` along the line."""
    done, p = _fresh(), _fresh()
    first = f"named_struct('x', {line}[0].x, 'y', {line}[0].y, 'm', 0D)"
    last = f"element_at({done}, -1)"
    step = gap(f"{last}.x", f"{last}.y", f"{p}.x", f"{p}.y")
    walked = (
        f"aggregate(slice({line}, 2, greatest(size({line}) - 1, 0)), array({first}), ({done}, {p}) ->"
        f" concat({done}, array(named_struct('x', {p}.x, 'y', {p}.y, 'm', {last}.m + {step}))))"
    )
    whole = gap(f"{line}[0].x", f"{line}[0].y", f"{line}[1].x", f"{line}[1].y")
    pair = f"array({first}, named_struct('x', {line}[1].x, 'y', {line}[1].y, 'm', {whole}))"
    return by_shape(line, pair, walked)


def cut(vertices: str, start: str, end: str) -> str:
    """Part of a measured line between two distances along it."""

    def place(at: str) -> str:
        v, w = _fresh(), _fresh()
        before = f"element_at(filter({vertices}, {v} -> {v}.m <= {at}), -1)"
        after = f"get(filter({vertices}, {w} -> {w}.m > {at}), 0)"
        share = f"(({at} - {before}.m) / ({after}.m - {before}.m))"

        def axis(c: str) -> str:
            return f"coalesce({before}.{c} + {share} * ({after}.{c} - {before}.{c}), {before}.{c})"

        return f"named_struct('x', {axis('x')}, 'y', {axis('y')})"

    def on_edge(at: str) -> str:
        def axis(c: str) -> str:
            return f"{vertices}[0].{c} + {at} / {vertices}[1].m * ({vertices}[1].{c} - {vertices}[0].{c})"

        return f"named_struct('x', {axis('x')}, 'y', {axis('y')})"

    i, k = _fresh(), _fresh()
    inside = (
        f"transform(filter({vertices}, {i} -> {i}.m > {start} and {i}.m < {end}),"
        f" {k} -> named_struct('x', {k}.x, 'y', {k}.y))"
    )
    return by_shape(
        vertices,
        f"array({on_edge(start)}, {on_edge(end)})",
        f"concat(array({place(start)}), {inside}, array({place(end)}))",
    )
