"""Geodesy as column expressions: short geodesic steps and a transverse Mercator plane.

The step uses the meridian and prime-vertical radii at the middle latitude, which stays
within 1e-7 of the full solution at survey distances. The plane uses Krüger's n-series.
"""

from __future__ import annotations

import math
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params

# Ellipsoid constants (fixed values).
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101


def geodesic_step(lat1: str, lon1: str, lat2: str, lon2: str) -> tuple[Column, Column]:
    """Distance in metres and forward azimuth in degrees (0 to 360) between named columns."""
    e2 = WGS84_F * (2 - WGS84_F)
    middle = f"radians(({lat1} + {lat2}) / 2)"
    d_lat, d_lon = f"radians({lat2} - {lat1})", f"radians({lon2} - {lon1})"
    shrink = f"(1D - {e2!r}D * sin({middle}) * sin({middle}))"
    north = f"({WGS84_A * (1 - e2)!r}D / ({shrink} * sqrt({shrink})) * {d_lat})"
    east = f"({WGS84_A!r}D / sqrt({shrink}) * cos({middle}) * {d_lon})"
    azimuth = f"degrees(atan2({east}, {north}) - {d_lon} * sin({middle}) / 2)"
    return (
        F.expr(f"sqrt({north} * {north} + {east} * {east})"),
        F.expr(f"pmod({azimuth} + 360D, 360D)"),
    )


def angle_difference(a: Column, b: Column) -> Column:
    """Smallest turn between two directions; zero when either is unknown."""
    turn = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.coalesce(F.least(turn, 360 - turn), F.lit(0.0))


def axis_difference(a: Column, b: Column) -> Column:
    """Angle between a direction and a road axis, travel sense ignored."""
    turn = angle_difference(a, b)
    return F.least(turn, F.abs(180 - turn))


def _series(n: float) -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the forward and inverse series coefficients (order 4)."""
    radius = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    inverse = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return radius, forward, inverse


def _origin_northing(p: Params) -> float:
    n = GRS80_F / (2 - GRS80_F)
    radius, forward, _ = _series(n)
    phi = math.radians(p.tm_lat0)
    e = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi = math.atan(t)
    return radius * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(forward)))


# A stage maps named inputs to named SQL expressions over them. Steps are kept apart so that no
# step repeats the expression of another; the series would otherwise grow with every use.
Stage = dict[str, str]


def forward_stages(p: Params = DEFAULTS) -> list[Stage]:
    """`lat, lon` to `x, y` in metres."""
    n = GRS80_F / (2 - GRS80_F)
    radius, forward, _ = _series(n)
    e = 2 * math.sqrt(n) / (1 + n)
    scale, shift = p.tm_k0 * radius, p.tm_k0 * _origin_northing(p)
    sin_phi = "sin(radians({lat}))"
    east = " + ".join(
        f"{a!r}D * cos({2 * j} * {{xi}}) * sinh({2 * j} * {{eta}})" for j, a in enumerate(forward, 1)
    )
    north = " + ".join(
        f"{a!r}D * sin({2 * j} * {{xi}}) * cosh({2 * j} * {{eta}})" for j, a in enumerate(forward, 1)
    )
    return [
        {
            "t": f"sinh(atanh({sin_phi}) - {e!r}D * atanh({e!r}D * {sin_phi}))",
            "d": f"radians({{lon}} - {p.tm_lon0!r}D)",
        },
        {"xi": "atan2({t}, cos({d}))", "eta": "atanh(sin({d}) / sqrt(1D + {t} * {t}))"},
        {
            "x": f"{scale!r}D * ({{eta}} + {east})",
            "y": f"{scale!r}D * ({{xi}} + {north}) - {shift!r}D",
        },
    ]


def inverse_stages(p: Params = DEFAULTS) -> list[Stage]:
    """`x, y` in metres back to `lat, lon` in degrees."""
    n = GRS80_F / (2 - GRS80_F)
    radius, _, inverse = _series(n)
    e2 = GRS80_F * (2 - GRS80_F)
    e = math.sqrt(e2)
    scale, shift = p.tm_k0 * radius, p.tm_k0 * _origin_northing(p)
    back_xi = "".join(
        f" - {b!r}D * sin({2 * j} * {{xi0}}) * cosh({2 * j} * {{eta0}})" for j, b in enumerate(inverse, 1)
    )
    back_eta = "".join(
        f" - {b!r}D * cos({2 * j} * {{xi0}}) * sinh({2 * j} * {{eta0}})" for j, b in enumerate(inverse, 1)
    )
    # Newton's rule brings the conformal latitude back to the geodetic one; two steps suffice.
    tangent = [
        {
            "goal": "{goal}",
            "lon": "{lon}",
            "tau": "{tau}",
            "root": "sqrt(1D + {tau} * {tau})",
            "sigma": f"sinh({e!r}D * atanh({e!r}D * {{tau}} / sqrt(1D + {{tau}} * {{tau}})))",
        },
        {
            "goal": "{goal}",
            "lon": "{lon}",
            "tau": "{tau}",
            "slope": f"(1D + {1 - e2!r}D * {{tau}} * {{tau}}) / ({1 - e2!r}D * {{root}})",
            "guess": "{tau} * sqrt(1D + {sigma} * {sigma}) - {sigma} * {root}",
        },
        {
            "goal": "{goal}",
            "lon": "{lon}",
            "tau": "{tau} + ({goal} - {guess}) / sqrt(1D + {guess} * {guess}) * {slope}",
        },
    ]
    return [
        {"xi0": f"({{y}} + {shift!r}D) / {scale!r}D", "eta0": f"{{x}} / {scale!r}D"},
        {"xi": f"{{xi0}}{back_xi}", "eta": f"{{eta0}}{back_eta}"},
        {
            "goal": "sin({xi}) / sqrt(sinh({eta}) * sinh({eta}) + cos({xi}) * cos({xi}))",
            "lon": f"{p.tm_lon0!r}D + degrees(atan2(sinh({{eta}}), cos({{xi}})))",
        },
        {"goal": "{goal}", "lon": "{lon}", "tau": f"{{goal}} / {1 - e2!r}D"},
        *tangent,
        *tangent,
        {"lat": "degrees(atan({tau}))", "lon": "{lon}"},
    ]


def on_columns(df: DataFrame, stages: list[Stage], inputs: dict[str, str], out: dict[str, str]) -> DataFrame:
    """Run stages as projections over the table; `out` maps result names to column names."""
    held: list[str] = []
    current = inputs
    for i, stage in enumerate(stages):
        named = {f"_p{i}_{k}": F.expr(text.format(**current)) for k, text in stage.items()}
        df = df.withColumns(named)
        held += named
        current = {k: f"_p{i}_{k}" for k in stage}
    return df.withColumns({name: F.col(current[k]) for k, name in out.items()}).drop(*held)


def on_vertices(vertices: str, stages: list[Stage]) -> str:
    """Run stages over an array of structs, as SQL text."""
    for i, stage in enumerate(stages):
        fields = {k: f"g{i}.{k}" for k in _inputs(stage)}
        built = ", ".join(f"'{k}', {text.format(**fields)}" for k, text in stage.items())
        vertices = f"transform({vertices}, g{i} -> named_struct({built}))"
    return vertices


def _inputs(stage: Stage) -> set[str]:
    return {name for text in stage.values() for _, name, _, _ in Formatter().parse(text) if name}


def with_plane(
    df: DataFrame, lat: str = "lat", lon: str = "lon", x: str = "x_m", y: str = "y_m", p: Params = DEFAULTS
) -> DataFrame:
    """Adds plane coordinates; null where there is no position."""
    return on_columns(df, forward_stages(p), {"lat": lat, "lon": lon}, {"x": x, "y": y})


def with_degrees(
    df: DataFrame, x: str, y: str, lat: str = "lat", lon: str = "lon", p: Params = DEFAULTS
) -> DataFrame:
    return on_columns(df, inverse_stages(p), {"x": x, "y": y}, {"lat": lat, "lon": lon})
