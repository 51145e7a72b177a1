"""Planar geometry as SQL expressions (evaluated per row inside codegen).

Only what the jobs need: the even-odd crossing test for point-in-polygon
(with points on an edge excluded), and point-to-segment distance.  All
divisions are ``try_divide`` so ANSI mode never raises on a horizontal or
degenerate edge.
"""

from __future__ import annotations


def _div(a: str, b: str, dialect: str) -> str:
    if dialect == "duckdb":
        return f"(({a}) / nullif({b}, 0))"
    return f"try_divide({a}, {b})"


def crossing_sql(px: str, py: str, e: str, dialect: str = "spark") -> str:
    """True when the ray from (px, py) towards +x crosses edge ``e``.

    ``e`` has fields x1, y1, x2, y2.  Half-open in y, so a vertex shared by
    two edges is counted once.
    """
    return (f"(({e}.y1 > {py}) <> ({e}.y2 > {py})) AND "
            f"({px} < {_div(f'({e}.x2 - {e}.x1) * ({py} - {e}.y1)', f'({e}.y2 - {e}.y1)', dialect)} + {e}.x1)")


def on_edge_sql(px: str, py: str, e: str) -> str:
    """True when (px, py) lies exactly on segment ``e`` (boundary point)."""
    return (f"((({e}.x2 - {e}.x1) * ({py} - {e}.y1) - ({e}.y2 - {e}.y1) * ({px} - {e}.x1)) = 0 "
            f"AND {px} BETWEEN least({e}.x1, {e}.x2) AND greatest({e}.x1, {e}.x2) "
            f"AND {py} BETWEEN least({e}.y1, {e}.y2) AND greatest({e}.y1, {e}.y2))")


def seg_distance_sql(px: str, py: str, s: str, dialect: str = "spark") -> str:
    """Euclidean distance from (px, py) to segment ``s`` (x1, y1, x2, y2).

    A degenerate segment (a point) has a null projection factor, which is
    coalesced to 0 -> distance to its first end point.
    """
    dx = f"({s}.x2 - {s}.x1)"
    dy = f"({s}.y2 - {s}.y1)"
    proj = _div(f"({px} - {s}.x1) * {dx} + ({py} - {s}.y1) * {dy}", f"{dx} * {dx} + {dy} * {dy}", dialect)
    t = f"least(greatest(coalesce({proj}, 0.0), 0.0), 1.0)"
    qx = f"({px} - ({s}.x1 + {t} * {dx}))"
    qy = f"({py} - ({s}.y1 + {t} * {dy}))"
    return f"sqrt({qx} * {qx} + {qy} * {qy})"
