"""Spatial joins without a geometry library (J9, J10, S8 edges).

Both joins keep the big side (points) streaming and never shuffle it:

* the shapes are cut up by a key — polygon edges by horizontal band (the
  crossing test casts a horizontal ray), line segments by grid cell — and
  each key gets one row holding the array of shapes that touch it;
* that table is broadcast (its size is checked first: it depends on the
  map, not on the data), points find their grid row by an equi-join, and
  the exact test (even-odd crossing count / point-segment distance) runs as
  higher-order SQL functions on that array, inside codegen.

A map with many edges gets a cover (``polygon_cover``): cells that no edge
touches lie wholly inside or outside, so their points need one look-up and no
test; cells that edges touch are cut finer once, and only points in fine cells
that edges touch are tested against their band's edges.

A hot grid cell (a third of all points in one place) is harmless: there is
no shuffle on the point side, only map-side lookups.  If the shape table is
over the broadcast bound the same plan runs as a shuffled equi-join on the
grid key, where AQE's skew handling splits a hot cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..session import cut_lineage

# the shape table is broadcast only below this many (key, shape) entries
MAX_BROADCAST_SHAPE_ROWS = 2_000_000


def polygon_edges(polys: DataFrame, rings_col: str = "rings") -> DataFrame:
    """(pos, label, rings array<array<array<double>>>) -> one row per edge.

    All rings of a feature (outer ring, holes, parts of a multipolygon) keep
    the feature's ``pos``; the even-odd test over all of them is exact.
    Edges come from zipping each ring with itself shifted by one (no join).
    """
    r = polys.select("pos", "label", F.explode(rings_col).alias("ring"))
    n = F.size("ring") - 1
    pairs = F.arrays_zip(F.slice("ring", 1, n).alias("a"), F.slice("ring", 2, n).alias("b"))
    e = r.select("pos", "label", F.explode(pairs).alias("e"))
    return e.select("pos", "label", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"),
                    F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"))


def _fits(entries: int) -> bool:
    """Whether the keyed shape table is small enough to be broadcast."""
    return entries <= MAX_BROADCAST_SHAPE_ROWS


def _probe(key: Column, only: Column | None, small: bool) -> Column:
    """The key that a point is looked up by; null, which meets nothing, where
    ``only`` does not hold.  In a shuffled join, points without a key get one
    out of range by their row number, so that they do not all meet in one
    task; no other column is read for it."""
    key = key if only is None else F.when(only, key)
    if small:
        return key
    return F.coalesce(key, F.lit(-(1 << 60)) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)))


TARGET_CELLS = 2048       # auto sizing: bands / cells across the map's extent


def _plan_keys(shapes: DataFrame, axes: list[tuple[str, str]], size: float | None,
               grow: float = 0.0, minimum: float = 0.0) -> tuple[float, int]:
    """Key size and a bound of the number of (key, shape) entries: one
    aggregate for the extent, one for the count.

    ``axes`` are (low column, high column) pairs per dimension (one for
    bands, two for grid cells); each shape spans
    ``floor((hi + grow) / size) - floor((lo - grow) / size) + 1`` keys per
    axis.  Without ``size`` it is the largest axis extent / TARGET_CELLS
    (never below ``minimum``), so a real map's band holds a few hundred
    edges.
    """
    if size is None:
        exts = shapes.agg(*[(F.max(F.greatest(lo, hi)) - F.min(F.least(lo, hi))).alias(f"e{i}")
                            for i, (lo, hi) in enumerate(axes)]).first()
        if exts[0] is None:
            return max(minimum, 1.0), 0
        size = max(max(exts) / TARGET_CELLS, minimum, 1e-9)
    size = float(size)
    span = None
    for lo, hi in axes:
        n = (F.floor((F.greatest(lo, hi) + F.lit(float(grow))) / F.lit(size))
             - F.floor((F.least(lo, hi) - F.lit(float(grow))) / F.lit(size)) + F.lit(1))
        span = n if span is None else span * n
    # a long segment is cut into pieces of about a cell, so its entries follow
    # its length: as many pieces, each in a few cells
    if len(axes) == 2:
        side = F.greatest(*[F.abs(F.col(hi) - F.col(lo)) for lo, hi in axes])
        span = F.least(span, F.ceil(side / F.lit(size) + F.lit(1)) * F.lit((2 + math.ceil(2 * grow / size)) ** 2))
    return size, int(shapes.agg(F.sum(span)).first()[0] or 0)


def _bands(edges: DataFrame, band: float) -> DataFrame:
    """Edge replicated into every horizontal band its y-range touches."""
    lo = F.floor(F.least("y1", "y2") / F.lit(band)).cast("long")
    hi = F.floor(F.greatest("y1", "y2") / F.lit(band)).cast("long")
    return (edges.withColumn("band", F.explode(F.sequence(lo, hi)))
                 .groupBy("band")
                 .agg(F.collect_list(F.struct("pos", "label", "x1", "y1", "x2", "y2"))
                      .alias("edges")))


#: From this many (band, edge) entries on a map gets a cover; its cells along
#: the longer axis, and the bits by which touched cells are cut finer.
COVER_ENTRIES, COVER_CELLS, COVER_BITS = 16_384, 256, 3


def _touched(edges: DataFrame, size: float) -> DataFrame:
    """Cells (fx, fy) that an edge touches or nearly so: it is cut into pieces
    of about a cell, each with the cells of its box."""
    slack = size * 1e-6
    cells = _boxes(edges.select("x1", "y1", "x2", "y2"), size, slack)
    return cells.select(F.col("cx").alias("fx"), F.col("cy").alias("fy")).distinct()


def polygon_cover(edges: DataFrame, size: float) -> DataFrame:
    """(cx, cy, labels, border): cells of ``size`` in which points lie in a
    polygon or near an edge.  A cell that no edge touches has one entry: the
    first polygon around it.  Another has one for each of its fine cells, by
    row, then column: whether an edge touches it, else its first polygon or
    null.  A cell that is not listed lies in no polygon.  Its rows follow the
    map."""
    fine, side = size / (1 << COVER_BITS), 1 << COVER_BITS
    at = edges.agg(*[f(g(*c)).alias(n) for n, f, g, c in (("x0", F.min, F.least, ("x1", "x2")), ("x1", F.max, F.greatest, ("x1", "x2")),
                                                          ("y0", F.min, F.least, ("y1", "y2")), ("y1", F.max, F.greatest, ("y1", "y2")))])
    cell = lambda c: F.floor(F.col(c) / F.lit(size)).cast("long")
    every = (at.where("x0 is not null").select(F.explode(F.sequence(cell("x0"), cell("x1"))).alias("cx"), cell("y0").alias("a"), cell("y1").alias("b"))
             .select("cx", F.explode(F.sequence("a", "b")).alias("cy")))
    touched = cut_lineage(_touched(edges, fine))
    coarse = touched.select(F.shiftright("fx", COVER_BITS).alias("cx"), F.shiftright("fy", COVER_BITS).alias("cy")).distinct()
    centre = lambda c, s: ((F.col(c) + F.lit(0.5)) * F.lit(s))
    whole = every.join(coarse, ["cx", "cy"], "left_anti").withColumns({"x": centre("cx", size), "y": centre("cy", size)})
    inside = (point_in_polygon(whole, edges, out="label", cover=False).where("label is not null")
              .select("cx", "cy", F.array("label").alias("labels"), F.array(F.lit(False)).alias("border")))
    parts = coarse.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))).withColumns({
        "fx": F.col("cx") * side + F.col("i") % side, "fy": F.col("cy") * side + F.floor(F.col("i") / side)})
    parts = parts.join(touched.withColumn("border", F.lit(True)), ["fx", "fy"], "left").withColumns(
        {"border": F.coalesce("border", F.lit(False)), "x": centre("fx", fine), "y": centre("fy", fine)})
    told = point_in_polygon(parts, edges, out="label", cover=False, only=~F.col("border"))
    rows = (told.groupBy("cx", "cy").agg(F.sort_array(F.collect_list(F.struct("i", "label", "border"))).alias("a"))
            .select("cx", "cy", F.col("a.label").alias("labels"), F.col("a.border").alias("border")))
    return inside.unionByName(rows)


def _covered(points: DataFrame, edges: DataFrame, x: str, y: str, only: Column | None) -> DataFrame:
    """The points with ``_inside`` (a label, or null) and ``_border`` (whether
    the exact test has to tell)."""
    size, _ = _plan_keys(edges, [("x1", "x2"), ("y1", "y2")], None)
    size *= TARGET_CELLS / COVER_CELLS
    cover = cut_lineage(polygon_cover(edges, size))
    small = _fits(cover.count() << (2 * COVER_BITS))
    fine = size / (1 << COVER_BITS)
    pts = points.withColumns({"_fx": F.floor(F.col(x) / F.lit(fine)).cast("long"), "_fy": F.floor(F.col(y) / F.lit(fine)).cast("long")})
    pts = pts.withColumns({"_cx": _probe(F.shiftright("_fx", COVER_BITS), only, small), "_cy": _probe(F.shiftright("_fy", COVER_BITS), only, small)})
    side = (1 << COVER_BITS) - 1
    j = pts.join(F.broadcast(cover) if small else cover, (pts["_cx"] == cover["cx"]) & (pts["_cy"] == cover["cy"]), "left")
    i = F.when(F.size("labels") == 1, 0).otherwise(
        F.shiftleft(F.col("_fy").bitwiseAND(side), COVER_BITS) + F.col("_fx").bitwiseAND(side)).cast("int")
    return (j.withColumns({"_inside": F.get("labels", i), "_border": F.coalesce(F.get("border", i), F.lit(False))})
             .drop("_fx", "_fy", "_cx", "_cy", "cx", "cy", "labels", "border"))


def cover_report(points: DataFrame, edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: points, points that the cover leaves to the exact test, and the
    edges tested per point with the cover and without."""
    band, _ = _plan_keys(edges, [("y1", "y2")], None)
    n = _bands(edges, band).select("band", F.size("edges").alias("n"))
    p = _covered(points, edges, x, y, None).withColumn("band", F.floor(F.col(y) / F.lit(band)).cast("long"))
    n_of = F.coalesce(F.col("n"), F.lit(0))
    return p.join(n, "band", "left").agg(
        F.count(F.lit(1)).alias("n_points"), F.sum(F.col("_border").cast("long")).alias("n_tested"),
        F.avg(F.when(F.col("_border"), n_of).otherwise(0)).alias("edges_with_cover"), F.avg(n_of).alias("edges_without"))


def point_in_polygon(points: DataFrame, edges: DataFrame, x: str = "x", y: str = "y",
                     band: float | None = None, out: str = "polygon_label",
                     default: str | None = None, only=None, cover: bool | None = None) -> DataFrame:
    """Label of the first polygon (by ``pos``) that strictly contains each point.

    Points on an edge are outside (boundary excluded); points in no polygon
    get ``default``.  Every input row is kept exactly once.  ``only`` (a
    Column) restricts the lookup to some rows; the others get null and cost
    one failed hash probe.  ``cover`` says whether cells of the map tell most
    points without a test; by default, from ``COVER_ENTRIES`` on.
    """
    band, entries = _plan_keys(edges, [("y1", "y2")], band)
    if cover is None:
        cover = entries > COVER_ENTRIES
    if cover:
        points = _covered(points, edges, x, y, only)
        only = F.col("_border")
    small = _fits(entries)
    bands = F.broadcast(_bands(edges, band)) if small else _bands(edges, band)
    pts = points.withColumn("_band", _probe(F.floor(F.col(y) / F.lit(band)).cast("long"), only, small))
    j = pts.join(bands, pts["_band"] == bands["band"], "left")
    px, py = f"`{x}`", f"`{y}`"
    crossing = G.crossing_sql(px, py, "e")
    on_edge = G.on_edge_sql(px, py, "e")
    # polygons whose ray crossings are odd and that do not have the point on an edge
    inside = (
        f"filter(array_distinct(transform(filter(coalesce(edges, array()), e -> {crossing}), "
        f"e -> struct(e.pos AS pos, e.label AS label))), "
        f"c -> size(filter(edges, e -> e.pos = c.pos AND {crossing})) % 2 = 1 "
        f"AND NOT exists(edges, e -> e.pos = c.pos AND {on_edge}))")
    first = F.expr(f"array_min({inside})")
    label = first.getField("label")
    res = j.withColumn(out, F.when(F.col("_border"), label).otherwise(F.col("_inside")) if cover else label).drop("_border", "_inside")
    if default is not None:
        res = res.withColumn(out, F.coalesce(F.col(out), F.lit(default)))
    return res.drop("_band", "band", "edges")


def _boxes(segments: DataFrame, cell: float, d: float) -> DataFrame:
    """The segments' columns with each cell (cx, cy) near them: a segment is cut
    into pieces no longer than a cell, and each goes to the cells of its box
    grown by d (a cell may come more than once)."""
    def rng(a, b):
        lo = F.floor((F.least(a, b) - F.lit(d)) / F.lit(cell)).cast("long")
        hi = F.floor((F.greatest(a, b) + F.lit(d)) / F.lit(cell)).cast("long")
        return F.sequence(lo, hi)

    def at(a, b, k):  # the piece's end; the last is the segment's own
        return F.when(k == F.col("_n"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n"))
    side = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    pieces = (segments.withColumn("_n", F.greatest(F.ceil(side / F.lit(cell)), F.lit(1)).cast("int"))
              .withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))))
    k = F.col("_k")
    return (pieces.withColumn("cx", F.explode(rng(at("x1", "x2", k), at("x1", "x2", k + 1))))
                  .withColumn("cy", F.explode(rng(at("y1", "y2", k), at("y1", "y2", k + 1)))))


def _cells(segments: DataFrame, cell: float, d: float) -> DataFrame:
    """Segment replicated into the grid cells near it."""
    boxes = _boxes(segments.withColumn("_id", F.monotonically_increasing_id()), cell, d)
    return (boxes.select("cx", "cy", "_id", "name", "x1", "y1", "x2", "y2").distinct()
                 .groupBy("cx", "cy")
                 .agg(F.collect_list(F.struct("name", "x1", "y1", "x2", "y2")).alias("segs")))


def points_near_lines(points: DataFrame, segments: DataFrame, d: float, x: str = "x",
                      y: str = "y", cell: float | None = None, mode: str = "any",
                      only: Column | None = None) -> DataFrame:
    """Points within distance ``d`` of any line segment.

    ``mode='any'``: every point once, with ``on_line`` (bool), ``n_lines`` and
    ``line_name`` (smallest matching name).  ``mode='all'``: a left join, one
    row per (point, matching segment); points with no match keep one row with
    a null ``line_name`` (so rows multiply where lines cross).  ``only``
    restricts the lookup to some points; the others are near no line.
    """
    # cells never below 4 d, so a segment's grown box spans few cells
    cell, entries = _plan_keys(segments, [("x1", "x2"), ("y1", "y2")], cell, grow=d, minimum=4 * d)
    small = _fits(entries)
    cells = F.broadcast(_cells(segments, cell, d)) if small else _cells(segments, cell, d)
    pts = (points.withColumn("_cx", _probe(F.floor(F.col(x) / F.lit(cell)).cast("long"), only, small))
                 .withColumn("_cy", _probe(F.floor(F.col(y) / F.lit(cell)).cast("long"), only, small)))
    j = pts.join(cells, (pts["_cx"] == cells["cx"]) & (pts["_cy"] == cells["cy"]), "left")
    dist = G.seg_distance_sql(f"`{x}`", f"`{y}`", "s")
    near = F.expr(f"filter(coalesce(segs, array()), s -> {dist} <= {d!r})")
    j = j.withColumn("_near", near).drop("_cx", "_cy", "cx", "cy", "segs")
    if mode == "any":
        return (j.withColumn("n_lines", F.size("_near"))
                 .withColumn("on_line", F.col("n_lines") > 0)
                 .withColumn("line_name", F.array_min(F.transform("_near", lambda s: s["name"])))
                 .drop("_near"))
    if mode == "all":
        return (j.withColumn("_m", F.explode_outer("_near"))
                 .withColumn("line_name", F.col("_m.name"))
                 .drop("_near", "_m"))
    raise ValueError(f"mode must be 'any' or 'all', not {mode!r}")


def network_flags(persons: DataFrame, segments: DataFrame, d: float, max_y: float, x: str = "point_x",
                  y: str = "point_y") -> DataFrame:
    """``n_stopped_locatable`` and ``n_stopped_locatable_on_hin`` of every person
    (P13): 1 where the point is known and lies below ``max_y``, and where such a
    point is within ``d`` of the network; else 0."""
    known = F.coalesce(F.col(x).isNotNull() & (F.col(y) < F.lit(max_y)), F.lit(False))
    j = points_near_lines(persons, segments, d, x, y, mode="any", only=known)
    return (j.withColumn("n_stopped_locatable", known.cast("int"))
             .withColumn("n_stopped_locatable_on_hin", F.col("on_line").cast("int"))
             .drop("on_line", "n_lines", "line_name"))
