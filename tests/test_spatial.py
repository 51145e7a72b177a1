"""Grid/band spatial joins against brute force (numpy), incl. boundaries."""
import json

import numpy as np
from pyspark.sql import functions as F

from cubewright.operators import spatial as SP
from cubewright.sources import analog as A
from cubewright.sources import files as FS


def brute_pip(px, py, polys):
    """Even-odd with boundary excluded; first polygon in order wins."""
    out = []
    for x, y in zip(px, py):
        lab = None
        for name, ring in polys:
            inside, on = False, False
            for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
                cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
                if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                    on = True
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    inside = not inside
            if inside and not on:
                lab = name
                break
        out.append(lab)
    return out


def seg_dist(x, y, s):
    _, x1, y1, x2, y2 = s
    dx, dy = x2 - x1, y2 - y1
    den = dx * dx + dy * dy
    t = 0.0 if den == 0 else min(max(((x - x1) * dx + (y - y1) * dy) / den, 0.0), 1.0)
    return float(np.hypot(x - (x1 + t * dx), y - (y1 + t * dy)))


def points(spark, n=3000, seed=7):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(-0.35, 0.35, size=(n, 2)).round(3)   # many exact grid/boundary hits
    extra = [(0.0, -0.1), (-0.2, -0.1), (0.1, -0.1), (0.05, 0.0), (-0.1, 0.05), (0.0, 0.25)]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(list(map(tuple, xy)) + extra)]
    return spark.createDataFrame(rows, "vec_id long, x double, y double"), rows


def test_pip_matches_brute_force(spark):
    df, rows = points(spark)
    edges = SP.polygon_edges(A.polygons(spark))
    for band in (0.05, 0.013, None):          # None: auto sizing
        got = {r["vec_id"]: r["polygon_label"]
               for r in SP.point_in_polygon(df.repartition(5), edges, band=band).collect()}
        want = brute_pip([r[1] for r in rows], [r[2] for r in rows], A.POLYGONS)
        assert [got[r[0]] for r in rows] == want


def test_pip_only_and_default(spark):
    df, rows = points(spark, n=200)
    edges = SP.polygon_edges(A.polygons(spark))
    r = SP.point_in_polygon(df, edges, default="-1", only=F.col("vec_id") % 2 == 0).collect()
    assert len(r) == len(rows)
    assert all(x["polygon_label"] == "-1" for x in r if x["vec_id"] % 2 == 1)


def test_near_lines_matches_brute_force(spark):
    df, rows = points(spark)
    d = A.SEGMENT_DISTANCE
    want_all = sorted((r[0], s[0]) for r in rows for s in A.SEGMENTS if seg_dist(r[1], r[2], s) <= d)
    for cell in (0.05, 0.021, None):
        got = SP.points_near_lines(df, A.segments(spark), d, cell=cell, mode="all")
        pairs = sorted((r["vec_id"], r["line_name"]) for r in got.collect() if r["line_name"])
        assert pairs == want_all
        n_rows = got.count()
        matched = {p[0] for p in want_all}
        assert n_rows == len(want_all) + len(rows) - len(matched)
    anym = {r["vec_id"]: r["n_lines"] for r in SP.points_near_lines(df, A.segments(spark), d).collect()}
    assert sum(anym.values()) == len(want_all) and len(anym) == len(rows)


def test_geojson_scan_to_edges(spark, tmp):
    feats = [{"type": "Feature", "properties": {"PSA_NUM": lab},
              "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in ring]]}}
             for lab, ring in A.POLYGONS]
    # one multipolygon with a hole: square with a square hole, plus a far part
    feats.append({"type": "Feature", "properties": {"PSA_NUM": "991"}, "geometry": {
        "type": "MultiPolygon", "coordinates": [
            [[[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]], [[1.4, 1.4], [1.6, 1.4], [1.6, 1.6], [1.4, 1.6], [1.4, 1.4]]],
            [[[3, 3], [4, 3], [4, 4], [3, 4], [3, 3]]]]}})
    path = f"{tmp}/map.geojson"
    with open(path, "w") as fh:
        json.dump({"type": "FeatureCollection", "features": feats}, fh)
    polys = FS.read_geojson(spark, path, "PSA_NUM")
    edges = SP.polygon_edges(polys)
    assert edges.count() == 4 + 3 + 6 + 4 + 12
    pts = spark.createDataFrame([(1, 1.2, 1.2), (2, 1.5, 1.5), (3, 3.5, 3.5), (4, -0.1, -0.1)],
                                "vec_id long, x double, y double")
    got = {r["vec_id"]: r["polygon_label"] for r in SP.point_in_polygon(pts, edges, band=0.5).collect()}
    assert got == {1: "991", 2: None, 3: "991", 4: "091"}


def test_geojson_point_features(spark):
    from cubewright.sources import sinks as SK
    s = SK.hin_points(A.points(spark, "/root/testdata/sf0.001"), A.segments(spark), 100, A.SEGMENT_DISTANCE)
    rows = SK.point_features(s, "lng", "lat", ["vec_id", "on_hin", "stname", "hover_text"]).collect()
    assert rows
    for r in rows:
        f = json.loads(r["feature"])
        assert f["type"] == "Feature" and f["geometry"]["type"] == "Point"
        assert len(f["geometry"]["coordinates"]) == 2
        assert f["properties"]["vec_id"] == r["vec_id"]
        assert f["properties"]["on_hin"] == ("stname" in f["properties"])


def star_polygon(rng, cx, cy, n):
    ang = np.sort(rng.uniform(0, 2 * np.pi, n))
    rad = rng.uniform(0.05, 0.2, n)
    pts = [(round(cx + r * np.cos(a), 2), round(cy + r * np.sin(a), 2)) for a, r in zip(ang, rad)]
    return pts + [pts[0]]


def test_pip_random_polygons_vs_brute_force(spark):
    rng = np.random.default_rng(11)
    for trial in range(4):
        polys = [(f"P{i}", star_polygon(rng, rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5), int(rng.integers(3, 12))))
                 for i in range(4)]
        rows = [(i, pos, lab, [[[float(x), float(y)] for x, y in ring]]) for i, (pos, (lab, ring)) in
                enumerate(zip(range(len(polys)), polys))]
        pdf = spark.createDataFrame([(r[1], r[2], r[3]) for r in rows],
                                    "pos int, label string, rings array<array<array<double>>>")
        verts = [v for _, ring in polys for v in ring]
        xy = list(map(tuple, rng.uniform(-0.75, 0.75, size=(400, 2)).round(2))) + verts
        pts_rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
        pts = spark.createDataFrame(pts_rows, "vec_id long, x double, y double")
        band = [None, 0.01, 0.1, 0.37][trial]
        got = {r["vec_id"]: r["polygon_label"] for r in
               SP.point_in_polygon(pts, SP.polygon_edges(pdf), band=band).collect()}
        want = brute_pip([r[1] for r in pts_rows], [r[2] for r in pts_rows], polys)
        assert [got[r[0]] for r in pts_rows] == want, trial


def test_shuffled_fallback_when_shapes_exceed_bound(spark, monkeypatch):
    df, rows = points(spark, n=800)
    monkeypatch.setattr(SP, "MAX_BROADCAST_SHAPE_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        r = SP.point_in_polygon(df, SP.polygon_edges(A.polygons(spark)))
        plan = r._jdf.queryExecution().executedPlan().toString()
        got = {x["vec_id"]: x["polygon_label"] for x in r.collect()}
        near = SP.points_near_lines(df, A.segments(spark), A.SEGMENT_DISTANCE, mode="all")
        pairs = sorted((x["vec_id"], x["line_name"]) for x in near.collect() if x["line_name"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan
    assert [got[r_[0]] for r_ in rows] == brute_pip([r_[1] for r_ in rows], [r_[2] for r_ in rows], A.POLYGONS)
    want = sorted((r_[0], s[0]) for r_ in rows for s in A.SEGMENTS
                  if seg_dist(r_[1], r_[2], s) <= A.SEGMENT_DISTANCE)
    assert pairs == want


def test_polygon_features_with_flags(spark):
    from cubewright.sources import sinks as SK
    polys = A.polygons(spark)
    flags = spark.createDataFrame([("09", True), ("22", False)], "districtoccur string, is_top_5_increase boolean")
    j = polys.withColumn("district", F.substring("label", 1, 2)).join(
        flags, F.col("district") == F.col("districtoccur"))
    feats = SK.polygon_features(j, ["label", "is_top_5_increase"]).collect()
    docs = {json.loads(r["feature"])["properties"]["label"]: json.loads(r["feature"]) for r in feats}
    assert set(docs) == {"091", "092", "093", "221"}
    assert docs["221"]["properties"]["is_top_5_increase"] is False
    assert docs["092"]["geometry"]["type"] == "Polygon"
    assert docs["092"]["geometry"]["coordinates"][0][1] == [0.25, 0.0]


def test_planned_entries_bound_the_built_ones(spark):
    edges = SP.polygon_edges(A.polygons(spark))
    for band in (None, 0.05, 0.013):
        size, entries = SP._plan_keys(edges, [("y1", "y2")], band)
        built = SP._bands(edges, size).agg(F.sum(F.size("edges"))).collect()[0][0]
        assert entries == built
    segs = A.segments(spark)
    for cell in (None, 0.05):
        size, entries = SP._plan_keys(segs, [("x1", "x2"), ("y1", "y2")], cell, grow=0.02, minimum=0.08)
        built = SP._cells(segs, size, 0.02).agg(F.sum(F.size("segs"))).collect()[0][0]
        assert built <= entries <= 4 * built


def test_planner_uses_no_single_partition_over_shapes(spark):
    from cubewright.sources import analog as A
    import contextlib
    import io
    pts = spark.createDataFrame([(1, 0.1, 0.1)], "k int, x double, y double")
    for df in (SP.point_in_polygon(pts, SP.polygon_edges(A.polygons(spark))),
               SP.points_near_lines(pts, A.segments(spark), 0.02)):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        assert "SinglePartition" not in out.getvalue()


def test_long_segment_entries_follow_its_length(spark):
    segs = spark.createDataFrame([("diag", 0.0, 0.0, 0.3, 0.3), ("dot", 0.1, 0.2, 0.1, 0.2)],
                                 "name string, x1 double, y1 double, x2 double, y2 double")
    cells = SP._cells(segs, 0.0004, 0.0001)
    n = cells.selectExpr("sum(size(segs))").first()[0]
    assert n < 6 * (0.3 / 0.0004)
    pts = spark.createDataFrame([(i, i * 0.003, i * 0.003 + (0.00005 if i % 2 else 0.0005)) for i in range(100)], "k int, x double, y double")
    got = {r["k"]: r["on_line"] for r in SP.points_near_lines(pts, segs, 0.0001, cell=0.0004).collect()}
    assert got == {i: bool(i % 2) for i in range(100)}


def test_remap_through_the_shuffled_branch(spark, monkeypatch):
    from cubewright.operators.remap import remap_districts
    edges = SP.polygon_edges(spark.createDataFrame([(0, "X092", [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]])],
                                                   "pos int, label string, rings array<array<array<double>>>"))
    rows = [("12", "1", 0.1, 0.1)] * 500 + [("06", "3", 0.1, 0.1), ("09", "1", 5.0, 5.0), ("06", "2", None, None)]
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, districtoccur string, psa string, point_x double, point_y double")
    want = sorted(map(tuple, remap_districts(p, edges).collect()))
    monkeypatch.setattr(SP, "MAX_BROADCAST_SHAPE_ROWS", 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = remap_districts(p, edges)
        got = sorted(map(tuple, df.collect()))
        sizes = [len(x) for x in df.rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want
    assert [r[2] for r in got[500:]] == ["2", "-1", None]
    assert max(sizes) < 0.6 * len(rows)          # rows without a key are spread


def test_network_flags_guard(spark):
    segs = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 0.0)], "name string, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 0.5, 0.01), (2, 0.5, 0.5), (3, 0.5, 50.0), (4, None, None), (5, 0.5, -0.01)], "k int, point_x double, point_y double")
    f = SP.network_flags(p, segs, 0.02, 42.0)
    assert {r["k"]: (r["n_stopped_locatable"], r["n_stopped_locatable_on_hin"]) for r in f.collect()} == {
        1: (1, 1), 2: (1, 0), 3: (0, 0), 4: (0, 0), 5: (1, 1)}


def _read_columns(df):
    """The columns of every file scan of the plan."""
    import contextlib
    import io
    import re
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return [set(re.findall(r"(\w+):", x)) for x in re.findall(r"ReadSchema: struct<([^>]*)>", out.getvalue())]


def test_probes_read_needed_columns_only(spark, tmp):
    """The lookups read keys, coordinates and what the result uses, whether the
    shapes are broadcast or not."""
    from cubewright.operators.remap import remap_districts
    from cubewright.sources import analog as A
    spark.range(50).selectExpr("id as k", "'06' as districtoccur", "'1' as psa", "id / 100 as point_x", "id / 90 as point_y",
                               "'much text' as other", "map(1, id) as further").write.parquet(f"{tmp}/p")
    p = spark.read.parquet(f"{tmp}/p")
    flags = SP.network_flags(p, A.segments(spark), 0.02, 42.0).groupBy("districtoccur").sum("n_stopped_locatable_on_hin")
    psas = remap_districts(p, SP.polygon_edges(A.polygons(spark))).groupBy("districtoccur", "psa").count()
    assert _read_columns(flags) == [{"districtoccur", "point_x", "point_y"}]
    assert _read_columns(psas) == [{"districtoccur", "psa", "point_x", "point_y"}]
    near = SP.points_near_lines(p, A.segments(spark), 0.02, "point_x", "point_y", only=p.k % 2 == 0)
    all_ = {r["k"]: r["on_line"] for r in SP.points_near_lines(p, A.segments(spark), 0.02, "point_x", "point_y").collect()}
    assert {r["k"]: r["on_line"] for r in near.collect()} == {k: v and k % 2 == 0 for k, v in all_.items()}


def _map(rng, n=9, vertices=90):
    """Jagged polygons that overlap, one with a hole, one along cell borders."""
    polys = [(f"P{i}", star_polygon(rng, rng.uniform(-1, 1), rng.uniform(-1, 1), vertices)) for i in range(n)]
    return polys + [("square", [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5)]), ("thin", [(-1.2, 0.9), (1.2, 0.9001), (1.2, 0.9002), (-1.2, 0.9)])]


def test_cover_equals_brute_force_and_saves_tests(spark, monkeypatch):
    rng = np.random.default_rng(5)
    polys = _map(rng)
    shapes = [(i, lab, [[[float(x), float(y)] for x, y in ring]]) for i, (lab, ring) in enumerate(polys)]
    edges = SP.polygon_edges(spark.createDataFrame(shapes, "pos int, label string, rings array<array<array<double>>>"))
    xy = [*map(tuple, rng.uniform(-1.6, 1.6, (900, 2))), *map(tuple, rng.normal(0.2, 0.05, (600, 2)))]      # a hot place
    xy += [(x, y) for _, ring in polys for x, y in ring[::17]]                                                  # vertices
    xy += [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for _, ring in polys[-2:] for a, b in zip(ring[:-1], ring[1:])]  # on edges
    xy += [(i / 64 - 1, j / 64 - 1) for i in range(0, 128, 12) for j in range(0, 128, 12)] + [(50.0, 0.0), (0.0, -50.0)]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(len(xy), None, 0.1), (len(xy) + 1, 0.1, None)]
    pts = spark.createDataFrame(rows, "vec_id long, x double, y double")
    want = [*brute_pip([r[1] for r in rows[:-2]], [r[2] for r in rows[:-2]], polys), None, None]
    with_cover = {r["vec_id"]: r["polygon_label"] for r in SP.point_in_polygon(pts, edges, cover=True).collect()}
    assert [with_cover[r[0]] for r in rows] == want and len({*want}) > 6
    some = {r["vec_id"]: r["polygon_label"] for r in SP.point_in_polygon(pts, edges, cover=True, only=F.col("vec_id") % 3 == 0, default="-").collect()}
    assert [some[r[0]] for r in rows] == [(w or "-") if r[0] % 3 == 0 else "-" for r, w in zip(rows, want)]
    r = SP.cover_report(pts, edges).first()
    assert r["n_points"] == len(rows) and r["n_tested"] < 0.35 * len(rows) and r["edges_with_cover"] < 0.35 * r["edges_without"]
    monkeypatch.setattr(SP, "COVER_ENTRIES", 0)
    monkeypatch.setattr(SP, "MAX_BROADCAST_SHAPE_ROWS", 0)
    shuffled = {r["vec_id"]: r["polygon_label"] for r in SP.point_in_polygon(pts, edges).collect()}
    assert [shuffled[r[0]] for r in rows] == want
    assert SP.point_in_polygon(pts, edges.where("pos < 0"), cover=True).where("polygon_label is not null").count() == 0
