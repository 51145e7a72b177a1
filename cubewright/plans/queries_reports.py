"""Registered queries for the report side (R1-R16) and the operators they
compose, bound to the analog parameters (FIXTURES.md §3).

Each query builds the cubes from the whole test tables, materialises them
once into the session's checkpoint folder (so a report with several parts
does not rebuild the cube per part) and runs the report on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import mathx as M
from ..functions import timeq as TQ
from ..operators import filters as FL
from ..operators import metrics as ME
from ..operators import quality as QU
from ..operators import rank as RK
from ..operators import spatial as SP
from ..session import cut_lineage
from ..sources import analog as A
from . import reports as RP
from .analog_tables import AnalogTables

AN = C.ANALOG
SPINE = TQ.quarters_between_py(AN["first_quarter"], AN["most_recent_quarter"])
LAST4 = (SPINE[-4], SPINE[-1])
YEAR = AN["report_year"]


def ctx(spark: SparkSession, sf_dir: str, materialize: bool = True) -> RP.ReportCtx:
    t = AnalogTables(spark, sf_dir)
    keep = cut_lineage if materialize else (lambda df: df)
    reason = {}

    def reason_cube():
        if "r" not in reason:
            reason["r"] = keep(t.reason_cube())
        return reason["r"]

    from ..operators import cube as CU
    return RP.ReportCtx(
        {"reason_cube": reason_cube,
         "cube": lambda: keep(CU.stop_cube(reason_cube())),
         "hin_cube": lambda: keep(t.hin_cube()),
         "shootings_cube": lambda: keep(t.shootings_cube()),
         "population": t.population},
        t.division_map(), SPINE)


# ---------------------------------------------------------------------------
# reports
# ---------------------------------------------------------------------------

def q_r_num_stops(spark, sf_dir):
    return RP.r_num_stops(ctx(spark, sf_dir), "*", "year", AN["eras"])


def q_r_time_slice(spark, sf_dir):
    return RP.r_time_slice(ctx(spark, sf_dir), *LAST4, location="*")


def q_r_seasonal(spark, sf_dir):
    return RP.r_seasonal(ctx(spark, sf_dir), ["Q1", "Q3"], location="07*")


def q_r_share_by_demo(spark, sf_dir):
    return RP.r_share_by_demo(ctx(spark, sf_dir), "race", *LAST4)


def q_r_most_frequent(spark, sf_dir):
    return RP.r_most_frequent(ctx(spark, sf_dir), *LAST4)


COHORT1 = {"age_range": ["Under 25", "25-34"], "gender": ["Male"], "race": ["Black", "Latino"]}
COHORT2 = {"age_range": ["25-34", "35-44"], "gender": ["Male", "Female"], "race": ["Black"]}


def q_r_cohorts(spark, sf_dir):
    return RP.r_cohorts(ctx(spark, sf_dir), COHORT1, COHORT2, *LAST4)


def q_r_snapshot(spark, sf_dir):
    return RP.r_snapshot(ctx(spark, sf_dir), 4, AN["before"], AN["after"])


def q_r_intrusions(spark, sf_dir):
    return RP.r_intrusions(ctx(spark, sf_dir), "*", "quarter", AN["eras"])


def q_r_search_frisk(spark, sf_dir):
    return RP.r_search_frisk(ctx(spark, sf_dir), "ASIA", "year")


def q_r_baseline(spark, sf_dir):
    return RP.r_baseline(ctx(spark, sf_dir), "age_range", "35-44", SPINE[0], SPINE[-1])


def _round_fits(df):
    """Fitted values to 4 decimals, as in the oracle: engines add up in other orders."""
    return df.withColumns({c: M.round_even(F.col(c), 4) for c in df.columns if c.startswith("fit_")})


def q_r_whiteness(spark, sf_dir):
    return _round_fits(RP.r_whiteness(ctx(spark, sf_dir), "n_frisked", SPINE[0], SPINE[-1]))


COMPARE = ["12", "12-3", "03*", "EUROPE", "zz", "*", "07"]


def q_r_compare_districts(spark, sf_dir):
    return RP.r_compare_districts(ctx(spark, sf_dir), COMPARE, "n_frisked", SPINE[0], SPINE[-1])


def q_r_hin(spark, sf_dir):
    return RP.r_hin(ctx(spark, sf_dir), "*", "year", AN["before"], AN["after"])


def q_r_surge_map(spark, sf_dir):
    (s, e), = AN["map_windows"]
    return RP.r_window_map(ctx(spark, sf_dir), s, e, "n_shootings", "n_stopped")


def q_r_before_after_map(spark, sf_dir):
    return RP.r_window_map(ctx(spark, sf_dir), AN["before"], AN["after"], "n_stopped",
                           "n_shootings")


def q_r_reason_by_race(spark, sf_dir):
    return RP.r_reason_by_race(ctx(spark, sf_dir), YEAR)


def q_r_reason_by_area(spark, sf_dir):
    return RP.r_reason_by_area(ctx(spark, sf_dir), YEAR)


def q_r_covered_reasons(spark, sf_dir):
    return RP.r_covered_reasons(ctx(spark, sf_dir), f"{YEAR}-01-01", SPINE[-1], "quarter")


def q_r_operational(spark, sf_dir):
    return RP.r_operational(ctx(spark, sf_dir), YEAR)


# ---------------------------------------------------------------------------
# operators on the cube
# ---------------------------------------------------------------------------

def _cube(spark, sf_dir) -> DataFrame:
    return ctx(spark, sf_dir, materialize=False).cube


def _loc_totals(df):
    return df.groupBy("districtoccur", "psa").agg(F.sum("n_stopped").cast("long").alias("n_stopped"))


def q_filter_location(spark, sf_dir):
    """District ``07`` and PSA ``12-3``, tagged."""
    c = ctx(spark, sf_dir)
    a = _loc_totals(c.loc(c.cube, "07*")).withColumn("location", F.lit("07*"))
    b = _loc_totals(c.loc(c.cube, "12-3")).withColumn("location", F.lit("12-3"))
    z = _loc_totals(c.loc(c.cube, "zz")).withColumn("location", F.lit("zz"))
    return a.unionByName(b).unionByName(z)


def q_filter_division(spark, sf_dir):
    """Division AFRICA: its nations plus the shared district."""
    c = ctx(spark, sf_dir, materialize=False)
    return c.loc(c.cube, "AFRICA").groupBy("districtoccur").agg(
        F.sum("n_stopped").cast("long").alias("n_stopped"))


def q_filter_quarters(spark, sf_dir):
    c = ctx(spark, sf_dir, materialize=False)
    return c.window(c.cube, "1996-Q2", "1997-Q3").groupBy("quarter").agg(
        F.sum("n_stopped").cast("long").alias("n_stopped"))


def q_filter_demo(spark, sf_dir):
    c = _cube(spark, sf_dir)
    p = FL.demo_predicate(["Under 25", "65+"], ["Female"], ["Asian", "White", "Latino"])
    return c.where(p).groupBy("race", "age_range").agg(F.sum("n_stopped").cast("long").alias("n_stopped"))


CHOICES = [{"gender": "Male", "race": "Black", "age_range": None},
           {"gender": None, "race": None, "age_range": "65+"}]


def q_filter_demo_choices(spark, sf_dir):
    c = _cube(spark, sf_dir)
    return c.where(FL.cohort_predicate(CHOICES)).groupBy("gender", "race", "age_range").agg(
        F.sum("n_stopped").cast("long").alias("n_stopped"))


def q_filter_reason(spark, sf_dir):
    r = ctx(spark, sf_dir).reason_cube
    a = FL.exclude_categories(r, ["Other", "None"]).agg(F.sum("n_stopped").alias("v")) \
        .select(F.lit("excluded_other_none").alias("metric"), F.col("v").cast("long").alias("n_stopped"))
    b = FL.keep_categories(r, C.OPERATIONAL_CATEGORIES).agg(F.sum("n_stopped").alias("v")) \
        .select(F.lit("operational").alias("metric"), F.col("v").cast("long").alias("n_stopped"))
    return a.unionByName(b)


def q_trend_by_grain(spark, sf_dir):
    c = _cube(spark, sf_dir)
    return ME.sums(c, ["quarter"], ["n_stopped", "n_searched", "n_frisked", "n_intruded"])


def q_rollup_prefix(spark, sf_dir):
    c = _cube(spark, sf_dir)
    return ME.sums(c, ["year"], FL.measure_columns(c))


def q_total_and_rate(spark, sf_dir):
    """Pre-aggregate to place x time, then one total and one rate."""
    c = _cube(spark, sf_dir)
    pre = ME.sums(c, ["districtoccur", "psa", "year", "quarter", "q_str"], C.STOP_MEASURES)
    return RP.kpi(pre, {"n_intruded": F.sum("n_intruded"),
                        "pct_intruded": M.round_even(M.pct_of(F.sum("n_intruded"), F.sum("n_stopped")), 1)})


def q_avg_monthly(spark, sf_dir):
    c = _cube(spark, sf_dir)
    return ME.avg_monthly(FL.filter_quarters(c, SPINE, "1998-Q1", "1999-Q4"), "n_stopped")


def q_avg_monthly_merged(spark, sf_dir):
    """The average per district from the quarter sets of three parts of the
    cube that share quarters, merged without the cube's rows (A10, A15, A4)."""
    c = FL.filter_quarters(ctx(spark, sf_dir).cube, SPINE, "1998-Q1", "1999-Q4")
    part = F.pmod(F.xxhash64("race", "gender", "psa"), F.lit(3))
    parts = [ME.quarter_sets(c.where(part == i), ["districtoccur"], ["n_stopped"]) for i in range(3)]
    merged = ME.merge_quarter_sets(parts, ["districtoccur"], ["n_stopped"])
    n = merged.select("districtoccur", F.bitmap_count("quarters").alias("n_quarters"))
    return ME.avg_monthly_of_sets(merged, "n_stopped").join(n, "districtoccur")


def q_avg_monthly_calendar(spark, sf_dir):
    """Calendar average differs when a quarter of the range has no rows."""
    c = FL.filter_location(_cube(spark, sf_dir), "07-1")
    qs = FL.window_quarters(SPINE, "1998-Q1", "1999-Q4")
    d = c.where(F.col("quarter").isin(qs)).where(F.col("race") == "Asian")
    return RP.kpi(d, {
        "avg_present": ME.avg_monthly_expr(F.sum("n_stopped"), F.countDistinct("quarter")),
        "avg_calendar": ME.avg_monthly_expr(F.sum("n_stopped"), F.lit(len(qs)))})


def q_share_by_demo(spark, sf_dir):
    return RP.r_share_by_demo(ctx(spark, sf_dir, materialize=False), "age_range")


def q_rate_by_demo(spark, sf_dir):
    c = _cube(spark, sf_dir)
    g = ME.sums(c, ["gender"], ["n_intruded", "n_stopped"])
    return g.withColumn("intrusion_rate", M.round_even(M.pct_of(F.col("n_intruded"), F.col("n_stopped")), 1))


def q_operational_share(spark, sf_dir):
    return RP.r_operational(ctx(spark, sf_dir, materialize=False), 1997)


def q_miss_rate(spark, sf_dir):
    c = _cube(spark, sf_dir)
    return RP.kpi(c, {"pct_not_found": (F.lit(1.0) - M.ratio(F.sum("n_contraband"), F.sum("n_intruded")))
                      * F.lit(100.0)})


def q_seasonal_complete(spark, sf_dir):
    return RP.r_seasonal(ctx(spark, sf_dir, materialize=False), ["Q4", "Q1"], location="*")


def q_compare_list(spark, sf_dir):
    return RP.r_compare_districts(ctx(spark, sf_dir, materialize=False), ["24", "zz", "01-2", "ASIA", "01"],
                                  "n_stopped", "1997-01-01", "1997-12-31")


def q_cohort_compare(spark, sf_dir):
    return RP.r_cohorts(ctx(spark, sf_dir, materialize=False), COHORT1, COHORT2)


def q_majority_split(spark, sf_dir):
    return RP.majority_split(A.population(spark, sf_dir))


def q_ols_trend(spark, sf_dir):
    c = ctx(spark, sf_dir, materialize=False)
    return _round_fits(RP.r_whiteness(c, "n_stopped").select("districtoccur", "whiteness", "n_stopped",
                                                             "fit_n_stopped"))


def q_pct_change_rank(spark, sf_dir):
    (s, e), = AN["map_windows"]
    j = RP.compare_windows(ctx(spark, sf_dir), s, e, "n_shootings", "n_stopped")
    return j.drop(*[c for c in j.columns if c.startswith("_key_")])


def q_topk_flags(spark, sf_dir):
    """Attribute join of the top-5 rows of both maps to polygon features by
    district (J11): the first row per district wins (most decreased first)."""
    (s, e), = AN["map_windows"]
    c = ctx(spark, sf_dir)
    a = polygon_flags(A.polygons(spark),
                      RP.r_window_map(c, s, e, "n_shootings", "n_stopped")).withColumn("map", F.lit("surge"))
    b = polygon_flags(A.polygons(spark),
                      RP.r_window_map(c, AN["before"], AN["after"], "n_stopped", "n_shootings")) \
        .withColumn("map", F.lit("before_after"))
    return a.unionByName(b)


def polygon_flags(polygons: DataFrame, rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window
    first = rows.withColumn("_o", F.when(F.col("source") == "most_decreased", 0).otherwise(1)) \
        .withColumn("_rn", F.row_number().over(Window.partitionBy("districtoccur").orderBy("_o"))) \
        .where(F.col("_rn") == 1)
    feats = polygons.select("pos", "label", F.substring("label", 1, 2).alias("district"))
    j = F.broadcast(feats).join(first, feats.district == first.districtoccur)
    return j.select("pos", "label", "district", "source", "is_top_5_decrease", "is_top_5_increase")


def q_share_within_group(spark, sf_dir):
    return RP.r_reason_by_race(ctx(spark, sf_dir, materialize=False), 1997)


def q_baseline_ratio(spark, sf_dir):
    return RP.r_baseline(ctx(spark, sf_dir), "race", "White", "1997-01-01", "1998-12-31",
                         location="ASIA")


BASELINE_SLICES = [("00-0", "2000-Q3"), ("00-1", "1996-Q4")]


def q_baseline_label(spark, sf_dir):
    """Baseline statuses where the baseline member has no intrusions: one
    slice where the other member has some (above) and one where neither has
    any (zero)."""
    c = ctx(spark, sf_dir)
    out = None
    for location, q in BASELINE_SLICES:
        r = RP.r_baseline(c, "gender", "Female", q, q, location=location).select(
            F.lit(location).alias("slice"), "member", "percentage", "multiplier", "status",
            "no_contraband", "nc_multiplier", "nc_status", "percentage_found",
            "found_multiplier", "found_status")
        out = r if out is None else out.unionByName(r)
    return out


def q_enum_sort(spark, sf_dir):
    c = _cube(spark, sf_dir)
    g = ME.sums(c, ["age_range"], ["n_stopped"])
    return g.select("age_range", "n_stopped",
                    RK.enum_order(F.col("age_range"), C.AGE_ORDER).alias("member_order"))


def q_most_frequent_group(spark, sf_dir):
    return RP.r_most_frequent(ctx(spark, sf_dir, materialize=False)).where(F.col("is_top"))


def q_ranked_demographics(spark, sf_dir):
    return RP.r_most_frequent(ctx(spark, sf_dir, materialize=False), "1996-Q1", "1996-Q4",
                              location="ASIA")


def q_unpivot_rates(spark, sf_dir):
    return RP.r_search_frisk(ctx(spark, sf_dir, materialize=False), "*", "quarter")


def q_share_vs_population(spark, sf_dir):
    return RP.r_snapshot(ctx(spark, sf_dir), 4, AN["before"], AN["after"]) \
        .where(F.col("section") == "race")


def q_population_by_race(spark, sf_dir):
    return RP.population_by_race(A.population(spark, sf_dir))


def q_dim_population(spark, sf_dir):
    return A.population(spark, sf_dir)


def q_dim_rollup(spark, sf_dir):
    """Population summed by division through the geography table."""
    p = A.population(spark, sf_dir)
    geo = A.division_map(spark, sf_dir).withColumnRenamed("district", "full_psa_num")
    return RP.population_rollup(p, geo, "division", "district").select("division", "total", "white")


def q_rate_by_whiteness(spark, sf_dir):
    return _round_fits(RP.r_whiteness(ctx(spark, sf_dir), "n_intruded", "1997-Q1", "1999-Q4"))


def q_parse_quarter(spark, sf_dir):
    c = _cube(spark, sf_dir)
    q = c.select("quarter").distinct()
    return q.select("quarter", TQ.quarter_date_of_label(F.col("quarter")).cast("string").alias("start"),
                    F.date_add(F.add_months(TQ.quarter_date_of_label(F.col("quarter")), 3), -1)
                    .cast("string").alias("last_day"))


def q_quarter_spine(spark, sf_dir):
    """Spine quarters left-joined to the cube: quarters with no rows show 0."""
    c = FL.filter_location(_cube(spark, sf_dir), "07-1")
    sp = TQ.quarter_spine(spark, AN["first_quarter"], AN["most_recent_quarter"])
    g = c.groupBy("quarter").agg(F.sum("n_stopped").alias("v"))
    j = F.broadcast(sp).join(g, "quarter", "left")
    return j.select("quarter", "year", "q_str", F.coalesce("v", F.lit(0)).cast("long").alias("n_stopped"))


def q_season_label(spark, sf_dir):
    c = _cube(spark, sf_dir)
    q = c.select("quarter", "q_str").distinct()
    return q.select("quarter", TQ.year_season(F.col("quarter")).alias("season"),
                    TQ.season_label(F.col("q_str"), "start").alias("start_month"),
                    TQ.season_label(F.col("q_str"), "end").alias("end_month"))


def q_latest_full_quarter(spark, sf_dir):
    """Per table: last date -> last complete quarter; the tables must agree."""
    o = A.table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("last_dt")) \
        .withColumn("table", F.lit("orders"))
    li = A.table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("last_dt")) \
        .withColumn("table", F.lit("lineitem"))
    u = o.unionByName(li).withColumn("quarter", TQ.previous_full_quarter(F.col("last_dt")))
    agree = QU.agree_report(u)
    return u.select("table", F.col("last_dt").cast("date").cast("string").alias("last_dt"),
                    "quarter").unionByName(
        agree.select(F.lit("*").alias("table"), F.lit(None).cast("string").alias("last_dt"),
                     F.when(F.col("ok"), F.col("quarter")).alias("quarter")))


def q_before_after(spark, sf_dir):
    c = _cube(spark, sf_dir)
    cx = ctx(spark, sf_dir, materialize=False)
    b, a = cx.in_window(*AN["before"]), cx.in_window(*AN["after"])
    g = c.groupBy("districtoccur").agg(F.sum(F.when(b, F.col("n_stopped"))).cast("long").alias("n_before"),
                                       F.sum(F.when(a, F.col("n_stopped"))).cast("long").alias("n_after"))
    return g.withColumn("pct_change", M.round_even(M.pct_change(F.col("n_before"), F.col("n_after")), 1))


def q_kpi_rows(spark, sf_dir):
    return RP.r_time_slice(ctx(spark, sf_dir, materialize=False), "1997-Q1", "1997-Q4", location="EUROPE")


def q_chart_rows(spark, sf_dir):
    """A figure's tidy rows: bars of one measure and the fitted line."""
    from ..sources.sinks import chart_rows
    w = _round_fits(RP.r_whiteness(ctx(spark, sf_dir), "n_frisked", SPINE[0], SPINE[-1]))
    return chart_rows(w, "whiteness", "whiteness", "n_frisked", group="districtoccur",
                      annotation="intrusion_rate", trend="fit_n_frisked").drop("x") \
        .withColumnRenamed("group", "district")


# ---------------------------------------------------------------------------
# spatial
# ---------------------------------------------------------------------------

def q_point_in_polygon(spark, sf_dir):
    pts = A.points(spark, sf_dir)
    edges = SP.polygon_edges(A.polygons(spark))
    r = SP.point_in_polygon(pts, edges, "x", "y", out="psa_num", default=None)
    return r.select("vec_id", "psa_num",
                    F.coalesce(F.substring("psa_num", -1, 1), F.lit(C.UNKNOWN_PSA)).alias("psa"))


def q_point_in_polygon_cover(spark, sf_dir):
    """The same by the map's cover of cells."""
    edges = SP.polygon_edges(A.polygons(spark))
    r = SP.point_in_polygon(A.points(spark, sf_dir), edges, "x", "y", out="psa_num", cover=True)
    return r.select("vec_id", "psa_num", F.coalesce(F.substring("psa_num", -1, 1), F.lit(C.UNKNOWN_PSA)).alias("psa"))


def q_points_near_lines(spark, sf_dir):
    pts = A.points(spark, sf_dir)
    r = SP.points_near_lines(pts, A.segments(spark), A.SEGMENT_DISTANCE, mode="all")
    return r.select("vec_id", "line_name")


def q_hin_points_any(spark, sf_dir):
    pts = A.points(spark, sf_dir)
    r = SP.points_near_lines(pts, A.segments(spark), A.SEGMENT_DISTANCE, mode="any")
    return r.select("vec_id", "on_line", "n_lines", "line_name")


def q_remap_district(spark, sf_dir):
    """Districts 06/09 merged into 09 with the PSA re-derived from the point."""
    p = A.persons(spark, sf_dir)
    edges = SP.polygon_edges(A.polygons(spark))
    from ..operators.remap import remap_districts
    r = remap_districts(p, edges)
    return r.groupBy("districtoccur", "psa").agg(F.count(F.lit(1)).alias("n_people"))


def q_sample_n(spark, sf_dir):
    pts = A.points(spark, sf_dir).where(F.col("y") < C.LOCATABLE_MAX_Y)
    return RK.sample_n(pts, 100, ["vec_id"], seed=42).select("vec_id", "x", "y")


def q_r_hin_points(spark, sf_dir):
    from ..sources.sinks import hin_points
    return hin_points(A.points(spark, sf_dir), A.segments(spark), 100, A.SEGMENT_DISTANCE)


def q_map_extent(spark, sf_dir):
    from ..sources.sinks import hin_points
    s = hin_points(A.points(spark, sf_dir), A.segments(spark), 100, A.SEGMENT_DISTANCE)
    return s.agg(F.percentile("lat", 0.5).alias("median_lat"), F.percentile("lng", 0.5).alias("median_lng"),
                 F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.col("on_hin").cast("int")).cast("long").alias("n_on_hin"))


SAMPLE_YEARS = ((2021, 60), (2022, 40))


def _sample_ctx(spark, sf_dir) -> RP.ReportCtx:
    """Reports over a network sample of two years, drawn as a build does from
    the test points (their year by their id)."""
    from .build import hin_sample
    day = F.make_date(F.lit(2020) + (F.col("vec_id") % 3).cast("int"), F.lit(5), F.lit(1)).cast("timestamp")
    p = A.points(spark, sf_dir).select(
        F.col("vec_id").alias("cartodb_id"), F.col("vec_id").alias("objectid"), day.alias("datetimeoccur"),
        F.concat(F.lit("P"), F.col("vec_id").cast("string")).alias("location"), F.col("x").alias("point_x"), F.col("y").alias("point_y"))
    parts = [hin_sample(p, A.segments(spark), year, n, A.SEGMENT_DISTANCE) for year, n in SAMPLE_YEARS]
    return RP.ReportCtx({"hin_sample": parts[0].unionByName(parts[1])}, {}, SPINE)


def q_hin_report_points(spark, sf_dir):
    """R14's rows through the report over a drawn sample."""
    return RP.r_hin_points(_sample_ctx(spark, sf_dir))


def q_hin_report_extent(spark, sf_dir):
    """R14's centre and the sample's distinct years through the report."""
    r = RP.r_map_extent(_sample_ctx(spark, sf_dir))
    return r.select("median_lat", "median_lng", "n_rows", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


def _write_collection(features: DataFrame, path: str) -> None:
    """One GeoJSON document of a map's features (their number is the map's)."""
    (features.agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.sort_array(F.collect_list("feature")), ", "), F.lit("]}")).alias("value"))
     .write.text(path))


def q_geojson_polygons(spark, sf_dir):
    """Polygons written as a GeoJSON map, read back and looked up."""
    from ..session import scratch_dir
    from ..sources import files as FS
    from ..sources.sinks import polygon_features
    path = scratch_dir(spark, "map")
    _write_collection(polygon_features(A.polygons(spark), ["pos", "label"]), path)
    # features come back in the order of the document
    back = FS.read_geojson(spark, path, "label")
    r = SP.point_in_polygon(A.points(spark, sf_dir), SP.polygon_edges(back), "x", "y", out="psa_num", default=None)
    return r.select("vec_id", "psa_num", F.coalesce(F.substring("psa_num", -1, 1), F.lit(C.UNKNOWN_PSA)).alias("psa"))


def q_geojson_lines(spark, sf_dir):
    """Lines written as a GeoJSON map, read back and joined by distance."""
    from ..session import scratch_dir
    from ..sources import files as FS
    path = scratch_dir(spark, "map")
    line = F.array(F.array("x1", "y1"), F.array("x2", "y2"))
    f = A.segments(spark).select(F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("name").alias("street_name")).alias("properties"),
        F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"))).alias("feature"))
    _write_collection(f, path)
    r = SP.points_near_lines(A.points(spark, sf_dir), FS.read_geojson_lines(spark, path, "street_name"), A.SEGMENT_DISTANCE, mode="all")
    return r.select("vec_id", "line_name")


def q_geojson_points(spark, sf_dir):
    from ..sources.sinks import hin_points, point_features
    s = hin_points(A.points(spark, sf_dir), A.segments(spark), 100, A.SEGMENT_DISTANCE)
    f = point_features(s, "lng", "lat", ["vec_id", "on_hin", "stname", "hover_text"])
    # the features as a reader parses them
    shape = ("type string, properties struct<vec_id: long, on_hin: boolean, stname: string, hover_text: string>, "
             "geometry struct<type: string, coordinates: array<double>>")
    g = f.select(F.from_json("feature", shape).alias("g"))
    return g.select("g.type", "g.properties.*", F.col("g.geometry.type").alias("geometry"),
                    F.col("g.geometry.coordinates")[0].alias("lng"), F.col("g.geometry.coordinates")[1].alias("lat"))


QUERIES = {
    "r_num_stops": q_r_num_stops,
    "r_time_slice": q_r_time_slice,
    "r_seasonal": q_r_seasonal,
    "r_share_by_demo": q_r_share_by_demo,
    "r_most_frequent": q_r_most_frequent,
    "r_cohorts": q_r_cohorts,
    "r_snapshot": q_r_snapshot,
    "r_intrusions": q_r_intrusions,
    "r_search_frisk": q_r_search_frisk,
    "r_baseline": q_r_baseline,
    "r_whiteness": q_r_whiteness,
    "r_compare_districts": q_r_compare_districts,
    "r_hin": q_r_hin,
    "r_hin_points": q_r_hin_points,
    "r_surge_map": q_r_surge_map,
    "r_before_after_map": q_r_before_after_map,
    "r_reason_by_race": q_r_reason_by_race,
    "r_reason_by_area": q_r_reason_by_area,
    "r_covered_reasons": q_r_covered_reasons,
    "r_operational": q_r_operational,
    "filter_location": q_filter_location,
    "filter_division": q_filter_division,
    "filter_quarters": q_filter_quarters,
    "filter_demo": q_filter_demo,
    "filter_demo_choices": q_filter_demo_choices,
    "filter_reason": q_filter_reason,
    "trend_by_grain": q_trend_by_grain,
    "rollup_prefix": q_rollup_prefix,
    "total_and_rate": q_total_and_rate,
    "avg_monthly": q_avg_monthly,
    "avg_monthly_merged": q_avg_monthly_merged,
    "avg_monthly_calendar": q_avg_monthly_calendar,
    "share_by_demo": q_share_by_demo,
    "rate_by_demo": q_rate_by_demo,
    "operational_share": q_operational_share,
    "miss_rate": q_miss_rate,
    "seasonal_complete": q_seasonal_complete,
    "compare_list": q_compare_list,
    "cohort_compare": q_cohort_compare,
    "majority_split": q_majority_split,
    "ols_trend": q_ols_trend,
    "pct_change_rank": q_pct_change_rank,
    "topk_flags": q_topk_flags,
    "share_within_group": q_share_within_group,
    "baseline_ratio": q_baseline_ratio,
    "baseline_label": q_baseline_label,
    "enum_sort": q_enum_sort,
    "most_frequent_group": q_most_frequent_group,
    "ranked_demographics": q_ranked_demographics,
    "unpivot_rates": q_unpivot_rates,
    "share_vs_population": q_share_vs_population,
    "population_by_race": q_population_by_race,
    "dim_population": q_dim_population,
    "dim_rollup": q_dim_rollup,
    "rate_by_whiteness": q_rate_by_whiteness,
    "parse_quarter": q_parse_quarter,
    "quarter_spine": q_quarter_spine,
    "season_label": q_season_label,
    "latest_full_quarter": q_latest_full_quarter,
    "before_after": q_before_after,
    "kpi_rows": q_kpi_rows,
    "chart_rows": q_chart_rows,
    "point_in_polygon": q_point_in_polygon,
    "point_in_polygon_cover": q_point_in_polygon_cover,
    "points_near_lines": q_points_near_lines,
    "hin_points_any": q_hin_points_any,
    "remap_district": q_remap_district,
    "sample_n": q_sample_n,
    "map_extent": q_map_extent,
    "geojson_points": q_geojson_points,
    "geojson_polygons": q_geojson_polygons,
    "geojson_lines": q_geojson_lines,
    "hin_report_points": q_hin_report_points,
    "hin_report_extent": q_hin_report_extent,
}
