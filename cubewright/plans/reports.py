"""The report routes (R1-R16) as DataFrame -> DataFrame functions.

Every report reads the cubes in a :class:`ReportCtx` and returns tidy rows.
Headline numbers are computed in *one* aggregate pass with conditional
aggregates and unpivoted into ``(metric, value)`` rows (no driver loop, no
collect).  Windows without a partition key only ever see grouped frames
bounded by a dimension (demographic members, districts, reasons).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import mathx as M
from ..functions import timeq as TQ
from ..operators import filters as FL
from ..operators import metrics as ME
from ..operators import rank as RK

ENUMS = {"race": C.RACE_ORDER, "gender": C.GENDER_ORDER, "age_range": C.AGE_ORDER}


class ReportCtx:
    """Cubes and dimensions for the reports.

    ``tables`` maps ``cube``, ``reason_cube``, ``hin_cube``,
    ``shootings_cube`` and ``population`` (district, total, white, black,
    asian, hispanic_or_latino, american_indian, unknown) to DataFrames or to
    zero-argument callables that build them on first use.
    """

    def __init__(self, tables: Mapping[str, object],
                 divisions: Mapping[str, Sequence[str]] | DataFrame, spine: Sequence[str],
                 strict: bool = False):
        self._tables = dict(tables)
        self._built: dict[str, DataFrame] = {}
        self.divisions = divisions
        self.spine = list(spine)
        # strict: a quarter window that selects no rows is an error (one-row probe)
        self.strict = strict

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("_tables", {})
        if name not in tables:
            raise AttributeError(name)
        built = self.__dict__["_built"]
        if name not in built:
            v = tables[name]
            built[name] = v() if callable(v) else v
        return built[name]

    @classmethod
    def from_tables(cls, spark, path: str, population: DataFrame | None = None,
                    divisions: Mapping[str, Sequence[str]] | DataFrame = C.DIVISION_DISTRICTS,
                    first_quarter: str = C.FIRST_QUARTER, cache: bool = False,
                    strict: bool = False) -> "ReportCtx":
        """Open a written build: the cubes, its ``settings`` (most recent
        quarter -> spine) and, unless given, its ``population`` table.
        ``cache=True`` keeps the (small) cubes in memory for a report server,
        the way the reproduced system memoises its tables."""
        from ..sources import sinks as SK
        mrq = SK.most_recent_quarter(spark, path)
        path = SK.published(spark, path)
        names = {"cube": "stop_cube", "reason_cube": "stop_cube_reason", "hin_cube": "hin_cube",
                 "shootings_cube": "shootings_cube"}
        tables = {k: spark.read.parquet(f"{path}/{v}") for k, v in names.items()}
        # written only where the build had network lines
        lazy = {"hin_sample": lambda: spark.read.parquet(f"{path}/hin_sample")}
        if cache:
            tables = {k: v.cache() for k, v in tables.items()}
        tables["population"] = population if population is not None else spark.read.parquet(f"{path}/population")
        tables |= lazy
        return cls(tables, divisions, TQ.quarters_between_py(first_quarter, mrq), strict=strict)

    def loc(self, df: DataFrame, location: str) -> DataFrame:
        return FL.filter_location(df, location, self.divisions)

    def window(self, df: DataFrame, start=None, end=None) -> DataFrame:
        out = FL.filter_quarters(df, self.spine, start, end)
        if self.strict and (start or end):
            FL.require_rows(out)
        return out

    def in_window(self, start, end) -> Column:
        qs = FL.window_quarters(self.spine, start, end)
        return F.lit(True) if qs is None else F.col("quarter").isin(qs)

    def window_years(self, *windows) -> list[int] | None:
        """Years touched by the given windows (None when one is unbounded)."""
        ys = set()
        for s, e in windows:
            qs = FL.window_quarters(self.spine, s, e)
            if qs is None:
                return None
            ys |= {int(q[:4]) for q in qs}
        return sorted(ys)

    def n_quarters(self, start, end) -> int:
        qs = FL.window_quarters(self.spine, start, end)
        return len(self.spine) if qs is None else len(qs)


# ---------------------------------------------------------------------------
# shared pieces
# ---------------------------------------------------------------------------

def kpi(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """One aggregate pass, then one ``(metric, value)`` row per metric."""
    names = list(metrics)
    wide = df.agg(*[metrics[n].cast("double").alias(f"m{i}") for i, n in enumerate(names)])
    stack = ", ".join(f"'{n}', m{i}" for i, n in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {stack}) as (metric, value)")


def by_quarter(df: DataFrame, measures: Sequence[str] = ("n_stopped",)) -> DataFrame:
    """At most one row per quarter: distinct quarters are then plain counts,
    and no cube row is expanded for them."""
    return ME.sums(df, ["quarter"], measures)


def grain_label(grain: str) -> Column:
    if grain == "quarter":
        return TQ.year_season(F.col("quarter"))
    return F.col("year").cast("string")


def _sum_if(cond: Column, col: str) -> Column:
    return F.sum(F.when(cond, F.col(col)))


def _quarters_if(cond: Column) -> Column:
    """Quarters of a frame of :func:`by_quarter` that meet a condition."""
    return F.count(F.when(cond, F.col("quarter")))


def pct_change_key(start: Column, end: Column) -> Column:
    """Percent change used for ranking: +inf when growing from zero."""
    return F.when((start == 0) & (end > 0), F.lit(float("inf"))).otherwise(M.pct_change(start, end))


# ---------------------------------------------------------------------------
# stops
# ---------------------------------------------------------------------------

def r_num_stops(ctx: ReportCtx, location: str = "*", grain: str = "year",
                eras: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Stops per year/quarter, the total and the average per month in each era."""
    d = ctx.loc(ctx.cube, location)
    trend = (d.groupBy(grain).agg(F.sum("n_stopped").cast("double").alias("value"))
              .select(F.lit("n_stopped").alias("series"), F.col(grain).cast("string").alias("x"),
                      grain_label(grain).alias("x_label"), "value"))
    metrics = {"total": F.sum("n_stopped")}
    for i, (s, e) in enumerate(eras, 1):
        c = ctx.in_window(s, e)
        metrics[f"avg_monthly_era{i}"] = ME.avg_monthly_expr(_sum_if(c, "n_stopped"), _quarters_if(c))
    k = kpi(by_quarter(d), metrics).select(F.col("metric").alias("series"), F.lit(None).cast("string").alias("x"),
                               F.lit(None).cast("string").alias("x_label"), "value")
    return trend.unionByName(k)


def r_time_slice(ctx: ReportCtx, start: str, end: str, location: str = "*") -> DataFrame:
    """R2: total and average per month in a quarter range."""
    d = ctx.window(ctx.loc(ctx.cube, location), start, end)
    return kpi(by_quarter(d), {"total": F.sum("n_stopped"),
                               "avg_monthly": ME.avg_monthly_expr(F.sum("n_stopped"), F.count("quarter"))})


def r_seasonal(ctx: ReportCtx, quarters: Sequence[str], location: str = "*",
               measure: str = "n_stopped") -> DataFrame:
    """Per-year sum over the chosen quarters, only for years that have all of them."""
    measure = ME.measure_of(measure)
    d = ctx.loc(ctx.cube, location).where(F.col("q_str").isin(list(quarters)))
    return (d.groupBy("year").agg(F.sum(measure).cast("long").alias(measure),
                                   F.countDistinct("q_str").alias("_nq"))
             .where(F.col("_nq") == len(quarters)).drop("_nq"))


def r_share_by_demo(ctx: ReportCtx, category: str, start=None, end=None,
                    location: str = "*", measure: str = "n_stopped") -> DataFrame:
    """Share of stops by one demographic category, enum-ordered."""
    measure = ME.measure_of(measure)
    d = ctx.window(ctx.loc(ctx.cube, location), start, end)
    g = ME.sums(d, [category], [measure])
    g = ME.share_of_total(g, measure, "percentage")
    order = RK.enum_order(F.col(category), ENUMS[category])
    return g.select(F.col(category).alias("member"), measure, "percentage",
                    order.alias("member_order"),
                    F.when(order.isNotNull(), F.initcap(F.col(category))).alias("label"))


def r_most_frequent(ctx: ReportCtx, start=None, end=None, location: str = "*",
                    measure: str = "n_stopped") -> DataFrame:
    """Ranked race x gender x age shares (rounded, > 0) and the top group."""
    measure = ME.measure_of(measure)
    d = ctx.window(ctx.loc(ctx.cube, location), start, end)
    keys = ["race", "gender", "age_range"]
    g = ME.sums(d, keys, [measure])
    g = ME.share_of_total(g, measure, "pct")
    top = F.row_number().over(Window.orderBy(F.col(measure).desc(), *[F.col(k) for k in keys]))
    return g.withColumn("is_top", top == 1).where(F.col("pct") > 0)


def r_cohorts(ctx: ReportCtx, group1: Mapping[str, Sequence[str]], group2: Mapping[str, Sequence[str]],
              start=None, end=None, location: str = "*") -> DataFrame:
    """Two demographic cohorts by quarter (a row may be in both)."""
    d = ctx.window(ctx.loc(ctx.cube, location), start, end)
    tags = [F.when(FL.demo_predicate(g["age_range"], g["gender"], g["race"]), F.lit(name))
            for name, g in (("Group 1", group1), ("Group 2", group2))]
    # one scan: a row in both cohorts is emitted twice
    u = d.withColumn("group", F.explode(F.array_compact(F.array(*tags))))
    return (ME.sums(u, ["group", "quarter"], C.STOP_MEASURES)
              .withColumn("season", TQ.year_season(F.col("quarter"))))


# ---------------------------------------------------------------------------
# snapshot
# ---------------------------------------------------------------------------

POP_COUNTS = ["total", "white", "black", "asian", "hispanic_or_latino", "american_indian", "unknown"]


def population_rollup(pop_psa: DataFrame, geographies: DataFrame, level: str = "district",
                      psa_key: str = "PSA_NUM") -> DataFrame:
    """Population per PSA joined to the PSA -> district -> division geography
    and summed per ``level`` (J7).  Both inputs are dimension tables (one row
    per PSA); the geography is broadcast."""
    g = F.broadcast(geographies.select(F.col("full_psa_num").alias("_psa"), F.col(level).alias(level)))
    j = pop_psa.join(g, pop_psa[psa_key] == g["_psa"], "left")
    return j.groupBy(level).agg(*[F.sum(c).cast("long").alias(c) for c in POP_COUNTS])


def population_by_race(population: DataFrame) -> DataFrame:
    """City population per model race (U5): other = american_indian + unknown."""
    tot = population.agg(*[F.sum(c).cast("long").alias(c) for c in
                           ("white", "black", "asian", "hispanic_or_latino", "american_indian", "unknown")])
    return tot.selectExpr(
        "stack(5, 'White', white, 'Black', black, 'Asian', asian, 'Latino', hispanic_or_latino, "
        "'All Other Races', american_indian + unknown) as (race, n_population)")


def r_snapshot(ctx: ReportCtx, last_n: int = 4, before=C.BEFORE_WINDOW,
               after=C.AFTER_WINDOW) -> DataFrame:
    """Last four quarters, miss rate, race shares vs population, before/after."""
    last = ctx.spine[-last_n:]
    in_last = F.col("quarter").isin(list(last))
    in_b, in_a = ctx.in_window(*before), ctx.in_window(*after)
    # only rows of the three windows matter (a race seen in none of them has
    # no stop row); naming their years lets a year-partitioned cube prune
    years = ctx.window_years((last[0], last[-1]), before, after)
    cube = ctx.cube.where(in_last | in_b | in_a)
    if years is not None:
        cube = cube.where(F.col("year").isin(years))
    k = kpi(by_quarter(cube, ["n_stopped", "n_contraband", "n_intruded"]), {
        "n_total": _sum_if(in_last, "n_stopped"),
        "avg_monthly": ME.avg_monthly_expr(_sum_if(in_last, "n_stopped"), _quarters_if(in_last)),
        "pct_not_found": (F.lit(1.0) - M.ratio(_sum_if(in_last, "n_contraband"),
                                               _sum_if(in_last, "n_intruded"))) * F.lit(100.0),
        "n_before": _sum_if(in_b, "n_stopped"),
        "n_after": _sum_if(in_a, "n_stopped"),
        "pct_decrease": M.round_even(M.ratio(_sum_if(in_b, "n_stopped") - _sum_if(in_a, "n_stopped"),
                                             _sum_if(in_b, "n_stopped")) * F.lit(100.0), 1),
    }).select(F.lit("kpi").alias("section"), F.lit(None).cast("string").alias("race"),
              "metric", "value")

    by_race = cube.groupBy("race").agg(
        _sum_if(in_last, "n_stopped").alias("n_last"),
        _sum_if(in_b, "n_stopped").alias("n_b"),
        _sum_if(in_a, "n_stopped").alias("n_a"))
    pop = population_by_race(ctx.population)
    # full alignment of stops and population by race (J5) as a union + one
    # aggregate: a full outer join cannot be broadcast and would sort-merge
    nul = F.lit(None).cast("long")
    u = by_race.select("race", "n_last", "n_b", "n_a", nul.alias("n_population")).unionByName(
        pop.select("race", nul.alias("n_last"), nul.alias("n_b"), nul.alias("n_a"),
                   F.col("n_population").cast("long")))
    j = u.groupBy("race").agg(*[F.max(c).alias(c) for c in ("n_last", "n_b", "n_a", "n_population")])
    w = Window.partitionBy()

    def share(c):
        return M.round_even(M.ratio(F.col(c), F.sum(c).over(w)) * F.lit(100.0), 1)

    wide = j.select(
        "race",
        share("n_last").alias("pct_stops"), share("n_population").alias("pct_population"),
        F.col("n_last").alias("n_traffic_stops"), "n_population",
        share("n_b").alias("pct_before"), share("n_a").alias("pct_after"),
        F.col("n_b").alias("n_before"), F.col("n_a").alias("n_after"),
        (F.col("n_b") - F.col("n_a")).alias("decrease"))
    cols = ["pct_stops", "pct_population", "n_traffic_stops", "n_population", "pct_before",
            "pct_after", "n_before", "n_after", "decrease"]
    melted = wide.select("race", *[F.col(c).cast("double") for c in cols]).unpivot(
        "race", cols, "metric", "value")
    return k.unionByName(melted.select(F.lit("race").alias("section"), "race", "metric", "value"))


# ---------------------------------------------------------------------------
# neighborhoods
# ---------------------------------------------------------------------------

def r_intrusions(ctx: ReportCtx, location: str = "*", grain: str = "year",
                 eras: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Intrusions and intrusion rate by grain; totals; per-era rates."""
    d = ctx.loc(ctx.cube, location)
    meas = FL.measure_columns(d)
    g = ME.sums(d, [grain], meas)
    rate = M.round_even(M.pct(F.col("n_intruded"), F.col("n_stopped")), 1)
    trend = g.select(F.col(grain).cast("string").alias("x"), grain_label(grain).alias("x_label"),
                     F.col("n_intruded").cast("double").alias("n_intruded"),
                     rate.alias("intrusion_rate"))
    trend = trend.unpivot(["x", "x_label"], ["n_intruded", "intrusion_rate"], "series", "value")
    metrics = {"num_total": F.sum("n_intruded"),
               "pct_total": M.round_even(M.ratio(F.sum("n_intruded") * F.lit(100.0), F.sum("n_stopped")), 1)}
    for i, (s, e) in enumerate(eras, 1):
        c, nq = ctx.in_window(s, e), float(ctx.n_quarters(s, e))
        v = F.try_divide(_sum_if(c, "n_intruded").cast("double"), F.lit(nq))
        vs = F.try_divide(_sum_if(c, "n_stopped").cast("double"), F.lit(nq))
        metrics[f"avg_monthly_era{i}"] = F.rint(F.try_divide(v, F.lit(3.0)))
        metrics[f"avg_monthly_stops_era{i}"] = F.rint(F.try_divide(vs, F.lit(3.0)))
        metrics[f"pct_era{i}"] = M.round_even(F.try_divide(v, vs) * F.lit(100.0), 1)
    k = kpi(d, metrics).select(F.lit(None).cast("string").alias("x"),
                               F.lit(None).cast("string").alias("x_label"),
                               F.col("metric").alias("series"), "value")
    return trend.unionByName(k)


def r_search_frisk(ctx: ReportCtx, location: str = "*", grain: str = "year") -> DataFrame:
    """Searches and frisks by grain, melted, each row carrying both rates."""
    d = ctx.loc(ctx.cube, location)
    g = ME.sums(d, [grain], ["n_frisked", "n_searched", "n_stopped"])
    g = g.select(F.col(grain).cast("string").alias("x"), grain_label(grain).alias("x_label"),
                 "n_frisked", "n_searched", "n_stopped",
                 M.round_even(M.pct_of(F.col("n_searched"), F.col("n_stopped")), 1)
                 .alias("search_rate"),
                 M.round_even(M.pct_of(F.col("n_frisked"), F.col("n_stopped")), 1)
                 .alias("frisk_rate"),
                 F.col("n_searched").alias("# of searches"), F.col("n_frisked").alias("# of frisks"))
    return g.unpivot(["x", "x_label", "n_frisked", "n_searched", "n_stopped", "search_rate",
                      "frisk_rate"], ["# of searches", "# of frisks"], "group", "total_count")


def r_baseline(ctx: ReportCtx, category: str, baseline: str | None = None, start=None, end=None,
               location: str = "*") -> DataFrame:
    """Intrusion rate, intrusions without contraband and hit rate per
    member, each against the baseline member (default per category:
    ``config.BASELINE_DEFAULTS``); empty when it is absent."""
    if baseline is None:
        baseline = C.BASELINE_DEFAULTS[category]
    d = ctx.window(ctx.loc(ctx.cube, location), start, end)
    g = ME.sums(d, [category], ["n_stopped", "n_intruded", "n_contraband"])
    m = F.col(category)
    rate = M.round_even(M.pct_of(F.col("n_intruded"), F.col("n_stopped")), 1)
    g = g.withColumn("percentage", rate)
    g = g.withColumn("no_contraband", F.greatest(F.col("n_intruded") - F.col("n_contraband"), F.lit(0)))
    pct_nf = F.lit(100.0) - M.ratio(F.col("n_contraband"), F.col("n_intruded")) * F.lit(100.0)
    g = g.withColumn("percentage_found",
                     F.coalesce(M.round_even(F.lit(100.0) - pct_nf, 1), F.lit(0.0)))
    w = Window.partitionBy()
    out = g.withColumn("_has", ME.has_member(m, baseline)).where(F.col("_has"))
    cols = [m.alias("member"), RK.enum_order(m, ENUMS[category]).alias("member_order"),
            "n_stopped", "n_intruded", "n_contraband"]
    for col, tag in (("percentage", ""), ("no_contraband", "nc_"), ("percentage_found", "found_")):
        b = ME.baseline_value(F.col(col), m, baseline)
        ratio = M.ratio(F.col(col), b)
        cols += [F.col(col), ratio.alias(f"{tag}multiplier"),
                 M.round_even(F.abs(ratio), 1).alias(f"{tag}multiplier_1dp"),
                 ME.baseline_status(m, baseline, F.col(col), b).alias(f"{tag}status")]
        if col == "percentage":
            cols.append(M.pct_of(F.col(col) - b, b).alias("percentage_diff"))
    cols += [(M.ratio(F.sum("n_intruded").over(w), F.sum("n_stopped").over(w)) * F.lit(100.0))
             .alias("total_rate"),
             ((F.lit(1.0) - M.ratio(F.sum("n_contraband").over(w), F.sum("n_intruded").over(w)))
              * F.lit(100.0)).alias("total_not_found")]
    return out.select(*cols)


def whiteness(population: DataFrame) -> DataFrame:
    """Percent white per district, rounded (districts with zero population drop)."""
    return population.select(
        "district", F.col("total").alias("n_people"),
        M.round_even(M.ratio(F.col("white"), F.col("total")) * F.lit(100.0), 1).alias("whiteness"))


def majority_split(population: DataFrame) -> DataFrame:
    """District -> 'Majority white' (> 0.5) / 'Majority non-white' (<= 0.5)."""
    share = M.ratio(F.col("white"), F.col("total"))
    return population.select(
        "district",
        F.when(share > 0.5, F.lit("Majority white"))
         .when(share <= 0.5, F.lit("Majority non-white")).alias("majority_district"))


def r_whiteness(ctx: ReportCtx, measure: str = "n_stopped", start=None, end=None) -> DataFrame:
    """Per district, ordered by whiteness, a measure and two rates with OLS lines."""
    measure = ME.measure_of(measure)
    d = ctx.window(ctx.cube, start, end)
    g = ME.sums(d, ["districtoccur"], FL.measure_columns(d)).where(
        F.col("districtoccur") != C.AIRPORT_DISTRICT)
    wh = F.broadcast(whiteness(ctx.population))
    j = g.join(wh, g.districtoccur == wh.district).drop("district").where(F.col("whiteness").isNotNull())
    j = j.select("districtoccur", "whiteness", "n_people", measure,
                 *[c for c in ("n_stopped", "n_intruded", "n_contraband") if c != measure],
                 M.round_even(M.pct(F.col("n_intruded"), F.col("n_stopped")), 1).alias("intrusion_rate"),
                 M.round_even(M.pct(F.col("n_intruded") - F.col("n_contraband"), F.col("n_intruded")), 1)
                 .alias("intrusion_miss_rate"),
                 M.round_even(M.pct(F.col("n_contraband"), F.col("n_intruded")), 1)
                 .alias("contraband_hit_rate"))
    for col in (measure, "intrusion_rate", "contraband_hit_rate"):
        j = ME.ols_fit(j, "whiteness", col, f"fit_{col}")
    return j


def r_compare_districts(ctx: ReportCtx, districts: Sequence[str], measure: str = "n_stopped",
                        start=None, end=None) -> DataFrame:
    """One value per requested location (district, PSA, division or ``*``),
    request order kept, missing -> 0; ``district`` is null where the location
    is none.  A window without rows is no error here."""
    measure = ME.measure_of(measure)
    spark = ctx.cube.sparkSession
    if isinstance(ctx.divisions, DataFrame):             # a dimension of a few rows
        members: dict[str, list[str]] = {}
        for r in ctx.divisions.select("division", "district").distinct().collect():
            members.setdefault(r["division"], []).append(r["district"])
    else:
        members = {k: list(v) for k, v in ctx.divisions.items()}
    req = []
    for i, x in enumerate(districts):
        kind, a, b = FL.parse_location(x, members)
        label = a if kind == "district" else None
        inside = sorted(set(members[a])) if kind == "division" else [a]
        req += [(i, label, m, b) for m in inside]
    req_df = spark.createDataFrame(req, "pos int, district string, _d string, _p string")
    # at most one row per (district, PSA) from here on
    g = (FL.filter_quarters(ctx.cube, ctx.spine, start, end).groupBy("districtoccur", "psa")
         .agg(F.sum(measure).cast("long").alias("_v")))
    hit = (F.col("_d").isNull() | (F.col("_d") == F.col("districtoccur"))) & (F.col("_p").isNull() | (F.col("_p") == F.col("psa")))
    got = g.join(F.broadcast(req_df), hit).groupBy("pos").agg(F.sum("_v").alias("_v"))
    return (req_df.select("pos", "district").distinct().join(F.broadcast(got), "pos", "left")
            .select("pos", "district", F.coalesce("_v", F.lit(0)).cast("long").alias(measure)))


# ---------------------------------------------------------------------------
# safety
# ---------------------------------------------------------------------------

def r_hin_points(ctx: ReportCtx) -> DataFrame:
    """The sampled stops of a build with their label, one row per stop
    and network line near it."""
    return ctx.hin_sample.select("*", F.when(F.col("on_hin"), F.lit("Traffic stop on the HIN"))
                                 .otherwise(F.lit("Traffic stop not on the HIN")).alias("hover_text"))


def r_map_extent(ctx: ReportCtx) -> DataFrame:
    """Centre of the map and the distinct years of the sample."""
    return ctx.hin_sample.agg(F.percentile("lat", 0.5).alias("median_lat"), F.percentile("lng", 0.5).alias("median_lng"),
                              F.count(F.lit(1)).alias("n_rows"), F.sort_array(F.collect_set("year")).alias("years"))


def r_hin(ctx: ReportCtx, location: str = "*", grain: str = "year", before=C.BEFORE_WINDOW,
          after=C.AFTER_WINDOW) -> DataFrame:
    """Percent of locatable stops on the network by grain; change of the
    ratio before vs after (city-wide)."""
    d = ctx.loc(ctx.hin_cube, location)
    g = ME.sums(d, [grain], C.HIN_MEASURES)
    trend = g.select(F.lit("pct_in_hin").alias("series"), F.col(grain).cast("string").alias("x"),
                     grain_label(grain).alias("x_label"),
                     M.round_even(M.pct_of(F.col("n_stopped_locatable_on_hin"),
                                           F.col("n_stopped_locatable")), 1).alias("value"))
    in_b, in_a = ctx.in_window(*before), ctx.in_window(*after)
    rb = M.ratio(_sum_if(in_b, "n_stopped_locatable_on_hin"), _sum_if(in_b, "n_stopped_locatable"))
    ra = M.ratio(_sum_if(in_a, "n_stopped_locatable_on_hin"), _sum_if(in_a, "n_stopped_locatable"))
    k = kpi(ctx.hin_cube, {"ratio_before": rb, "ratio_after": ra,
                           "pct_increase": M.round_even(M.pct_of(ra - rb, rb), 1)})
    return trend.unionByName(k.select(F.col("metric").alias("series"),
                                      F.lit(None).cast("string").alias("x"),
                                      F.lit(None).cast("string").alias("x_label"), "value"))


def compare_windows(ctx: ReportCtx, start: tuple[str, str], end: tuple[str, str],
                    decrease_col: str, increase_col: str) -> DataFrame:
    """Per district: stops and shootings in two windows, percent changes,
    ranks and top-5 flags (J3, J4, C9, W1-W3).

    Both windows come from one pass: stops of either window are summed per
    (quarter, district), joined once to the shooting cube, then summed per
    district with one conditional sum per window.  A district counts only if
    it has stops in the start window (the start-to-end left join); shootings
    of a window are 0 when the district has stops but no shootings there and
    null when it has no stops in that window.
    """
    sh = ctx.shootings_cube.select("quarter", "districtoccur", "n_shootings")
    in_s, in_e = ctx.in_window(*start), ctx.in_window(*end)
    years = ctx.window_years(start, end)
    cube = ctx.cube.where(in_s | in_e)
    if years is not None:
        cube = cube.where(F.col("year").isin(years))
    q = cube.groupBy("quarter", "districtoccur").agg(F.sum("n_stopped").alias("n_stopped"))
    q = q.join(sh, ["quarter", "districtoccur"], "left")

    def part(cond, tag):
        has = F.max(cond.cast("int")) == 1
        return [F.sum(F.when(cond, F.col("n_stopped"))).cast("long").alias(f"n_stopped_{tag}"),
                F.when(has, F.coalesce(F.sum(F.when(cond, F.col("n_shootings"))), F.lit(0)))
                 .cast("long").alias(f"n_shootings_{tag}")]

    j = (q.groupBy("districtoccur").agg(*part(in_s, "start"), *part(in_e, "end"))
          .where(F.col("n_stopped_start").isNotNull())
          .where(F.col("districtoccur") != C.AIRPORT_DISTRICT))
    for c in ("n_stopped", "n_shootings"):
        j = j.withColumn(f"_key_{c}", pct_change_key(F.col(f"{c}_start"), F.col(f"{c}_end")))
        j = j.withColumn(f"pct_change_{c}", M.pct_change(F.col(f"{c}_start"), F.col(f"{c}_end")))
    j = j.withColumn(f"ranked_{increase_col}_increase",
                     RK.rank_min_desc(F.col(f"_key_{increase_col}")).cast("long"))
    j = j.withColumn(f"ranked_{decrease_col}_decrease",
                     RK.rank_max_asc(F.col(f"_key_{decrease_col}")).cast("long"))
    j = j.withColumn("is_top_5_decrease",
                     F.coalesce(F.col(f"ranked_{decrease_col}_decrease") <= 5, F.lit(False)))
    j = j.withColumn("is_top_5_increase",
                     F.coalesce(F.col(f"ranked_{increase_col}_increase") <= 5, F.lit(False)))
    w = Window.partitionBy()
    j = j.withColumn("total_stopped_start", F.sum("n_stopped_start").over(w)) \
         .withColumn("total_stopped_end", F.sum("n_stopped_end").over(w))
    return j


def r_window_map(ctx: ReportCtx, start, end, decrease_col: str, increase_col: str,
                 k: int = 5) -> DataFrame:
    """The k most increased and the k most decreased districts (duplicates
    kept).  Both orders are ranked over the one frame of at most a row per
    district; a district in both comes out twice."""
    j = compare_windows(ctx, start, end, decrease_col, increase_col)
    inc = F.row_number().over(Window.orderBy(F.col(f"_key_{increase_col}").desc_nulls_last(), "districtoccur"))
    dec = F.row_number().over(Window.orderBy(F.col(f"_key_{decrease_col}").asc_nulls_last(), "districtoccur"))
    out = (j.withColumn("_inc", inc).withColumn("_dec", dec)
            .withColumn("source", F.explode(F.array_compact(F.array(
                F.when(F.col("_dec") <= k, F.lit("most_decreased")),
                F.when(F.col("_inc") <= k, F.lit("most_increased")))))))
    return out.drop("_inc", "_dec", *[c for c in out.columns if c.startswith("_key_")])


# ---------------------------------------------------------------------------
# reasons
# ---------------------------------------------------------------------------

def _year_window(year: int) -> tuple[str, str]:
    return (f"{year}-01-01", f"{year}-12-31")


def _display_order(group_col: str, first: str) -> Column:
    """O2: the chosen group first, then the largest counts (ties by reason)."""
    return F.row_number().over(Window.orderBy(
        F.when(F.col(group_col) == F.lit(first), 0).otherwise(1), F.col("n_stopped").desc(),
        F.col(group_col), F.col("violation_category")))


def r_reason_by_race(ctx: ReportCtx, year: int, races=("White", "Black"),
                     first: str = "Black") -> DataFrame:
    """Reason shares for two races (Other/None excluded)."""
    d = FL.exclude_categories(ctx.window(ctx.reason_cube, *_year_window(year)), ["Other", "None"])
    g = ME.sums(d, ["race", "violation_category"], ["n_stopped"]).where(F.col("race").isin(list(races)))
    return ME.share_within(g, "n_stopped", "race").withColumn("display_order", _display_order("race", first))


def r_reason_by_area(ctx: ReportCtx, year: int, first: str = "Majority non-white") -> DataFrame:
    """Reason shares in majority-white vs other districts."""
    d = FL.exclude_categories(ctx.window(ctx.reason_cube, *_year_window(year)), ["Other", "None"])
    ms = F.broadcast(majority_split(ctx.population).where(F.col("majority_district").isNotNull()))
    j = d.join(ms, d.districtoccur == ms.district)
    g = ME.sums(j, ["violation_category", "majority_district"], ["n_stopped"])
    return ME.share_within(g, "n_stopped", "majority_district").withColumn(
        "display_order", _display_order("majority_district", first))


def r_covered_reasons(ctx: ReportCtx, start, end, grain: str = "quarter") -> DataFrame:
    """Stops for the covered reasons by grain."""
    d = FL.keep_categories(ctx.window(ctx.reason_cube, start, end), C.COVERED_CATEGORIES)
    g = ME.sums(d, [grain, "violation_category"], ["n_stopped"])
    return g.select(F.col(grain).cast("string").alias("x"), grain_label(grain).alias("x_label"),
                    "violation_category", "n_stopped")


def r_operational(ctx: ReportCtx, year: int) -> DataFrame:
    """R16d: percent of each race's stops made for operational reasons."""
    d = ctx.window(ctx.reason_cube, *_year_window(year))
    op = F.col("violation_category").isin(C.OPERATIONAL_CATEGORIES)
    g = d.groupBy("race").agg(_sum_if(op, "n_stopped").alias("n_operational"),
                              F.sum("n_stopped").alias("n_stopped"))
    return g.select("race", RK.enum_order(F.col("race"), C.RACE_ORDER).alias("member_order"),
                    F.col("n_operational").cast("long").alias("n_operational"),
                    F.col("n_stopped").cast("long").alias("n_stopped"),
                    M.round_even(M.pct(F.col("n_operational"), F.col("n_stopped")), 1)
                    .alias("pct_operational"))
