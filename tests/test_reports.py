"""Filters, metrics and reports on a tiny hand-made cube."""
import pytest
from pyspark.sql import functions as F

from cubewright import config as C
from cubewright.functions import timeq as TQ
from cubewright.operators import filters as FL
from cubewright.operators import metrics as ME
from cubewright.operators import rank as RK
from cubewright.plans import reports as RP

SPINE = TQ.quarters_between_py("2020-Q1", "2021-Q4")
COLS = ["districtoccur", "psa", "quarter", "race", "gender", "age_range"] + C.STOP_MEASURES


def cube(spark, rows):
    full = [r + (0,) * (len(COLS) - len(r)) for r in rows]
    return TQ.add_calendar(spark.createDataFrame(full, ", ".join(
        f"{c} string" if i < 6 else f"{c} long" for i, c in enumerate(COLS))))


def ctx(spark, rows, pop=None):
    c = cube(spark, rows)
    pop = pop or spark.createDataFrame(
        [("12", 100, 60, 20, 10, 5, 5, 0), ("22", 100, 10, 70, 10, 5, 5, 0)],
        "district string, total long, white long, black long, asian long, "
        "hispanic_or_latino long, american_indian long, unknown long")
    return RP.ReportCtx({"cube": c, "reason_cube": c.withColumn("violation_category", F.lit("Lights")),
                         "hin_cube": c, "shootings_cube": c, "population": pop},
                        C.DIVISION_DISTRICTS, SPINE)


def test_location_filter(spark):
    c = cube(spark, [("12", "1", "2020-Q1", "Black", "Male", "25-34", 1),
                     ("12", "2", "2020-Q1", "Black", "Male", "25-34", 2),
                     ("25", "1", "2020-Q1", "Black", "Male", "25-34", 4)])
    tot = lambda d: d.agg(F.sum("n_stopped")).collect()[0][0]  # noqa
    assert tot(FL.filter_location(c, "12*")) == 3
    assert tot(FL.filter_location(c, "12-2")) == 2
    assert tot(FL.filter_location(c, "NEPD")) == 4 and tot(FL.filter_location(c, "EPD")) == 4
    assert FL.filter_location(c, "zz").count() == 0
    with pytest.raises(ValueError):
        FL.filter_location(c, "")


def test_quarter_window_semantics():
    assert FL.window_quarters(SPINE) is None
    assert FL.window_quarters(SPINE, "2020-Q3") == SPINE          # one bound: whole spine
    assert FL.window_quarters(SPINE, "2020-04-01", "2020-12-31") == ["2020-Q2", "2020-Q3", "2020-Q4"]


def test_seasonal_missing_quarter(spark):
    c = ctx(spark, [("12", "1", "2020-Q1", "Black", "Male", "25-34", 5),
                    ("12", "1", "2020-Q3", "Black", "Male", "25-34", 7),
                    ("12", "1", "2021-Q1", "Black", "Male", "25-34", 9)])
    got = RP.r_seasonal(c, ["Q1", "Q3"]).collect()
    assert [(r["year"], r["n_stopped"]) for r in got] == [(2020, 12)]
    assert RP.r_seasonal(c, ["Q1", "Q1"]).count() == 0


def test_overlapping_cohorts_counted_twice(spark):
    c = ctx(spark, [("12", "1", "2020-Q1", "Black", "Male", "25-34", 5)])
    g = {"age_range": ["25-34"], "gender": ["Male"], "race": ["Black"]}
    got = RP.r_cohorts(c, g, g).collect()
    assert sorted((r["group"], r["n_stopped"]) for r in got) == [("Group 1", 5), ("Group 2", 5)]


def test_compare_list_keeps_order_and_zero(spark):
    c = ctx(spark, [("12", "1", "2020-Q1", "Black", "Male", "25-34", 5)])
    got = RP.r_compare_districts(c, ["12", "zz"], "n_stopped", "2020-Q1", "2021-Q4").orderBy("pos")
    assert [(r["district"], r["n_stopped"]) for r in got.collect()] == [("12", 5), ("zz", 0)]


def test_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, None), (5, 1.0)], "k int, v double")
    got = {r["k"]: (r["mn"], r["mx"]) for r in df.select(
        "k", RK.rank_min_desc(F.col("v")).alias("mn"), RK.rank_max_asc(F.col("v")).alias("mx")).collect()}
    assert got == {1: (1, 4), 2: (1, 4), 3: (1, 4), 4: (None, None), 5: (4, 1)}


def test_baseline_absent_gives_nothing(spark):
    c = ctx(spark, [("12", "1", "2020-Q1", "Black", "Male", "25-34", 5, 0, 0, 0, 0, 0, 2)])
    assert RP.r_baseline(c, "gender", "Female").count() == 0
    r = RP.r_baseline(c, "gender", "Male").collect()[0]
    assert r["status"] == "Baseline" and r["percentage"] == 40.0


def test_baseline_zero_and_above(spark):
    c = ctx(spark, [("12", "1", "2020-Q1", "Black", "Male", "25-34", 5, 0, 0, 0, 0, 0, 2),
                    ("12", "1", "2020-Q1", "Black", "Female", "25-34", 5, 0, 0, 0, 0, 0, 0)])
    got = {r["member"]: r["status"] for r in RP.r_baseline(c, "gender", "Female").collect()}
    assert got == {"Female": "Baseline", "Male": "above"}


def test_share_sums_to_100(spark):
    c = ctx(spark, [("12", "1", "2020-Q1", r, "Male", "25-34", n)
                    for r, n in [("Black", 3), ("White", 3), ("Asian", 1), ("Other", 2)]])
    s = RP.r_share_by_demo(c, "race").collect()
    assert abs(sum(r["percentage"] for r in s) - 100.0) < 0.3
    assert {r["member"]: r["member_order"] for r in s}["Other"] is None


def test_avg_monthly_present_vs_calendar(spark):
    c = cube(spark, [("12", "1", "2020-Q1", "Black", "Male", "25-34", 30),
                     ("12", "1", "2020-Q3", "Black", "Male", "25-34", 30)])
    d = FL.filter_quarters(c, SPINE, "2020-Q1", "2020-Q4")
    assert ME.avg_monthly(d, "n_stopped").collect()[0]["value"] == 10        # 60 / 2 / 3
    assert ME.avg_monthly_calendar(d, "n_stopped", 4).collect()[0]["value"] == 5  # 60 / 4 / 3


def test_whiteness_ols_and_majority(spark):
    c = ctx(spark, [("12", "1", "2020-Q1", "Black", "Male", "25-34", 10, 0, 0, 0, 1, 0, 2),
                    ("22", "1", "2020-Q1", "Black", "Male", "25-34", 10, 0, 0, 0, 3, 0, 6),
                    ("77", "1", "2020-Q1", "Black", "Male", "25-34", 10)])
    w = {r["districtoccur"]: r for r in RP.r_whiteness(c, "n_stopped").collect()}
    assert set(w) == {"12", "22"} and w["12"]["whiteness"] == 60.0
    assert w["22"]["fit_intrusion_rate"] == 60.0 and w["12"]["fit_intrusion_rate"] == 20.0
    ms = {r["district"]: r["majority_district"] for r in RP.majority_split(c.population).collect()}
    assert ms == {"12": "Majority white", "22": "Majority non-white"}


def test_strict_window_raises_on_empty(spark):
    c = ctx(spark, [("12", "1", "2020-Q1", "Black", "Male", "25-34", 5)])
    c.strict = True
    with pytest.raises(ValueError):
        RP.r_time_slice(c, "2021-Q1", "2021-Q2")
    assert RP.r_time_slice(c, "2020-Q1", "2020-Q1").count() == 2


def test_cli_report_roundtrip(spark, tmp):
    import json as _json
    from cubewright.plans import run
    from cubewright.sources import sinks as SK
    c = cube(spark, [("12", "1", "2020-Q1", "Black", "Male", "25-34", 5)])
    r = c.withColumn("violation_category", F.lit("Lights"))
    SK.write_tables({"stop_cube": c, "stop_cube_reason": r, "hin_cube": c, "shootings_cube": c}, f"{tmp}/t")
    spark.range(1).select(F.lit("2021-Q4").alias("most_recent_quarter")).write.parquet(f"{tmp}/t/settings")
    with open(f"{tmp}/pop.csv", "w") as fh:
        fh.write("district,total,white,black,asian,hispanic_or_latino,american_indian,unknown\n12,10,5,5,0,0,0,0\n")
    run.main(["report", "--tables", f"{tmp}/t", "--population", f"{tmp}/pop.csv", "--name", "r_time_slice",
              "--params", _json.dumps({"start": "2020-Q1", "end": "2020-Q4"}),
              "--first-quarter", "2020-Q1", "--out", f"{tmp}/o"])
    got = {r["metric"]: r["value"] for r in spark.read.json(f"{tmp}/o/r_time_slice").collect()}
    assert got == {"total": 5.0, "avg_monthly": 2.0}


def test_chart_rows_and_documents(spark):
    import json as _json
    from cubewright.sources import sinks as SK
    c = ctx(spark, [("12", "1", "2020-Q1", "Black", "Male", "25-34", 10, 0, 0, 0, 1, 0, 2),
                    ("22", "1", "2020-Q1", "Black", "Male", "25-34", 10, 0, 0, 0, 3, 0, 6)])
    w = RP.r_whiteness(c, "n_stopped")
    rows = SK.chart_rows(w, "intrusion_rate", "districtoccur", "intrusion_rate", trend="fit_intrusion_rate",
                         extra=["whiteness"])
    got = sorted((r["kind"], r["x"], r["y"]) for r in rows.collect())
    assert got == [("data", "12", 20.0), ("data", "22", 60.0), ("trendline", "12", 20.0), ("trendline", "22", 60.0)]
    doc = _json.loads(SK.figure_documents(rows, {"intrusion_rate": "Intrusion rate"}).collect()[0]["document"])
    assert doc["title"] == "Intrusion rate" and len(doc["data"]) == 2 and len(doc["trendlines"]) == 2


def test_compare_windows_edges(spark):
    rows = [("12", "1", "2020-Q1", "Black", "Male", "25-34", 10),   # start and end
            ("12", "1", "2021-Q1", "Black", "Male", "25-34", 20),
            ("22", "1", "2020-Q1", "Black", "Male", "25-34", 5),    # start only
            ("25", "1", "2021-Q1", "Black", "Male", "25-34", 7),    # end only -> lost
            ("77", "1", "2020-Q1", "Black", "Male", "25-34", 9),    # airport -> dropped
            ("77", "1", "2021-Q1", "Black", "Male", "25-34", 9)]
    sh = spark.createDataFrame([("2021-Q1", "12", 3), ("2020-Q1", "22", 0)],
                               "quarter string, districtoccur string, n_shootings long")
    c = ctx(spark, rows)
    c._built["shootings_cube"] = sh
    j = RP.compare_windows(c, ("2020-01-01", "2020-12-31"), ("2021-01-01", "2021-12-31"),
                           "n_shootings", "n_stopped")
    got = {r["districtoccur"]: r for r in j.collect()}
    assert set(got) == {"12", "22"}
    a, b = got["12"], got["22"]
    assert (a["n_stopped_start"], a["n_stopped_end"], a["pct_change_n_stopped"]) == (10, 20, 100.0)
    # shootings grew from 0 to 3: change is null (+Inf) but ranks first for an increase
    assert a["n_shootings_start"] == 0 and a["n_shootings_end"] == 3
    assert a["pct_change_n_shootings"] is None
    assert b["n_stopped_end"] is None and b["n_shootings_end"] is None
    assert a["ranked_n_stopped_increase"] == 1 and b["ranked_n_stopped_increase"] is None
    # decrease ranking (max method, ascending) on shootings: 12 is +inf -> rank 1 of 1
    assert a["ranked_n_shootings_decrease"] == 1 and b["ranked_n_shootings_decrease"] is None
    assert a["is_top_5_increase"] and not b["is_top_5_increase"]


def test_action_names_select_measures(spark):
    c = ctx(spark, [("12", "1", "2020-Q1", "Black", "Male", "25-34", 5, 0, 0, 0, 0, 3, 0)])
    a = RP.r_compare_districts(c, ["12"], "frisk", "2020-Q1", "2020-Q4").collect()[0]
    assert a["n_frisked"] == 3


def test_population_rollup_and_races(spark):
    pop = spark.createDataFrame(
        [("011", 100, 10, 50, 5, 20, 3, 2, 10), ("012", 50, 5, 20, 5, 10, 1, 1, 8),
         ("221", 80, 30, 20, 10, 10, 0, 0, 10), ("077", 0, 0, 0, 0, 0, 0, 0, 0)],
        "PSA_NUM string, total long, hispanic_or_latino long, white long, black long, american_indian long, "
        "asian long, unknown long, x long").drop("x")
    geo = spark.createDataFrame([("011", "1", "01", "SPD"), ("012", "2", "01", "SPD"), ("221", "1", "22", "CPD"),
                                 ("077", "7", "77", "SWPD")], "full_psa_num string, psa string, district string, division string")
    d = {r["district"]: (r["total"], r["white"]) for r in RP.population_rollup(pop, geo, "district").collect()}
    assert d == {"01": (150, 70), "22": (80, 20), "77": (0, 0)}
    v = {r["division"]: r["total"] for r in RP.population_rollup(pop, geo, "division").collect()}
    assert v == {"SPD": 150, "CPD": 80, "SWPD": 0}
    races = {r["race"]: r["n_population"] for r in RP.population_by_race(
        RP.population_rollup(pop, geo, "district")).collect()}
    assert races == {"White": 90, "Black": 20, "Asian": 4, "Latino": 45, "All Other Races": 43}
    w = {r["district"]: r["whiteness"] for r in RP.whiteness(RP.population_rollup(pop, geo)).collect()}
    assert w == {"01": 46.7, "22": 25.0, "77": None}     # zero population -> no share


def test_ctx_from_written_build(spark, tmp):
    from cubewright.plans import build as BL
    sf = "/root/testdata/sf0.001"
    BL.write_build(BL.build_analog(spark, sf), f"{tmp}/b", "2000-Q4", gate=False)
    from cubewright.sources import analog as A
    c = RP.ReportCtx.from_tables(spark, f"{tmp}/b", divisions=A.division_map(spark, sf),
                                 first_quarter="1995-Q1", cache=True)
    assert c.spine[0] == "1995-Q1" and c.spine[-1] == "2000-Q4"
    assert RP.r_time_slice(c, "1997-Q1", "1997-Q4", location="ASIA").count() == 2


def test_baseline_default_member(spark):
    c = ctx(spark, [("12", "1", "2020-Q1", "Black", "Male", "25-34", 5, 0, 0, 0, 0, 0, 2),
                    ("12", "1", "2020-Q1", "Black", "Female", "25-34", 5, 0, 0, 0, 0, 0, 1)])
    got = {r["member"]: r["status"] for r in RP.r_baseline(c, "gender").collect()}
    assert got == {"Female": "Baseline", "Male": "ratio"}


def test_tables_let_a_location_skip_row_groups(spark, tmp):
    """Row groups of a written table hold narrow ranges of places: a location
    leaves few of them; the rows are the same."""
    from cubewright.sources import sinks as SK
    df = spark.sql("""select lpad(cast(pmod(id * 37, 25) as string), 2, '0') as districtoccur, cast(pmod(id, 4) as string) as psa,
                      concat('202', pmod(id, 2), '-Q', 1 + pmod(id, 4)) as quarter, int(2020 + pmod(id, 2)) as year, id as n_stopped from range(40000)""").repartition(4)
    spark.conf.set("parquet.block.size", "8192")
    spark.conf.set("parquet.page.size", "1024")
    try:
        SK.write_tables({"t": df}, tmp)
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("parquet.page.size")
    assert sorted(map(tuple, SK.read_table(spark, tmp, "t").select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    g = SK.row_groups(spark, tmp, "t").where("column = 'districtoccur'")
    n, left = g.count(), g.where("least <= '07' and most >= '07'").count()
    assert n >= 24 and left <= 0.4 * n


def test_quarter_sets_merge(spark):
    """Averages over merged sets equal those over the rows, whichever parts hold
    a quarter."""
    from cubewright.operators import metrics as ME
    rows = [(d, f"{2014 + i % 11}-Q{1 + i * 7 % 4}", i) for i in range(300) for d in ("01", "02")[: 1 + i % 2]]
    df = spark.createDataFrame(rows, "d string, quarter string, n long")
    parts = [ME.quarter_sets(df.where(F.col("n") % 5 == i), ["d"], ["n"]) for i in range(5)]
    got = {r["d"]: r["value"] for r in ME.avg_monthly_of_sets(ME.merge_quarter_sets(parts, ["d"], ["n"]), "n").collect()}
    assert got == {d: ME.avg_monthly(df.where(F.col("d") == d), "n").first()["value"] for d in ("01", "02")}
