"""Person -> stop collapse and cube traps (FIXTURES.md §2)."""
import datetime as dt

import pytest

from pyspark.sql import functions as F

from cubewright.operators import collapse as CO
from cubewright.operators import cube as CU
from helpers import ORDER, STOP_KEY, frame, person


def stops(spark, rows, n_parts=1):
    df = frame(spark, rows).repartition(n_parts)
    return CO.classify_stops(CO.collapse_stops(df, ORDER, STOP_KEY))


def cube(spark, rows, mrq="2022-Q4"):
    return CU.stop_cube_reason(stops(spark, rows), mrq)


def test_two_people_one_stop_driver_is_first_row(spark):
    rows = [person(0, age=40.0, race="White - Non-Latino"), person(1, age=20.0, race="Asian")]
    s = stops(spark, rows).collect()
    assert len(s) == 1
    assert s[0]["n_people_in_car"] == 2
    assert s[0]["age_range"] == "35-44"
    assert s[0]["race"] == "White"


def test_driver_independent_of_partitioning(spark):
    rows = [person(i, age=float(20 + i), location=f"L{i % 3}") for i in range(60)]
    a = {(r["location"], r["age_range"]) for r in stops(spark, rows, 1).collect()}
    b = {(r["location"], r["age_range"]) for r in stops(spark, list(reversed(rows)), 7).collect()}
    assert a == b == {("L0", "Under 25"), ("L1", "Under 25"), ("L2", "Under 25")}


def test_null_location_forms_no_stop(spark):
    assert stops(spark, [person(0, location=None)]).count() == 0


def test_pedestrian_ignored(spark):
    s = stops(spark, [person(0, age=40.0), person(1, stoptype="pedestrian", age=20.0,
                                                  isearch=1.0)]).collect()
    assert len(s) == 1 and s[0]["n_people_in_car"] == 1 and s[0]["was_searched"] == 0


def test_null_psa_or_gender_absent_from_cube(spark):
    c = cube(spark, [person(0, location="A", psa=None), person(0, location="B", gender=None),
                     person(0, location="C")])
    assert c.agg(F.sum("n_stopped")).collect()[0][0] == 1


def test_null_age_is_65_plus(spark):
    assert stops(spark, [person(0, age=None)]).collect()[0]["age_range"] == "65+"


def test_flags_all_null_are_zero(spark):
    s = stops(spark, [person(0, isearch=None, vsearch=None, ifrisk=None, vfrisk=None,
                             arrest=None, icontra=None, vcontra=None)]).collect()[0]
    assert (s["was_searched"], s["was_frisked"], s["was_intruded"], s["was_arrested"],
            s["was_found_with_contraband"]) == (0, 0, 0, 0, 0)


def test_search_by_one_frisk_by_other(spark):
    s = stops(spark, [person(0, isearch=1.0), person(1, ifrisk=1.0)]).collect()[0]
    assert (s["was_searched"], s["was_frisked"], s["was_intruded"]) == (1, 1, 1)


def test_codes(spark):
    rows = [person(0, location="a", code="1332-a-i"), person(0, location="b", code="1332-A-I"),
            person(0, location="c", code=None), person(0, location="d", code="-"),
            person(0, location="e", code="4524-(a)"), person(0, location="f", code="4524-e")]
    got = {r["location"]: r["violation_category"] for r in stops(spark, rows).collect()}
    assert got == {"a": "Display License Plate", "b": "Other", "c": "None", "d": "Other",
                   "e": "Windshield Obstruction", "f": "Tint"}


def test_max_code_per_stop(spark):
    s = stops(spark, [person(0, code="3111"), person(1, code="4703-a")]).collect()[0]
    assert s["violation_category"] == "Inspection/Emission Sticker"


def test_utc_to_local_quarter(spark):
    s = stops(spark, [person(0, ts=dt.datetime(2021, 1, 1, 3, 0))]).collect()[0]
    assert s["quarter"] == "2020-Q4"


def test_cutoff_keeps_last_quarter_only(spark):
    rows = [person(0, location="a", ts=dt.datetime(2022, 12, 31, 12, 0)),
            person(0, location="b", ts=dt.datetime(2023, 1, 1, 12, 0))]
    c = cube(spark, rows, "2022-Q4").collect()
    assert [r["quarter"] for r in c] == ["2022-Q4"]


def test_rollup_and_merge_invariants(spark):
    rows = [person(i, location=f"L{i % 5}", race=["Asian", "Unknown"][i % 2],
                   code=["3111", "4303", None][i % 3], age=float(18 + 3 * i)) for i in range(40)]
    r = cube(spark, rows)
    c = CU.stop_cube(r)
    tot = lambda d: d.agg(F.sum("n_stopped"), F.sum("n_people_in_stopped_vehicles")).collect()[0]  # noqa
    assert tot(r) == tot(c)
    half1 = r.where(F.col("race") == "Asian")
    half2 = r.where(F.col("race") != "Asian")
    keys = ["districtoccur", "psa", "quarter", "race", "gender", "age_range", "violation_category"]
    meas = ["n_stopped", "n_searched"]
    a = CU.merge_cubes([half1, half2], keys, meas)
    b = CU.merge_cubes([CU.merge_cubes([half2], keys, meas), half1], keys, meas)
    assert sorted(a.collect()) == sorted(b.collect())


def test_shootings_cube_padding(spark):
    from pyspark.sql import types as T
    sch = T.StructType([T.StructField("date_", T.TimestampType()), T.StructField("dist", T.StringType()),
                        T.StructField("inside", T.DoubleType())])
    ts = dt.datetime(2022, 5, 1, 12)
    df = spark.createDataFrame([(ts, None, 0.0), (ts, "9", None), (ts, "09", 1.0)], sch)
    got = {r["districtoccur"]: (r["n_shootings"], r["n_outside"])
           for r in CU.shootings_cube(df, "2022-Q4").collect()}
    assert got == {"00": (1, 1), "09": (2, 0)}


def test_seed_total_gate(spark):
    import pytest
    c = cube(spark, [person(0, location="a"), person(0, location="b")])
    CU_check = __import__("cubewright.operators.quality", fromlist=["check_total"]).check_total
    CU_check(c, "n_stopped", 2)
    with pytest.raises(ValueError):
        CU_check(c, "n_stopped", 3, where=F.col("year") < 2024)


def test_stops_by_codes_equal_the_string_aggregate(spark, tmp, monkeypatch):
    """Rows, types and order of columns; nulls, empty strings, ties of place
    across files, codes that differ in a suffix; a hash aggregate; a value
    without a code fails; too many values are not coded."""
    import random
    from cubewright.operators import collapse as CO
    rng = random.Random(4)
    rows = []
    for i in range(900):
        f = i % 3
        rows.append((f"file:/a/{f}.csv", (i // 300) * 4096, ((5 - i // 300) << 33) + i % 300 if f else i, f"2021-0{1 + i % 3}-01 1{i % 10}:00:00", rng.choice(["A", "B", "C", None]),
                     rng.choice(["vehicle", "vehicle", "pedestrian", None]), rng.choice(["09", "9", "10", None, ""]), rng.choice(["1", "2", None]),
                     rng.choice(["Asian", "White - Latino", "Odd", None]), rng.choice(["Male", "Female", None]), rng.choice([17.0, 25.0, 61.5, None]),
                     rng.choice([0.0, 1.0, None]), rng.choice(["3111", "3111-(a)", "1332-a-i", "1332-A-I", "9999", "", None])))
    cols = "file string, start long, row long, datetimeoccur string, location string, stoptype string, districtoccur string, psa string, race string, gender string, age double, individual_searched double, mvc_code string"
    raw = spark.createDataFrame(rows, cols).withColumn("datetimeoccur", F.to_timestamp("datetimeoccur"))
    raw.select(F.struct("file", "start", "row").alias("_ordinal"), F.col("file").alias("_file"), *[c for c in raw.columns if c not in ("file", "start", "row")]).write.parquet(f"{tmp}/p")
    p = spark.read.parquet(f"{tmp}/p")
    key = ("_file", "datetimeoccur", "location")
    want = CO.classify_stops(CO.collapse_stops(p, ["_ordinal"], key))
    codes = CO.find_codes(p)
    got = CO.coded_stops(p, codes, key)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    members = p.withColumn("_ordinal", F.struct(F.col("_ordinal.file").alias("file"), (F.col("_ordinal.start") * 1000 + F.col("_ordinal.row")).alias("row")))
    assert sorted(map(str, CO.coded_stops(members, codes, key).collect())) == sorted(map(str, CO.classify_stops(CO.collapse_stops(members, ["_ordinal"], key)).collect()))
    with pytest.raises(Exception, match="no code"):
        CO.coded_stops(p.withColumn("psa", F.lit("unheard of")), codes, key).collect()
    monkeypatch.setattr(CO, "MAX_CODES", 3)
    assert CO.find_codes(p) is None
