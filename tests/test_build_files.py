"""End-to-end build over the real file layout (FIXTURES.md §5)."""
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from cubewright.plans import build as BL
from cubewright.sources import schemas as SC
from cubewright.sources import sinks as SK

PCOLS = [f.name for f in SC.PERSONS.fields]
HCOLS = [f.name for f in SC.PERSONS_ON_HIN.fields]
SCOLS = [f.name for f in SC.SHOOTINGS.fields]


def geom(x, y):
    return struct.pack("<BIIdd", 1, 1 | 0x20000000, 4326, x, y).hex()


def prow(cols, **kv):
    return ",".join("" if kv.get(c) is None else str(kv[c]) for c in cols)


def write_csv(path, cols, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(",".join(cols) + "\n" + "\n".join(rows) + "\n")


def person(**kv):
    base = dict(stoptype="vehicle", districtoccur="12", psa="1", race="Asian", gender="Male",
                age=30, mvc_code="3111", datetimeoccur="2022-05-01T12:00:00Z", location="L")
    base.update(kv)
    return base


@pytest.fixture
def layout(tmp):
    root = f"{tmp}/csvs"
    stops = [
        person(location="a", age=40), person(location="a", age=20),          # one stop, 2 people
        person(location="b", districtoccur="06", the_geom=geom(0.1, 0.1)),   # 06 -> 09, PSA 092 -> '2'
        person(location="c", districtoccur="06"),                             # no point -> null psa
        person(location="d", districtoccur="09", the_geom=geom(5.0, 5.0)),   # outside -> '-1'
        person(location="e", stoptype="pedestrian"),
        person(location="f", datetimeoccur="2023-01-01T12:00:00Z"),           # after the quarter
        person(location="k", districtoccur="22", datetimeoccur="2022-11-01T12:00:00Z"),
    ]
    write_csv(f"{root}/car_ped_stops/car_ped_stops_year_2022.csv", PCOLS, [prow(PCOLS, **r) for r in stops])
    write_csv(f"{root}/car_ped_stops/car_ped_stops_year_2021.csv", PCOLS,
              [prow(PCOLS, **person(location="g", datetimeoccur="2021-01-01T03:00:00Z"))])
    hin = [dict(person(location="h"), n_stopped_locatable=1, n_stopped_locatable_on_hin=1)]
    write_csv(f"{root}/car_ped_stops_on_hin/car_ped_stops_on_hin_year_2022.csv", HCOLS,
              [prow(HCOLS, **r) for r in hin])
    sh = [dict(date_="2022-11-01T12:00:00Z", dist="6", inside=0.0), dict(date_="2022-11-01T12:00:00Z", dist=None)]
    write_csv(f"{root}/shootings/shootings_year_2022.csv", SCOLS, [prow(SCOLS, **r) for r in sh])
    for t in ("car_ped_stops", "car_ped_stops_on_hin", "shootings"):
        with open(f"{root}/{t}/summary.json", "w") as fh:
            json.dump({"last_dt": "2023-01-05"}, fh)
    feats = [{"type": "Feature", "properties": {"PSA_NUM": "092"}, "geometry": {
        "type": "Polygon", "coordinates": [[[0, 0], [0.25, 0], [0, 0.25], [0, 0]]]}}]
    with open(f"{tmp}/psa.geojson", "w") as fh:
        json.dump({"type": "FeatureCollection", "features": feats}, fh)
    return root, f"{tmp}/psa.geojson"


def test_build_from_files(spark, tmp, layout):
    root, psa_map = layout
    t = BL.build_from_files(spark, root, f"{tmp}/out", psa_map=psa_map)
    r = t["stop_cube_reason"]
    got = {(x["districtoccur"], x["psa"], x["quarter"]): (x["n_stopped"], x["n_people_in_stopped_vehicles"])
           for x in r.collect()}
    assert got == {("12", "1", "2022-Q2"): (1, 2), ("09", "2", "2022-Q2"): (1, 1),
                   ("09", "-1", "2022-Q2"): (1, 1), ("12", "1", "2020-Q4"): (1, 1),
                   ("22", "1", "2022-Q4"): (1, 1)}
    a = r.where(F.col("quarter") == "2022-Q2").where(F.col("districtoccur") == "12").collect()[0]
    assert a["age_range"] == "35-44"                      # driver = first row of the file
    s = {x["districtoccur"]: x["n_shootings"] for x in t["shootings_cube"].collect()}
    assert s == {"09": 1, "00": 1}
    assert t["hin_cube"].agg(F.sum("n_stopped_locatable_on_hin")).collect()[0][0] == 1
    assert spark.read.parquet(f"{tmp}/out/settings").collect()[0][0] == "2022-Q4"
    q = t["quality_unknown_geometry"].collect()[0]
    assert (q["n_unknown"], q["n_rows"]) == (1, 9)          # "c": the only row without a PSA


def test_unknown_file_fails(spark, tmp, layout):
    root, _ = layout
    write_csv(f"{root}/car_ped_stops/parking_2022.csv", PCOLS, [])
    with pytest.raises(ValueError):
        BL.build_from_files(spark, root, f"{tmp}/out2")


def test_override_replaces_member(spark, tmp, layout):
    root, _ = layout
    alt = f"{tmp}/older/car_ped_stops_year_2021.csv"
    write_csv(alt, PCOLS, [prow(PCOLS, **person(location="z", datetimeoccur="2021-05-01T12:00:00Z")),
                           prow(PCOLS, **person(location="y", datetimeoccur="2021-05-01T12:00:00Z"))])
    t = BL.build_from_files(spark, root, f"{tmp}/out3",
                            overrides={"car_ped_stops_year_2021.csv": alt})
    q = {x["quarter"]: x["n"] for x in t["stop_cube"].groupBy("quarter").agg(F.sum("n_stopped").alias("n")).collect()}
    assert q == {"2021-Q2": 2, "2022-Q2": 4, "2022-Q4": 1}   # no map: no PSA lost


def test_gate_rejects_stale_quarter(spark, tmp, layout):
    root, _ = layout
    with pytest.raises(ValueError):
        BL.build_from_files(spark, root, f"{tmp}/out4", most_recent_quarter="2023-Q1")


def test_hin_sample_table(spark, tmp, layout):
    root, psa_map = layout
    lines = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"street_name": "MAIN"},
         "geometry": {"type": "LineString", "coordinates": [[0.0, 0.0], [0.2, 0.2]]}},
        {"type": "Feature", "properties": {"street_name": "BROAD"},
         "geometry": {"type": "MultiLineString", "coordinates": [[[0.1, 0.0], [0.1, 0.3]]]}}]}
    with open(f"{tmp}/hin.geojson", "w") as fh:
        json.dump(lines, fh)
    t = BL.build_from_files(spark, root, f"{tmp}/out5", psa_map=psa_map, hin_lines=f"{tmp}/hin.geojson",
                            sample_year=2022, sample_rows=10)
    rows = t["hin_sample"].collect()
    # 'b' at (0.1, 0.1) is on both roads (two rows); 'd' at (5, 5) is on none; 'c' has no point
    got = sorted((r["location"], r["stname"]) for r in rows)
    assert got == [("b", "BROAD"), ("b", "MAIN"), ("d", None)]
    assert {r["on_hin"] for r in rows if r["location"] == "b"} == {True}


def _zip_folder(root, path, extra=None):
    import zipfile
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                full = os.path.join(dirpath, f)
                z.write(full, "csvs/" + os.path.relpath(full, root))
        for name, text in (extra or {}).items():
            z.writestr(name, text)


def test_build_from_archive_equals_folder_build(spark, tmp, layout):
    root, psa_map = layout
    sample_csv = "lat,lng,year,on_hin,stops_objectid,location,stname\n39.9,-75.1,2023,True,7,X,MAIN\n"
    _zip_folder(root, f"{tmp}/backup.zip",
                {"csvs/car_ped_stops_hin_random_sample/car_ped_stops_hin_random_sample.csv": sample_csv,
                 "csvs/car_ped_stops_hin_random_sample/summary.json": json.dumps({"last_dt": "2023-01-05"})})
    a = BL.build_from_archive(spark, f"{tmp}/backup.zip", f"{tmp}/outz", psa_map=psa_map)
    f = BL.build_from_files(spark, root, f"{tmp}/outf", psa_map=psa_map)
    for name in ("stop_cube_reason", "stop_cube", "hin_cube", "shootings_cube"):
        cols = [c for c in f[name].columns]
        assert sorted(a[name].select(cols).collect()) == sorted(f[name].select(cols).collect()), name
    s = a["hin_sample"].collect()
    assert [(r["stname"], r["on_hin"], r["year"]) for r in s] == [("MAIN", True, 2023)]


def test_archive_override_and_unknown_member(spark, tmp, layout):
    import zipfile
    root, _ = layout
    _zip_folder(root, f"{tmp}/backup.zip")
    with zipfile.ZipFile(f"{tmp}/older.zip", "w") as z:
        z.writestr("csvs/car_ped_stops/car_ped_stops_year_2021.csv", ",".join(PCOLS) + "\n" + "\n".join(
            prow(PCOLS, **person(location=l, datetimeoccur="2021-05-01T12:00:00Z")) for l in "xyz") + "\n")
    t = BL.build_from_archive(spark, f"{tmp}/backup.zip", f"{tmp}/o1",
                              overrides={"car_ped_stops_year_2021.csv": f"{tmp}/older.zip"})
    q = {x["quarter"]: x["n"] for x in t["stop_cube"].groupBy("quarter").agg(F.sum("n_stopped").alias("n")).collect()}
    assert q["2021-Q2"] == 3 and "2020-Q4" not in q
    _zip_folder(root, f"{tmp}/bad.zip", {"csvs/car_ped_stops/parking_2022.csv": ",".join(PCOLS) + "\n"})
    with pytest.raises(ValueError):
        BL.build_from_archive(spark, f"{tmp}/bad.zip", f"{tmp}/o2")


def test_write_build_propagates_a_failing_write(spark, tmp):
    good = spark.range(3).select(F.col("id").alias("x"))
    bad = spark.range(3).select(F.lit("not a number").cast("int").alias("x"))
    with pytest.raises(Exception):
        BL.write_build({"good": good, "bad": bad}, f"{tmp}/wb", "2022-Q4", gate=False)


def test_cli_build_folder_and_archive(spark, tmp, layout):
    from cubewright.plans import run
    root, psa_map = layout
    run.main(["build", "--csv-root", root, "--out", f"{tmp}/cli_f", "--psa-map", psa_map])
    _zip_folder(root, f"{tmp}/cli.zip")
    run.main(["build", "--archive", f"{tmp}/cli.zip", "--out", f"{tmp}/cli_a", "--psa-map", psa_map])
    a = sorted(SK.read_table(spark, f"{tmp}/cli_a", "stop_cube").select("districtoccur", "psa", "n_stopped").collect())
    f = sorted(SK.read_table(spark, f"{tmp}/cli_f", "stop_cube").select("districtoccur", "psa", "n_stopped").collect())
    assert a == f and len(a) == 5
    assert spark.read.parquet(f"{tmp}/cli_a/settings").collect()[0][0] == "2022-Q4"


def test_failed_gate_keeps_the_published_build(spark, tmp, layout):
    root, _ = layout
    out = f"{tmp}/kept"
    BL.build_from_files(spark, root, out, seed_total=(2022, 1))
    before = sorted(SK.read_table(spark, out, "stop_cube").collect())
    write_csv(f"{root}/car_ped_stops/car_ped_stops_year_2020.csv", PCOLS,
              [prow(PCOLS, **person(location="n", datetimeoccur="2020-05-01T12:00:00Z"))])
    with pytest.raises(ValueError):
        BL.build_from_files(spark, root, out, most_recent_quarter="2023-Q1")
    with pytest.raises(ValueError):
        BL.build_from_files(spark, root, out, seed_total=(2022, 1))
    assert sorted(SK.read_table(spark, out, "stop_cube").collect()) == before
    BL.build_from_files(spark, root, out, seed_total=(2022, 2))
    assert SK.read_table(spark, out, "stop_cube").count() == len(before) + 1
    assert SK.most_recent_quarter(spark, out) == "2022-Q4"


def test_unresolved_overrides_fail(spark, tmp, layout):
    root, _ = layout
    with pytest.raises(ValueError):
        BL.build_from_files(spark, root, f"{tmp}/u1", overrides={"car_ped_stops_year_1999.csv": f"{tmp}/x.csv"})
    _zip_folder(root, f"{tmp}/a.zip")
    for base in ("car_ped_stops_year_1999.csv", "car_ped_stops_year_2021.csv"):
        with pytest.raises(ValueError):
            import zipfile
            with zipfile.ZipFile(f"{tmp}/none-{base}.zip", "w") as z:
                z.writestr("csvs/car_ped_stops/car_ped_stops_year_1999.csv" if base.endswith("1999.csv") else "readme.txt", "x")
            BL.build_from_archive(spark, f"{tmp}/a.zip", f"{tmp}/u2", overrides={base: f"{tmp}/none-{base}.zip"})


def test_folder_and_archive_agree_on_any_header(spark, tmp, layout):
    root, _ = layout
    cols = [c for c in sorted(PCOLS) if c != "weekday"] + ["unheard_of"]
    rows = [person(location='"MAIN ""X"", ST"', age=50), person(location='"MAIN ""X"", ST"', age=20), person(location="q")]
    write_csv(f"{root}/car_ped_stops/car_ped_stops_year_2019.csv", cols, [prow(cols, **r) for r in rows])
    _zip_folder(root, f"{tmp}/h.zip")
    f = BL.build_from_files(spark, root, f"{tmp}/hf")["stop_cube_reason"]
    a = BL.build_from_archive(spark, f"{tmp}/h.zip", f"{tmp}/ha")["stop_cube_reason"]
    assert sorted(a.select(f.columns).collect()) == sorted(f.collect())
    assert f.where("age_range = '45-54'").count() == 1        # the driver of the quoted place


def test_cli_report_of_points_and_psa_population(spark, tmp, layout):
    from cubewright.plans import run
    root, psa_map = layout
    lines = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"street_name": "MAIN"},
             "geometry": {"type": "LineString", "coordinates": [[0.0, 0.0], [0.2, 0.2]]}}]}
    with open(f"{tmp}/hin.geojson", "w") as fh:
        json.dump(lines, fh)
    run.main(["build", "--csv-root", root, "--out", f"{tmp}/r14", "--psa-map", psa_map,
              "--hin-lines", f"{tmp}/hin.geojson", "--sample-year", "2022", "--seed-total", "2022=1"])
    with open(f"{tmp}/pop.csv", "w") as fh:
        fh.write("PSA_NUM,total,white,black,asian,hispanic_or_latino,american_indian,unknown\n"
                 "091,10,4,3,2,1,0,0\n092,5,1,1,1,1,1,0\n121,7,7,0,0,0,0,0\n")
    with open(f"{tmp}/geo.csv", "w") as fh:
        fh.write("full_psa_num,district,division\n091,09,X\n092,09,X\n121,12,Y\n")
    pop = ["--population", f"{tmp}/pop.csv", "--geographies", f"{tmp}/geo.csv"]
    run.main(["report", "--tables", f"{tmp}/r14", *pop, "--name", "r_hin_points", "--out", f"{tmp}/points"])
    got = {(r["location"], r["hover_text"]) for r in spark.read.json(f"{tmp}/points/r_hin_points").collect()}
    assert got == {("b", "Traffic stop on the HIN"), ("d", "Traffic stop not on the HIN")}
    run.main(["report", "--tables", f"{tmp}/r14", *pop, "--name", "r_map_extent", "--out", f"{tmp}/extent"])
    assert spark.read.json(f"{tmp}/extent/r_map_extent").first()["years"] == [2022]
    ctx = run._report_ctx(spark, f"{tmp}/r14", f"{tmp}/pop.csv", "2021-Q1", f"{tmp}/geo.csv")
    assert {r["district"]: r["total"] for r in ctx.population.collect()} == {"09": 15, "12": 7}


def test_gates_and_unknown_share_come_from_the_writing_pass(spark, tmp, layout, monkeypatch):
    """One point-in-polygon and one scan of the persons; no table is read again
    for its gate; the share equals the operator's own."""
    from cubewright.operators import quality as QU
    from cubewright.operators import remap as RM
    from cubewright.sources import files as FS
    root, psa_map = layout[0], layout[1]
    calls = {"pip": 0, "scan": []}
    pip, scan = RM.point_in_polygon, FS.scan_typed
    monkeypatch.setattr(RM, "point_in_polygon", lambda *a, **k: (calls.__setitem__("pip", calls["pip"] + 1), pip(*a, **k))[1])

    def counted(sp, paths, *a, **k):
        calls["scan"].append(sorted(paths)[0].rsplit("/", 1)[-1].split("_year")[0])
        return scan(sp, paths, *a, **k)

    monkeypatch.setattr(FS, "scan_typed", counted)
    for gate in ("quarter_gate_report", "total_report", "unknown_geometry"):
        monkeypatch.setattr(QU, gate, lambda *a, **k: pytest.fail("read again"))
    t = BL.build_from_files(spark, root, f"{tmp}/once", psa_map=psa_map)
    assert calls["scan"].count("car_ped_stops") == 1
    persons_pips = calls["pip"] - (1 if "car_ped_stops_on_hin" in calls["scan"] else 0)
    assert persons_pips == 1
    monkeypatch.undo()
    got = t["quality_unknown_geometry"].first()
    persons = FS.scan_typed(spark, f"{root}/car_ped_stops/*.csv", SC.TABLES["car_ped_stops"][0])
    from cubewright.functions.wkb import with_point
    from cubewright.operators import spatial as SP
    edges = SP.polygon_edges(FS.read_geojson(spark, psa_map, "PSA_NUM"))
    want = QU.unknown_geometry(RM.remap_districts(with_point(persons) if "the_geom" in persons.columns else persons, edges), "car_ped_stops").first()
    assert tuple(got) == tuple(want)


def test_observed_gates(spark, tmp):
    """The observed metrics are those of the rows written; an empty cube fails."""
    from cubewright.operators import quality as QU
    cube = spark.sql("select date'2020-01-01' as quarter_date, 2020 as year, id as n_stopped from range(10) "
                     "union all select date'2021-10-01', 2021, 5")
    df, obs = QU.observed_quarter(cube, "a", 2021)
    df.repartition(3).write.parquet(f"{tmp}/a")
    assert (obs.get["n_rows"], obs.get["seed"]) == (11, 45)
    QU.check_observed_quarters({"a": obs.get}, "2021-Q4")
    QU.check_observed_total(obs.get, 45)
    with pytest.raises(ValueError):
        QU.check_observed_quarters({"a": obs.get}, "2021-Q3")
    with pytest.raises(ValueError):
        QU.check_observed_total(obs.get, 46)
    df, obs = QU.observed_quarter(cube.where("year = 0"), "b")
    df.write.parquet(f"{tmp}/b")
    with pytest.raises(ValueError):
        QU.check_observed_quarters({"b": obs.get}, "2021-Q4")
