"""Incremental fold: restart from the checkpoint picks up only new files and
the result equals a one-pass build."""
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubewright import config as C
from cubewright.operators import collapse as CO
from cubewright.operators import cube as CU
from cubewright.sources import files as FS
from cubewright.streaming import fold as SF

SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("datetimeoccur", T.TimestampType()), ("location", T.StringType()), ("stoptype", T.StringType()),
    ("districtoccur", T.StringType()), ("psa", T.StringType()), ("race", T.StringType()),
    ("gender", T.StringType()), ("age", T.DoubleType()), ("individual_searched", T.DoubleType()),
    ("mvc_code", T.StringType())]])


def write(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(",".join(f.name for f in SCHEMA.fields) + "\n" + "\n".join(rows) + "\n")


def rows_for(year, n):
    return [f"{year}-05-01T12:00:00Z,L{i % 7},vehicle,{10 + i % 3},{i % 4},Asian,"
            f"{'Male' if i % 2 else 'Female'},{20 + i},{i % 2},3111" for i in range(n)]


def one_pass(spark, paths):
    df = FS.scan_typed(spark, paths, SCHEMA)
    stops = CO.classify_stops(CO.collapse_stops(df, ["_ordinal"], ("_file", "datetimeoccur", "location")))
    return CU.stop_cube_reason(stops, "2022-Q4").select(*C.REASON_KEYS, *C.STOP_MEASURES)


def folded(spark, table):
    return sorted(map(tuple, SF.final_cube(spark, table).select(*C.REASON_KEYS, *C.STOP_MEASURES).collect()))


def written_years(table, version):
    return sorted(int(x[5:]) for x in os.listdir(f"{table}/data/v={version}") if x.startswith("year="))


def test_fold_restart(spark, tmp):
    land, table, ck = f"{tmp}/landing", f"{tmp}/cube", f"{tmp}/ck"
    write(f"{land}/car_ped_stops_year_2020.csv", rows_for(2020, 30))
    write(f"{land}/car_ped_stops_year_2021.csv", rows_for(2021, 20))
    with open(f"{land}/summary.json", "w") as fh:
        fh.write("{}")
    SF.start_fold(spark, land, table, ck, SCHEMA, "2022-Q4").awaitTermination()
    first = SF.versions(spark, table)[-1]
    # a new yearly file lands; the restarted stream folds only that one
    write(f"{land}/car_ped_stops_year_2022.csv", rows_for(2022, 25))
    SF.start_fold(spark, land, table, ck, SCHEMA, "2022-Q4").awaitTermination()
    last = SF.versions(spark, table)[-1]
    assert last == first + 1
    # a restart with nothing new writes no version
    SF.start_fold(spark, land, table, ck, SCHEMA, "2022-Q4").awaitTermination()
    assert SF.versions(spark, table)[-1] == last
    got = sorted(SF.final_cube(spark, table).select(*C.REASON_KEYS, *C.STOP_MEASURES).collect())
    want = sorted(one_pass(spark, f"{land}/*.csv").collect())
    assert got == want and sum(r["n_stopped"] for r in got) == 7 * 3


def batch(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_a_version_rewrites_the_years_of_its_batch(spark, tmp):
    """Files of one year leave the folders of the others as they are; a replayed
    batch gives the same version; versions nobody needs are removed."""
    table = f"{tmp}/cube"
    files = []
    for i, years in enumerate([(2018, 2019, 2020), (2020,), (2021,), (2020, 2021)]):
        p = f"{tmp}/land/car_ped_stops_year_part{i}.csv"
        write(p, [r for y in years for r in rows_for(y, 40 + i)])
        files.append(p)

    def fold(i):
        SF.fold_batch(batch(spark, files[i]), i, table, SCHEMA, "2022-Q4", ("datetimeoccur", "location"))

    def want(n):
        return sorted(map(tuple, CU.merge_cubes([one_pass(spark, f) for f in files[:n]], C.REASON_KEYS, C.STOP_MEASURES)
                                 .select(*C.REASON_KEYS, *C.STOP_MEASURES).collect()))

    fold(0)
    assert written_years(table, 0) == [2018, 2019, 2020]
    stamp = {y: os.listdir(f"{table}/data/v=0/year={y}") for y in (2018, 2019)}
    fold(1)
    assert written_years(table, 1) == [2020]
    assert SF.folders(spark, table, 1) == {2018: "data/v=0/year=2018", 2019: "data/v=0/year=2019", 2020: "data/v=1/year=2020"}
    assert folded(spark, table) == want(2)
    fold(1)                                             # a replay
    assert folded(spark, table) == want(2)
    fold(2)
    assert written_years(table, 2) == [2021] and folded(spark, table) == want(3)
    # version 0 is gone, and of its folders the one that no version names
    assert SF.versions(spark, table) == [1, 2]
    assert written_years(table, 0) == [2018, 2019]
    assert {y: os.listdir(f"{table}/data/v=0/year={y}") for y in (2018, 2019)} == stamp
    fold(3)
    assert written_years(table, 3) == [2020, 2021] and folded(spark, table) == want(4)
    assert SF.versions(spark, table) == [2, 3]
    fold(3)
    assert folded(spark, table) == want(4)
    assert os.listdir(f"{table}/incoming") == []


def test_batches_without_stops_and_astray_files(spark, tmp):
    table = f"{tmp}/cube"
    write(f"{tmp}/land/car_ped_stops_year_2020.csv", rows_for(2020, 5))
    write(f"{tmp}/land/car_ped_stops_year_2021.csv", [])
    with open(f"{tmp}/land/notes.txt", "w") as fh:
        fh.write("x")
    args = (table, SCHEMA, "2022-Q4", ("datetimeoccur", "location"))
    SF.fold_batch(batch(spark, f"{tmp}/land/summary.json"), 0, *args)
    assert SF.folders(spark, table, 0) == {} and SF.latest_version(spark, table) is None
    SF.fold_batch(batch(spark, f"{tmp}/land/car_ped_stops_year_2020.csv"), 1, *args)
    SF.fold_batch(batch(spark, f"{tmp}/land/car_ped_stops_year_2021.csv"), 2, *args)
    assert list(SF.folders(spark, table, 2)) == [2020] and len(folded(spark, table)) > 0
    with pytest.raises(ValueError, match="notes.txt"):
        SF.fold_batch(batch(spark, f"{tmp}/land/car_ped_stops_year_2020.csv", f"{tmp}/land/notes.txt"), 3, *args)
    assert SF.versions(spark, table)[-1] == 2


def test_damaged_version_raises(spark, tmp):
    assert SF.latest_version(spark, f"{tmp}/none") is None
    os.makedirs(f"{tmp}/cube/manifest/v=0")
    assert SF.latest_version(spark, f"{tmp}/cube") is None
    with open(f"{tmp}/cube/manifest/v=0/part-0.parquet", "wb") as fh:
        fh.write(b"damaged")
    with pytest.raises(Exception):
        SF.latest_version(spark, f"{tmp}/cube").collect()
    assert SF.latest_version(spark, f"{tmp}/cube", before=0) is None


def test_a_batch_starts_few_jobs(spark, tmp):
    """Headers, shapes and manifests that are known cost a batch no job."""
    files = [f"{tmp}/land/car_ped_stops_year_{y}.csv" for y in (2019, 2020, 2021)]
    for y, p in zip((2019, 2020, 2021), files, strict=True):
        write(p, rows_for(y, 20) + rows_for(2018, 20))
    jobs = []
    for i, p in enumerate(files):
        spark.sparkContext.setJobGroup(f"batch {i} {tmp}", "batch")
        SF.fold_batch(batch(spark, p), i, f"{tmp}/cube", SCHEMA, "2022-Q4", ("datetimeoccur", "location"))
        spark.sparkContext.setJobGroup("none", "none")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batch {i} {tmp}")))
    assert max(jobs) <= 14, jobs
