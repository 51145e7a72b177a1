"""File sources: null markers, typed scan, file order, archives, overrides, summaries."""
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import types as T

from cubewright.operators import collapse as CO
from cubewright.sources import files as FS

SCHEMA = T.StructType([
    T.StructField("datetimeoccur", T.TimestampType()),
    T.StructField("location", T.StringType()),
    T.StructField("stoptype", T.StringType()),
    T.StructField("districtoccur", T.StringType()),
    T.StructField("psa", T.StringType()),
    T.StructField("race", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("individual_searched", T.DoubleType()),
    T.StructField("mvc_code", T.StringType()),
])
HEADER = ",".join(f.name for f in SCHEMA.fields)


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(HEADER + "\n" + "\n".join(lines) + "\n")


def test_null_markers_and_types(spark, tmp):
    p = f"{tmp}/csvs/car_ped_stops/car_ped_stops_year_2021.csv"
    write(p, ["2021-01-01T03:00:00Z,A,vehicle,09,1,Asian,NA,40,1,None",
              "2021-01-01 03:00:00+00:00,B,vehicle,9,,Asian,N/A,,0,",
              "2021-01-01 03:00:00,C,vehicle,09,2,null,Male,20.0,NULL,3111",
              "2021-01-01 03:00:00+00,D,vehicle,09,2,Asian,Male,20,0,3111"])
    df = FS.scan_typed(spark, p, SCHEMA)
    rows = {r["location"]: r for r in df.collect()}
    assert rows["A"]["gender"] is None and rows["A"]["mvc_code"] is None
    assert rows["B"]["psa"] is None and rows["B"]["age"] is None and rows["B"]["gender"] is None
    assert rows["C"]["race"] is None and rows["C"]["individual_searched"] is None
    assert rows["A"]["districtoccur"] == "09" and rows["B"]["districtoccur"] == "9"
    assert len({r["datetimeoccur"] for r in rows.values()}) == 1


def test_file_order_ordinal_across_splits(spark, tmp):
    p = f"{tmp}/big/car_ped_stops_year_2022.csv"
    lines = [f"2022-05-01T12:00:00Z,L{i // 50},vehicle,12,1,Asian,Male,{20 + (i % 50)},0,3111"
             for i in range(20000)]
    write(p, lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = FS.scan_typed(spark, p, SCHEMA)
        assert df.rdd.getNumPartitions() > 5
        s = CO.collapse_stops(df, ["_ordinal"], ("datetimeoccur", "location"))
        ages = {r["driver"]["age"] for r in s.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ages == {20.0}       # the first row of every stop in the file


def test_routing_unknown_member_fails():
    with pytest.raises(ValueError):
        FS.route_files(["/x/car_ped_stops_year_2021.csv", "/x/parking_2021.csv"], ["car_ped_stops"])
    r = FS.route_files(["/x/car_ped_stops_on_hin_year_2021.csv", "/x/car_ped_stops_year_2021.csv"],
                       ["car_ped_stops", "car_ped_stops_on_hin"])
    assert r == {"car_ped_stops": ["/x/car_ped_stops_year_2021.csv"],
                 "car_ped_stops_on_hin": ["/x/car_ped_stops_on_hin_year_2021.csv"]}


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, lines in members.items():
            z.writestr(name, HEADER + "\n" + "\n".join(lines) + "\n")


def test_archive_members_and_override(spark, tmp):
    row = "2022-05-01T12:00:00Z,{loc},vehicle,12,1,Asian,Male,30,0,{code}"
    main = f"{tmp}/backup.zip"
    other = f"{tmp}/older.zip"
    _zip(main, {"csvs/car_ped_stops/car_ped_stops_year_2021.csv": [row.format(loc="a", code="3111")],
                "csvs/car_ped_stops/car_ped_stops_year_2022.csv": [row.format(loc="b", code="")]})
    _zip(other, {"csvs/car_ped_stops/car_ped_stops_year_2022.csv": [row.format(loc="b", code="4303"),
                                                                    row.format(loc="c", code="4303")]})
    members = FS.archive_members(spark, [main])
    chosen = FS.override_members(members, FS.archive_members(spark, [other]))
    df = FS.read_members(chosen, SCHEMA, chunk_rows=1)
    got = sorted((r["location"], r["mvc_code"], r["_ordinal"]["row"]) for r in df.collect())
    assert got == [("a", "3111", 0), ("b", "4303", 0), ("c", "4303", 1)]


def test_summaries_must_agree(spark, tmp):
    for table, d in (("car_ped_stops", "2024-12-05"), ("shootings", "2024-11-30")):
        os.makedirs(f"{tmp}/s/{table}", exist_ok=True)
        with open(f"{tmp}/s/{table}/summary.json", "w") as fh:
            json.dump({"last_dt": d}, fh)
    s = FS.read_summaries(spark, f"{tmp}/s/*/summary.json")
    assert FS.check_latest_full_quarter(s) == "2024-Q3"
    with open(f"{tmp}/s/shootings/summary.json", "w") as fh:
        json.dump({"last_dt": "2025-01-02"}, fh)
    with pytest.raises(ValueError):
        FS.check_latest_full_quarter(FS.read_summaries(spark, f"{tmp}/s/*/summary.json"))


def test_dim_csv_keeps_leading_zeros(spark, tmp):
    p = f"{tmp}/dim.csv"
    with open(p, "w") as fh:
        fh.write("PSA_NUM,total,white\n077,0,0\n012,100,40\n")
    d = {r["PSA_NUM"]: r["total"] for r in FS.scan_dim_csv(spark, p, ["PSA_NUM"], ["total", "white"]).collect()}
    assert d == {"077": 0, "012": 100}
    assert isinstance(list(d.values())[0], int)


def test_archive_summaries(spark, tmp):
    a = f"{tmp}/backup.zip"
    with zipfile.ZipFile(a, "w") as z:
        z.writestr("csvs/car_ped_stops/summary.json", json.dumps({"last_dt": "2024-12-05"}))
        z.writestr("csvs/car_ped_stops/car_ped_stops_year_2024.csv", HEADER + "\n")
        z.writestr("csvs/shootings/summary.json", json.dumps({"last_dt": "2024-10-01T00:00:00"}))
    assert FS.check_latest_full_quarter(FS.read_archive_summaries(spark, [a])) == "2024-Q3"
    b = f"{tmp}/broken.zip"
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("csvs/car_ped_stops/summary.json", json.dumps({"last_dt": "2024-12-05"}))
        z.writestr("csvs/shootings/shootings_year_2024.csv", HEADER + "\n")      # no summary
    with pytest.raises(ValueError):
        FS.check_latest_full_quarter(FS.read_archive_summaries(spark, [b]))


def test_scan_binds_by_name_with_quotes(spark, tmp):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])
    os.makedirs(f"{tmp}/n")
    for name, text in (("1", 'b,a\n1,"x ""y"", z"\n'), ("2", "a,other,c\np,q,r\n"), ("3", "c,b,a\n")):
        with open(f"{tmp}/n/{name}.csv", "w") as fh:
            fh.write(text)
    got = sorted(((r["a"], r["b"], r["c"]) for r in FS.scan_typed(spark, f"{tmp}/n/*.csv", schema).collect()), key=str)
    assert got == [("p", None, "r"), ('x "y", z', "1", None)]
    with open(f"{tmp}/n/4.csv", "w") as fh:
        fh.write('a,b,c\n"two\nlines",1,2\n')
    with pytest.raises(Exception):
        FS.scan_typed(spark, f"{tmp}/n/4.csv", schema).collect()
    assert FS.scan_typed(spark, f"{tmp}/n/4.csv", schema, multi_line=True).first()["a"] == "two\nlines"
    with open(f"{tmp}/n/5.csv", "w"):
        pass
    assert FS.scan_typed(spark, f"{tmp}/n/5.csv", schema).count() == 0


def test_override_that_matches_nothing_fails(spark):
    m = spark.createDataFrame([("a.zip", "x/y.csv", "y.csv")], "archive string, member string, base string")
    with pytest.raises(ValueError):
        FS.override_members(m, spark.createDataFrame([("b.zip", "x/z.csv", "z.csv")], m.schema))


def test_headers_after_blank_lines_in_one_job(spark, tmp):
    """A file's header is its first line that is not blank; a file of blank
    lines is an error; as many jobs for many files as for few."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in "ab"])
    os.makedirs(f"{tmp}/blank")
    for i in range(14):
        with open(f"{tmp}/blank/with space {i}.csv", "w", newline="\r\n" if i % 2 else "\n") as fh:
            fh.write("\n" * (i % 4) + ("  \n" if i % 5 == 0 else "") + ("a,b\n" if i % 3 else "b,a\n") + f"{i},x\n\n{i},y\n")

    def jobs(what):
        spark.sparkContext.setJobGroup(what, what)
        FS.csv_headers(spark, f"{tmp}/blank/{what}.csv")
        spark.sparkContext.setJobGroup("none", "none")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(what))

    got = sorted((r["a"], r["b"]) for r in FS.scan_typed(spark, f"{tmp}/blank/*.csv", schema).collect())
    assert got == sorted(((str(i), x) if i % 3 else (x, str(i))) for i in range(14) for x in "xy")
    assert jobs("*") == jobs("with space 1")
    with open(f"{tmp}/blank/only.csv", "w") as fh:
        fh.write("\n  \n\n")
    with pytest.raises(ValueError, match="only.csv"):
        FS.scan_typed(spark, f"{tmp}/blank/*.csv", schema)
    with open(f"{tmp}/blank.csv", "w") as fh:
        fh.write('\n\n"a","b\nc"\n1,2\n')
    names = FS.csv_headers(spark, f"{tmp}/blank.csv", multi_line=True)
    assert list(names) == [("a", "b\nc")]


def test_header_of_a_file_of_many_splits(spark, tmp):
    """One split a task, and each stops at its first line."""
    p = f"{tmp}/split.csv"
    write(p, [f"2022-05-01T12:00:00Z,L{i},vehicle,12,1,Asian,Male,20,0,3111" for i in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert FS.csv_headers(spark, p) == {tuple(f.name for f in SCHEMA.fields): [f"file://{p}"]}
        assert FS.scan_typed(spark, p, SCHEMA).count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _big_zip(path, method):
    """Members of more than a block, stored or deflated, with line feeds at will."""
    import random
    rng = random.Random(1)
    members = {f"csvs/car_ped_stops/car_ped_stops_year_{y}.csv": [f"2022-05-01T12:00:00Z,L{rng.random()},vehicle,12,1,Asian,Male,{20 + i % 50},0,{y}" for i in range(n)]
               for y, n in ((2019, 9000), (2020, 1), (2021, 6000), (2022, 0))}
    with zipfile.ZipFile(path, "w", method) as z:
        z.comment = b"not the end PK\x05\x06"[:11]
        for name, lines in members.items():
            z.writestr(name, "\n\n" + HEADER + "\n" + "".join(x + "\n" for x in lines))
        z.writestr("csvs/car_ped_stops/summary.json", json.dumps({"last_dt": "2024-12-05"}))
        z.writestr("notes/", b"")
    return members


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_archive_of_many_splits_and_blocks(spark, tmp, method, monkeypatch):
    from cubewright.sources import archive as AR
    monkeypatch.setattr(AR, "BLOCK", 5000)
    want = _big_zip(f"{tmp}/big.zip", method)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        rows = FS.read_members(FS.archive_members(spark, [f"{tmp}/big.zip"]), SCHEMA, chunk_rows=1000).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in sorted(rows, key=lambda r: (r["_file"], r["_ordinal"]["row"])):
        got.setdefault(r["_file"], []).append(r["location"])
    assert got == {k: [x.split(",")[1] for x in v] for k, v in want.items() if v}
    assert FS.check_latest_full_quarter(FS.read_archive_summaries(spark, [f"{tmp}/big.zip"])) == "2024-Q3"


def test_damaged_archive_fails(spark, tmp):
    _big_zip(f"{tmp}/whole.zip", zipfile.ZIP_STORED)
    with open(f"{tmp}/whole.zip", "rb") as fh:
        data = bytearray(fh.read())
    at = data.index(b"vehicle", 5000)
    data[at:at + 7] = b"VEHICLE"
    with open(f"{tmp}/broken.zip", "wb") as fh:
        fh.write(data)
    with pytest.raises(Exception, match="damaged"):
        FS.read_members(FS.archive_members(spark, [f"{tmp}/broken.zip"]), SCHEMA).collect()
    with pytest.raises(zipfile.BadZipFile):
        with open(f"{tmp}/none.zip", "wb") as fh:
            fh.write(b"no archive")
        FS.archive_members(spark, [f"{tmp}/none.zip"])


def test_written_archives_are_zip_files(spark, tmp):
    from cubewright.sources import archive as AR
    lines = spark.createDataFrame([(a, f"m{m}.csv", i, f"{a},{m},{i},é\r") for a in (0, 2) for m in range(3) for i in range(2000)],
                                  "archive int, member string, place int, line string").repartition(5)
    paths = AR.write_archives(lines, f"{tmp}/zips", 3)
    assert len(paths) == 3
    seen = {}
    for p in paths:
        with zipfile.ZipFile(p.removeprefix("file://")) as z:
            assert z.testzip() is None
            for n in z.namelist():
                text = z.read(n).decode()
                seen[text.split(",")[0], n] = text
    assert seen == {(str(a), f"m{m}.csv"): "".join(f"{a},{m},{i},é\r\n" for i in range(2000)) for a in (0, 2) for m in range(3)}


def test_archive_writing_holds_only_what_is_to_be_handed_on(tmp):
    """A compressor's empty writes, one a piece of input, are not kept: the size
    held is known without counting them again."""
    from cubewright.sources import archive as AR
    sink = AR._Sink()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z, z.open("m.csv", "w") as out:
        for _ in range(5000):
            out.write(b"the same line\n")
    assert all(sink.held) and len(sink.held) < 100
    assert sink.size == sum(map(len, sink.held))
    data = sink.take()
    assert not sink.held and not sink.size
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.read("m.csv") == b"the same line\n" * 5000


def test_packed_member_files_keep_their_order(spark, tmp):
    """Packed person files hold the rows of plain ones in the same order, in a
    fraction of the bytes; the registered queries write them so."""
    from cubewright.plans import queries_sources as Q
    rows = [(2000 + i % 2, f"at {i // 3}", i % 3, " ".join(["the same words in every row"] * 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "source_year int, location string, place int, words string").repartition(4)
    seen, size = {}, {}
    for packing in ("none", "gzip"):
        out = FS.write_member_csvs(df, f"{tmp}/{packing}", "t", "source_year", ["source_year", "location", "place"], compression=packing)
        files = [f.removeprefix("file://") for f in spark.read.text(out).inputFiles()]
        assert all(f.endswith(".csv.gz" if packing == "gzip" else ".csv") for f in files)
        size[packing] = sum(os.path.getsize(f) for f in files)
        got = FS.scan_typed(spark, FS.route_files(files, ["t"])["t"], df.schema).collect()
        seen[packing] = [tuple(r)[:4] for r in sorted(got, key=lambda r: (r["source_year"], r["_ordinal"]["file"].rsplit("/", 1)[-1][:10], r["_ordinal"]["start"], r["_ordinal"]["row"]))]
    assert seen["none"] == seen["gzip"] == sorted(rows)
    assert size["gzip"] * 3 < size["none"]
    path, _ = Q._persons_text(spark, "/root/testdata/sf0.001", f"{tmp}/persons")
    assert all(f.endswith(".csv.gz") for f in spark.read.text(path).inputFiles())


def test_archives_of_rows_made_into_lines_after_dealing(spark, tmp):
    """Archives are dealt narrow rows and make the lines themselves; every CSV
    member begins with the head, every archive holds its summary."""
    from cubewright.sources import archive as AR
    rows = spark.createDataFrame([(a, f"m{m}.csv", i) for a in (0, 2) for m in range(2) for i in range(300)], "archive int, member string, i int").repartition(5)
    notes = spark.range(3).selectExpr("cast(id as int) as archive", "'z.json' as member", "concat('note ', id) as text")
    paths = AR.write_archives(rows.unionByName(notes, allowMissingColumns=True), f"{tmp}/zips", 3, ["i"],
                              lambda d: d.selectExpr("member", "coalesce(text, concat(archive, ',', i)) as line"), "a,i")
    seen = []
    for p in paths:
        with zipfile.ZipFile(p.removeprefix("file://")) as z:
            seen.append({n: z.read(n).decode() for n in z.namelist()})
    members = lambda a: {f"m{m}.csv": "a,i\n" + "".join(f"{a},{i}\n" for i in range(300)) for m in range(2)}
    assert sorted(seen, key=lambda x: x["z.json"]) == [{**(members(a) if a != 1 else {}), "z.json": f"note {a}\n"} for a in range(3)]


def test_headers_are_read_from_the_beginnings(spark, tmp):
    """Without a job where the header lies in a file's first bytes, packed or
    not; by one where it does not; with quotes, a byte order mark and no line end."""
    import gzip
    texts = {"plain": "a,b\n1,2\n", "marked": "\ufeffa,b\r\n1,2\r\n", "short": "a,b", "quoted": '\n"b","a"\n2,1\n'}
    os.makedirs(f"{tmp}/near")
    for n, x in texts.items():
        with open(f"{tmp}/near/{n} 1.csv", "w", newline="") as fh:
            fh.write(x)
    with gzip.open(f"{tmp}/near/packed.csv.gz", "wt") as fh:
        fh.write(texts["plain"] * 2000)

    def headers(path):
        spark.sparkContext.setJobGroup(path, path)
        found = FS.csv_headers(spark, path)
        spark.sparkContext.setJobGroup("none", "none")
        return {k: sorted(f.rsplit("/", 1)[-1] for f in v) for k, v in found.items()}, len(spark.sparkContext.statusTracker().getJobIdsForGroup(path))

    assert headers(f"{tmp}/near") == ({("a", "b"): ["marked 1.csv", "packed.csv.gz", "plain 1.csv", "short 1.csv"], ("b", "a"): ["quoted 1.csv"]}, 0)
    with open(f"{tmp}/near/far.csv", "w") as fh:
        fh.write("\n" * (2 * FS.BEGINNING) + texts["plain"])
    with open(f"{tmp}/near/none.csv", "w"):
        pass
    found, jobs = headers(f"{tmp}/near/*")
    assert jobs and found == {("a", "b"): ["far.csv", "marked 1.csv", "packed.csv.gz", "plain 1.csv", "short 1.csv"], ("b", "a"): ["quoted 1.csv"]}
    long = ",".join(f"column {i}" for i in range(FS.BEGINNING // 8))
    with open(f"{tmp}/long.csv", "w") as fh:
        fh.write(long + "\n")
    assert list(FS.csv_headers(spark, f"{tmp}/long.csv")) == [tuple(long.split(","))]


def test_person_files_of_dealt_sources(spark, tmp):
    """Files made of narrow rows after dealing hold the person rows, in order."""
    from cubewright.plans import queries_sources as Q
    from cubewright.sources import analog as A
    sf = "/root/testdata/sf0.001"
    p = A.persons(spark, sf).drop("l_orderkey")
    kw = dict(group_cols=Q.STOP_KEY, columns=sorted(p.columns, reverse=True))
    wide = FS.write_member_csvs(p, f"{tmp}/wide", "t", "source_year", Q.FILE_ORDER, **kw)
    narrow = FS.write_member_csvs(A.person_sources(spark, sf), f"{tmp}/narrow", "t", "source_year", Q.FILE_ORDER, **kw,
                                  derive=lambda rows: A.as_persons(rows, "member"))

    def lines(path):
        files = sorted((f for f in spark.read.text(path).inputFiles()), key=lambda f: f.split("/")[-2:])
        return [x for f in files for x in open(f.removeprefix("file://")).read().splitlines() if not x.startswith("vehicle_searched")]

    assert len(A.person_sources(spark, sf).columns) * 3 < 2 * len(p.columns)
    assert lines(wide) == lines(narrow) and len(lines(wide)) == p.count()


def test_dealt_sources_are_narrow_and_hold_odd_values(spark, tmp):
    """Few columns, one of them text, are dealt; persons of negative keys, missing
    values and unknown brands are those of the oracle's SQL."""
    import duckdb
    from cubewright.plans.oracle_base import A_PERSONS
    from cubewright.sources import analog as A
    src = "/root/testdata/sf0.001"
    con = duckdb.connect()
    odd = {"region": "*", "nation": "*",
           "orders": "* REPLACE (CASE WHEN o_custkey % 2 = 0 THEN -o_custkey ELSE o_custkey END AS o_custkey)",
           "customer": "* REPLACE (CASE WHEN c_custkey % 2 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey)",
           "part": """* REPLACE (CASE WHEN p_partkey % 3 = 0 THEN -p_partkey ELSE p_partkey END AS p_partkey,
                      CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Brand#99' ELSE p_brand END AS p_brand)""",
           "lineitem": """* REPLACE (CASE WHEN l_partkey % 3 = 0 THEN -l_partkey ELSE l_partkey END AS l_partkey,
                          CASE WHEN l_orderkey % 5 > 0 THEN l_tax END AS l_tax, CASE WHEN l_orderkey % 7 > 0 THEN l_discount END AS l_discount,
                          CASE WHEN l_orderkey % 3 > 0 THEN l_linestatus END AS l_linestatus, CASE WHEN l_orderkey % 11 > 0 THEN l_quantity END AS l_quantity)"""}
    for t, cols in odd.items():
        con.execute(f"COPY (SELECT {cols} FROM '{src}/{t}.parquet') TO '{tmp}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp}/{t}.parquet'")
    p = A.persons(spark, tmp)
    cols = [c for c in p.columns if c != "l_orderkey" and not c.startswith("n_stopped")]
    names = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in ("vehicle_searched", "individual_searched", "individual_frisked", "individual_arrested", "individual_contraband") else c
                      for c in cols)
    want = con.execute(f"WITH {A_PERSONS.strip()} SELECT {names} FROM a_persons").fetchall()
    got = [tuple(r) for r in p.select(*cols).collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len({r[cols.index("race")] for r in got}) == 8
    sources = A.person_sources(spark, tmp).schema
    assert len(sources) <= 14 and [f.name for f in sources if f.dataType.simpleString() == "string"] == ["division"]


@pytest.mark.parametrize("query, folder, ending", [("q_stop_cube_coded", "persons", ".zstd.parquet"), ("q_scan_typed", "blank", ".txt.gz")])
def test_files_between_steps_are_packed(spark, tmp, monkeypatch, query, folder, ending):
    from cubewright.plans import queries_sources as Q
    monkeypatch.setattr(Q, "scratch_dir", lambda spark, tag: f"{tmp}/{tag}")
    rows = getattr(Q, query)(spark, "/root/testdata/sf0.001").count()
    files = [f for f in os.listdir(f"{tmp}/csv/{folder}") if f.startswith("part-")]
    assert rows and files and all(f.endswith(ending) for f in files)
