"""The batch build: person rows -> cubes -> written tables (lifecycle A).

One lazy plan per cube: scan -> (remap) -> collapse -> classify -> cube.
The reason cube and the stop cube come from the same stop aggregate; the
stop cube is rolled up from the (small) reason cube, not from the stops.
Tables are written once, partitioned by year, and read back by the reports.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..operators import collapse as CO
from ..operators import cube as CU
from ..operators import quality as QU
from ..operators.remap import remap_districts
from ..sources import sinks as SK


#: Cubes whose latest quarter is gated.
GATED = ("stop_cube", "shootings_cube")
#: What cube, flags and sample use of a person row; the rest isn't staged.
PERSON_COLUMNS = ["stoptype", "datetimeoccur", "location", "districtoccur", "psa", "race", "gender", "age", "mvc_code",
                  "individual_searched", "vehicle_searched", "individual_arrested", "individual_contraband", "vehicle_contraband",
                  "individual_frisked", "vehicle_frisked", "cartodb_id", "objectid", "point_x", "point_y",
                  "n_stopped_locatable", "n_stopped_locatable_on_hin", "_ordinal", "_file"]

SAMPLE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("lat", T.DoubleType()), ("lng", T.DoubleType()), ("year", T.IntegerType()),
    ("on_hin", T.BooleanType()), ("stops_objectid", T.StringType()), ("location", T.StringType()),
    ("stname", T.StringType())]])


def build_all(persons: DataFrame, order_cols: Sequence[str], most_recent_quarter: str,
              persons_on_hin: DataFrame | None = None, shootings: DataFrame | None = None,
              psa_edges: DataFrame | None = None, stop_key=CO.DEFAULT_STOP_KEY,
              cluster_keys: Sequence[str] = (), key_determined: bool = False,
              coded: bool = False) -> dict[str, DataFrame]:
    """All cubes as lazy DataFrames.

    ``coded`` aggregates stops by codes, where the persons are a stored table
    with a scan's ordinal and their values are few; the README has figures.

    ``psa_edges`` (polygon edges of the PSA map) turns on the district merge
    and PSA re-derivation for all three inputs, as in the reproduced build.
    """
    p = remap_districts(persons, psa_edges) if psa_edges is not None else persons
    codes = CO.find_codes(p) if coded else None
    if codes is not None:
        stops = CO.coded_stops(p, codes, stop_key, *order_cols)
    else:
        stops = CO.classify_stops(CO.collapse_stops(p, order_cols, stop_key, cluster_keys=cluster_keys,
                                                    key_determined=key_determined))
    reason = CU.stop_cube_reason(stops, most_recent_quarter)
    out = {"stop_cube_reason": reason, "stop_cube": CU.stop_cube(reason)}
    if persons_on_hin is not None:
        h = remap_districts(persons_on_hin, psa_edges) if psa_edges is not None else persons_on_hin
        out["hin_cube"] = CU.hin_cube(h, most_recent_quarter)
    if shootings is not None:
        s = shootings
        if psa_edges is not None:
            s = remap_districts(shootings, psa_edges, district_col="dist", psa_col=None)
        out["shootings_cube"] = CU.shootings_cube(s, most_recent_quarter)
    return out


def write_build(tables: Mapping[str, DataFrame], path: str, most_recent_quarter: str,
                gate: bool = True, parallel: int = 4,
                seed_total: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """Write every cube (partitioned by year) to a folder of its own, gate them
    by what their writes observed (Q1, Q3), and only then publish the build; a
    failed gate leaves the build before as it was.  ``seed_total`` is (year,
    stops known before that year).

    The reason cube is written first and the stop cube is rolled up from the
    written table, so the person-level plan runs once for both.  The other
    tables do not depend on each other; their writes are submitted together
    (up to ``parallel`` concurrent Spark jobs sharing the executors), so the
    small jobs fill cores the big ones leave idle.
    """
    from concurrent.futures import ThreadPoolExecutor

    spark = next(iter(tables.values())).sparkSession
    rest = dict(tables)

    name = f"builds/{uuid.uuid4().hex}"
    folder = f"{path}/{name}"

    observed: dict[str, Observation] = {}

    def write_one(table, df):
        if table in GATED:
            df, observed[table] = QU.observed_quarter(df, f"{table}-{name}", seed_total[0] if seed_total and table == "stop_cube" else None)
        SK.write_tables({table: df}, folder)

    def reason_then_cube():
        write_one("stop_cube_reason", rest_reason)
        write_one("stop_cube", CU.stop_cube(spark.read.parquet(f"{folder}/stop_cube_reason")))

    jobs = []
    if "stop_cube_reason" in rest and "stop_cube" in rest:
        rest_reason = rest.pop("stop_cube_reason")
        rest.pop("stop_cube")
        jobs.append(reason_then_cube)
    jobs += [lambda n=n, d=d: write_one(n, d) for n, d in rest.items()]
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        for f in [pool.submit(j) for j in jobs]:
            f.result()                                  # re-raise any failure
    back = {t: spark.read.parquet(f"{folder}/{t}") for t in tables}
    metrics = {t: o.get for t, o in observed.items()}
    if gate:
        QU.check_observed_quarters(metrics, most_recent_quarter)
    if seed_total is not None:
        QU.check_observed_total(metrics["stop_cube"], seed_total[1])
    SK.publish(spark, path, name, most_recent_quarter)
    return back


def build_analog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from ..sources import analog as A
    persons = A.persons(spark, sf_dir)
    out = build_all(persons, A.PERSON_ORDER, C.ANALOG["most_recent_quarter"],
                    persons_on_hin=A.persons_on_network(spark, sf_dir), shootings=A.shootings(spark, sf_dir),
                    cluster_keys=A.STOP_CLUSTER_KEYS, key_determined=True)
    # the population dimension (one row per district) is written with the cubes
    out["population"] = A.population(spark, sf_dir)
    return out


def hin_sample(persons: DataFrame, segments: DataFrame, year: int, n: int = 1000,
               d: float = C.HIN_DISTANCE, seed: int = 42) -> DataFrame:
    """Seeded sample of ``n`` locatable stops of one year, left-joined to the
    network segments within ``d`` (a stop near two roads appears twice)."""
    from ..operators import rank as RK
    from ..operators import spatial as SP
    p = persons.where((F.year("datetimeoccur") == year) & (F.col("point_y") < C.LOCATABLE_MAX_Y))
    s = RK.sample_n(p, n, ["cartodb_id", "objectid", "datetimeoccur", "location"], seed)
    j = SP.points_near_lines(s, segments, d, x="point_x", y="point_y", mode="all")
    return j.select(F.col("point_y").alias("lat"), F.col("point_x").alias("lng"),
                    F.lit(year).alias("year"), F.col("line_name").isNotNull().alias("on_hin"),
                    F.col("objectid").cast("string").alias("stops_objectid"), "location",
                    F.col("line_name").alias("stname"))


def _build_from_scans(spark: SparkSession, scan, present: Mapping[str, bool], out: str,
                      most_recent_quarter: str, psa_map: str | None, gate: bool, psa_label: str,
                      hin_lines: str | None, hin_line_name: str, sample_year: int | None,
                      sample_rows: int, sample_table: DataFrame | None = None,
                      seed_total: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """Shared tail of the folder and archive builds: ``scan(table)`` returns
    the typed person / shooting rows with ``_ordinal`` and ``_file``."""
    from ..operators import spatial as SP
    from ..session import remove_path, scratch_dir
    from ..sources import files as FS

    edges = None
    if psa_map is not None:
        edges = SP.polygon_edges(FS.read_geojson(spark, psa_map, psa_label))
    stop_key = ("_file", "datetimeoccur", "location")
    tables = {}
    staged = None
    if present["car_ped_stops"]:
        segs = FS.read_geojson_lines(spark, hin_lines, hin_line_name) if hin_lines is not None else None
        # no flagged files: the flags follow from the points and the network
        derive = segs is not None and not present["car_ped_stops_on_hin"]
        draw = segs is not None and sample_year is not None
        persons = scan("car_ped_stops")
        if edges is not None or derive or draw:
            # several tables come from the persons: one pass scans, remaps and
            # flags them, and observes the share of unknown places
            staged = scratch_dir(spark, "persons")
            if edges is not None:
                persons = remap_districts(persons, edges)
            if derive:
                persons = SP.network_flags(persons, segs, C.HIN_DISTANCE, C.LOCATABLE_MAX_Y)
            persons, unknown = QU.observed_unknown(persons, staged)
            persons.select(*[c for c in PERSON_COLUMNS if c in persons.columns]).write.parquet(staged)
            persons = spark.read.parquet(staged)
            if edges is not None:
                tables["quality_unknown_geometry"] = QU.unknown_row(spark, unknown.get, "car_ped_stops")
        tables.update(build_all(persons, ["_ordinal"], most_recent_quarter, stop_key=stop_key))
        if draw:
            tables["hin_sample"] = hin_sample(persons, segs, sample_year, sample_rows)
        if derive:
            tables["hin_cube"] = CU.hin_cube(persons, most_recent_quarter)
    if sample_table is not None:
        tables["hin_sample"] = sample_table
    if present["car_ped_stops_on_hin"]:
        h = scan("car_ped_stops_on_hin")
        h = remap_districts(h, edges) if edges is not None else h
        tables["hin_cube"] = CU.hin_cube(h, most_recent_quarter)
    if present["shootings"]:
        sh = scan("shootings")
        if edges is not None:
            sh = remap_districts(sh, edges, district_col="dist", psa_col=None)
        tables["shootings_cube"] = CU.shootings_cube(sh, most_recent_quarter)
    built = write_build(tables, out, most_recent_quarter, gate=gate, seed_total=seed_total)
    if staged is not None:
        remove_path(spark, staged)
    return built


def build_from_files(spark: SparkSession, csv_root: str, out: str, psa_map: str | None = None,
                     most_recent_quarter: str | None = None,
                     overrides: Mapping[str, str] | None = None, gate: bool = True,
                     psa_label: str = "PSA_NUM", hin_lines: str | None = None,
                     hin_line_name: str = "street_name", sample_year: int | None = None,
                     sample_rows: int = 1000, seed_total: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """The batch build over the real file layout (lifecycle A).

    ``csv_root`` holds ``<table>/<table>_year_<YYYY>.csv`` files and a
    ``summary.json`` per table folder.  ``overrides`` maps a file's base name
    to a replacement file (S3).  ``psa_map`` is the PSA GeoJSON used to merge
    districts 06/09 and re-derive their PSA (C5); without it no remap is done.
    """
    from ..functions.wkb import with_point
    from ..sources import files as FS
    from ..sources import schemas as SC

    if most_recent_quarter is None:
        most_recent_quarter = FS.check_latest_full_quarter(
            FS.read_summaries(spark, f"{csv_root}/*/summary.json"))
    files = spark.read.text(f"{csv_root}/*/*.csv").inputFiles()
    routed = FS.route_files(files, list(SC.TABLES))
    if overrides:
        astray = set(overrides) - {f.rsplit("/", 1)[-1] for lst in routed.values() for f in lst}
        if astray:
            raise ValueError(f"overrides that match no file: {sorted(astray)}")
        for t, lst in routed.items():
            routed[t] = [overrides.get(f.rsplit("/", 1)[-1], f) for f in lst]

    def scan(table):
        df = FS.scan_typed(spark, routed[table], SC.TABLES[table][0])
        return with_point(df) if "the_geom" in df.columns else df

    return _build_from_scans(spark, scan, {t: bool(v) for t, v in routed.items()}, out,
                             most_recent_quarter, psa_map, gate, psa_label, hin_lines,
                             hin_line_name, sample_year, sample_rows, seed_total=seed_total)


SAMPLE_MEMBER = "car_ped_stops_hin_random_sample"


def build_from_archive(spark: SparkSession, archive: str, out: str, psa_map: str | None = None,
                       most_recent_quarter: str | None = None,
                       overrides: Mapping[str, str] | None = None, gate: bool = True,
                       psa_label: str = "PSA_NUM", hin_lines: str | None = None,
                       hin_line_name: str = "street_name", sample_year: int | None = None,
                       sample_rows: int = 1000, seed_total: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """The batch build straight from a zip backup of ``csvs/<table>/...`` members.

    Members are routed to tables by name (an unknown CSV fails the build), a
    member named in ``overrides`` (base name -> other archive) is taken from
    that archive instead (S3), the quarter comes from the summaries inside
    the archive (S6) unless given, and a network sample member, if present,
    is kept as the sample table.  The executors read the members (S2).
    """
    from ..functions.wkb import with_point
    from ..sources import files as FS
    from ..sources import schemas as SC

    if most_recent_quarter is None:
        most_recent_quarter = FS.check_latest_full_quarter(FS.read_archive_summaries(spark, [archive]))
    members = FS.archive_members(spark, [archive])
    if overrides:
        other = None
        for base, other_archive in overrides.items():
            o = FS.archive_members(spark, [other_archive]).where(F.col("base") == base)
            if o.isEmpty():
                raise ValueError(f"{other_archive} has no member {base}")
            other = o if other is None else other.unionByName(o)
        members = FS.override_members(members, other)
    names = [r["member"] for r in members.select("member").collect()]   # names only
    sample_names = [n for n in names if SAMPLE_MEMBER in n]
    routed = FS.route_files([n for n in names if SAMPLE_MEMBER not in n], list(SC.TABLES))

    def scan(table):
        m = members.where(F.col("member").isin(routed[table]))
        df = FS.read_members(m, SC.TABLES[table][0])
        return with_point(df) if "the_geom" in df.columns else df

    sample = None
    if sample_names:
        sample = FS.read_members(members.where(F.col("member").isin(sample_names)), SAMPLE_SCHEMA) \
            .drop("_ordinal", "_file")
    return _build_from_scans(spark, scan, {t: bool(v) for t, v in routed.items()}, out,
                             most_recent_quarter, psa_map, gate, psa_label, hin_lines,
                             hin_line_name, sample_year, sample_rows, sample_table=sample, seed_total=seed_total)
