"""Registered queries for the file sources and sinks.

The inputs are files *derived from the test tables by Spark*: the person
rows are written as yearly CSV members into a scratch folder under the
session's checkpoint folder, then scanned back through the typed scan.  The
results must equal the ones computed straight from the parquet tables, so
these keys reuse the oracles of the parquet path.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import collapse as CO
from ..functions import timeq as TQ
from ..functions.wkb import with_point
from ..operators import cube as CU
from ..operators import quality as QU
from ..operators import spatial as SP
from ..operators.remap import remap_districts
from ..session import scratch_dir
from ..sources import analog as A
from ..sources import archive as AR
from ..sources import files as FS
from ..sources import sinks as SK

#: Persons of a written archive, which is one task's work.
ARCHIVE_ROWS = 1_000_000

TABLE = "car_ped_stops"
STOP_KEY = ["source_year", "datetimeoccur", "location"]
FILE_ORDER = [*STOP_KEY, *A.PERSON_ORDER]


def _persons_text(spark: SparkSession, sf_dir: str, root: str, compression: str = "gzip") -> tuple[str, object]:
    sources = A.person_sources(spark, sf_dir)
    schema = FS.schema_of(A.as_persons(sources).drop("l_orderkey"))
    # the files' columns stand in another order than the schema's: a scan binds
    # them by name
    path = FS.write_member_csvs(sources, root, TABLE, "source_year", FILE_ORDER, group_cols=STOP_KEY,
                                columns=sorted(schema.names, reverse=True), compression=compression,
                                derive=lambda rows: A.as_persons(rows, "member"))
    return path, schema


def _scan(spark: SparkSession, paths, schema) -> DataFrame:
    return FS.scan_typed(spark, paths, schema)


def _routed_files(spark: SparkSession, path: str) -> list[str]:
    files = spark.read.text(path).inputFiles()
    routed = FS.route_files(files, [TABLE])
    return routed[TABLE]


def _after_blank_lines(spark: SparkSession, file: str, out: str) -> list[str]:
    """A copy of a file, packed as it is, that begins with blank lines."""
    def lead(batches):
        yield pa.RecordBatch.from_arrays([pa.array(["", "  "])], names=["value"])
        yield from batches

    spark.read.text(file).coalesce(1).mapInArrow(lead, "value string").write.option("compression", "gzip").text(out)
    return list(spark.read.text(out).inputFiles())


def q_scan_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly person CSVs, one of which begins with blank lines -> typed scan ->
    file-order drivers -> reason cube."""
    root = scratch_dir(spark, "csv")
    path, schema = _persons_text(spark, sf_dir, root)
    first, *rest = sorted(_routed_files(spark, path))
    persons = _scan(spark, [*_after_blank_lines(spark, first, f"{root}/blank"), *rest], schema)
    stops = CO.classify_stops(CO.collapse_stops(persons, ["_ordinal"]))
    cube = CU.stop_cube_reason(stops, C.ANALOG["most_recent_quarter"])
    return cube.select(*C.REASON_KEYS, *C.STOP_MEASURES, "year", "q_str")


def q_stop_cube_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly person CSVs -> typed scan -> stored table -> stops by codes, each
    value classified once -> reason cube (A1, J2, C2)."""
    root = scratch_dir(spark, "csv")
    path, schema = _persons_text(spark, sf_dir, root)
    _scan(spark, _routed_files(spark, path), schema).write.option("compression", "zstd").parquet(f"{root}/persons")
    persons = spark.read.parquet(f"{root}/persons")
    stops = CO.coded_stops(persons, CO.find_codes(persons), STOP_KEY)
    return CU.stop_cube_reason(stops, C.ANALOG["most_recent_quarter"]).select(*C.REASON_KEYS, *C.STOP_MEASURES, "year", "q_str")


def q_row_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver of each stop = first person in file order."""
    root = scratch_dir(spark, "csv")
    path, schema = _persons_text(spark, sf_dir, root)
    persons = _scan(spark, _routed_files(spark, path), schema)
    s = CO.collapse_stops(persons, ["_ordinal"])
    return s.select("source_year", "location",
                    F.col("driver.race").alias("driver_race"),
                    F.col("driver.gender").alias("driver_gender"),
                    F.col("driver.age").alias("driver_age"))


OVERRIDE_YEAR = 1997


def q_scan_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One yearly member replaced by the same-named member of another backup (S3).

    The replacement for 1997 holds only that year's vehicle rows.
    """
    root = scratch_dir(spark, "csv")
    base_path, schema = _persons_text(spark, sf_dir, f"{root}/base")
    p = A.persons(spark, sf_dir).drop("l_orderkey")
    repl = p.where((F.col("source_year") == OVERRIDE_YEAR) & (F.col("stoptype") == "vehicle"))
    over_path = FS.write_member_csvs(repl, f"{root}/override", TABLE, "source_year", FILE_ORDER,
                                     group_cols=STOP_KEY, compression="gzip")

    def members(path):
        files = spark.read.text(path).inputFiles()
        rows = [(path, f, f.split("/")[-2]) for f in files if ".csv" in f.rsplit("/", 1)[-1]]
        return spark.createDataFrame(rows, "archive string, member string, base string")

    chosen = FS.override_members(members(base_path), members(over_path))
    paths = [r["member"] for r in chosen.select("member").collect()]  # file names only
    persons = _scan(spark, paths, schema)
    return persons.groupBy("source_year", "stoptype").agg(F.count(F.lit(1)).alias("n_people"))


def _zipped(spark: SparkSession, sources: DataFrame, root: str) -> list[str]:
    """Person rows, of their sources, as zip archives of yearly CSV members with
    a summary each; the persons of a stop stay in one member."""
    n, last = sources.agg(F.count(F.lit(1)), F.max("datetimeoccur").cast("date").cast("string")).first()
    archives = max(2, -(-n // ARCHIVE_ROWS))
    columns = sorted(A.as_persons(sources).drop("l_orderkey").columns, reverse=True)
    rows = sources.withColumn("archive", F.pmod(F.xxhash64(*STOP_KEY), F.lit(archives)).cast("int"))
    name = F.concat(F.lit(f"csvs/{TABLE}/{TABLE}_year_"), F.col("source_year").cast("string"), F.lit("_"), F.col("archive").cast("string"), F.lit(".csv"))
    rows = rows.withColumn("member", name)
    # one line an archive, so each archive has rows
    summary = spark.range(archives).select(F.col("id").cast("int").alias("archive"), F.lit(f"csvs/{TABLE}/summary.json").alias("member"),
                                           F.to_json(F.struct(F.lit(last).cast("string").alias("last_dt"))).alias("text"))

    def lines(rows):
        line = F.to_csv(F.struct(*columns), {"escape": '"', "quote": '"'})
        return A.as_persons(rows, "member", "text").select("member", F.coalesce("text", line).alias("line"))

    return AR.write_archives(rows.unionByName(summary, allowMissingColumns=True), root, archives, FILE_ORDER[1:], lines, ",".join(columns))


def q_scan_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person rows written as zip archives, listed, routed and scanned back ->
    file-order drivers -> reason cube (S2)."""
    sources = A.person_sources(spark, sf_dir)
    archives = _zipped(spark, sources, f"{scratch_dir(spark, 'zip')}/backup")
    members = FS.archive_members(spark, archives)
    FS.route_files([r["member"] for r in members.select("member").collect()], [TABLE])  # names only
    persons = FS.read_members(members, FS.schema_of(A.as_persons(sources).drop("l_orderkey")))
    stops = CO.classify_stops(CO.collapse_stops(persons, ["_ordinal"]))
    return CU.stop_cube_reason(stops, C.ANALOG["most_recent_quarter"]).select(*C.REASON_KEYS, *C.STOP_MEASURES, "year", "q_str")


def q_archive_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries inside the archives: last date and last full quarter."""
    archives = _zipped(spark, A.person_sources(spark, sf_dir), f"{scratch_dir(spark, 'zip')}/backup")
    return FS.read_archive_summaries(spark, archives).select(
        "table", "last_dt", TQ.previous_full_quarter(F.to_date("last_dt")).alias("quarter")).distinct()


def q_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason cube written partitioned by year, read back."""
    from .analog_tables import AnalogTables
    root = scratch_dir(spark, "tables")
    t = AnalogTables(spark, sf_dir)
    SK.write_tables({"stop_cube_reason": t.reason_cube()}, root)
    back = SK.read_table(spark, root, "stop_cube_reason")
    return back.select(*C.REASON_KEYS, *C.STOP_MEASURES, "year", "q_str")


def q_dim_population_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population written as CSV and scanned back with text keys."""
    root = scratch_dir(spark, "dims")
    A.population(spark, sf_dir).write.mode("overwrite").option("header", True).csv(f"{root}/pop")
    return FS.scan_dim_csv(spark, f"{root}/pop", ["district"],
                           ["total", "white", "black", "asian", "hispanic_or_latino",
                            "american_indian", "unknown"])


def q_incremental_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly person files folded into the cube a few files per micro-batch
    (Structured Streaming, A4); equals the one-pass build."""
    from ..streaming import fold as SF
    root = scratch_dir(spark, "fold")
    # a batch is few files: plain ones are split among the tasks
    path, schema = _persons_text(spark, sf_dir, f"{root}/landing", "none")
    q = SF.start_fold(spark, f"{path}/*", f"{root}/cube", f"{root}/_checkpoint", schema,
                      C.ANALOG["most_recent_quarter"], stop_key=("source_year", "datetimeoccur", "location"),
                      files_per_batch=8, available_now=True)
    q.awaitTermination()
    cube = SF.final_cube(spark, f"{root}/cube")
    return cube.select(*C.REASON_KEYS, *C.STOP_MEASURES, "year", "q_str")


def q_json_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries written as JSON per table and scanned back: last date, last
    complete quarter, and whether the tables agree (S6, Q2)."""
    root = scratch_dir(spark, "summaries")
    for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        (A.table(spark, sf_dir, t).agg(F.max(c).cast("date").cast("string").alias("last_dt"))
         .write.json(f"{root}/{t}/summary.json"))
    s = FS.read_summaries(spark, f"{root}/*/summary.json")
    s = s.withColumn("quarter", TQ.previous_full_quarter(F.to_date("last_dt")))
    agree = QU.agree_report(s)
    return s.select("table", "last_dt", "quarter").unionByName(
        agree.select(F.lit("*").alias("table"), F.lit(None).cast("string").alias("last_dt"),
                     F.when(F.col("ok"), F.col("quarter")).alias("quarter")))


def q_wkb_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test points written as hex EWKB, decoded in SQL."""
    import struct

    def encode(batches):
        for pdf in batches:
            hexes = [struct.pack("<BIIdd", 1, 1 | 0x20000000, 4326, x, y).hex() for x, y in zip(pdf["x"], pdf["y"])]
            yield pdf[["vec_id"]].assign(the_geom=hexes)

    pts = A.points(spark, sf_dir).select("vec_id", "x", "y").mapInPandas(encode, "vec_id long, the_geom string")
    pts = pts.withColumn("point_x", F.lit(None).cast("double")).withColumn("point_y", F.lit(None).cast("double"))
    return with_point(pts).select("vec_id", F.col("point_x").alias("x"), F.col("point_y").alias("y"))


def q_unknown_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons whose PSA is unknown after the district merge."""
    edges = SP.polygon_edges(A.polygons(spark))
    return QU.unknown_geometry(remap_districts(A.persons(spark, sf_dir), edges), "persons")


QUERIES = {
    "json_summaries": q_json_summaries,
    "wkb_points": q_wkb_points,
    "unknown_geometry": q_unknown_geometry,
    "scan_typed": q_scan_typed,
    "stop_cube_coded": q_stop_cube_coded,
    "row_ordinal": q_row_ordinal,
    "scan_override": q_scan_override,
    "scan_archive": q_scan_archive,
    "archive_summaries": q_archive_summaries,
    "sink_roundtrip": q_sink_roundtrip,
    "dim_population_csv": q_dim_population_csv,
    "incremental_fold": q_incremental_fold,
}
