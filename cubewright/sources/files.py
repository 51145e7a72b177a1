"""File sources: typed CSV scans, file-order ordinals, archives, overrides,
summary files, dimension CSVs and GeoJSON maps (S1-S4, S6-S8).

* CSVs are read with every column as text and bound by the names in each
  file's own header (absent columns are null, further ones are ignored), with
  RFC-4180 quotes; the null markers of the reproduced reader are mapped to
  null, and only then are columns cast to their declared types (a bad value
  fails the job: ANSI casts).  A line end inside quotes needs ``multi_line``,
  which reads a file in one task; without it such a file fails the job.
* The file-order ordinal is taken *at the scan*: (file path, split start,
  monotonically increasing id).  Within one split the id follows the file;
  splits of one file are ordered by their start; so the tuple orders all
  rows of all files the way they appear on disk.
* Headers (the first line that is not blank) are read from the files' beginnings
  through Spark's file system on the driver; one job finds those further on,
  whatever the number of files.
* Zip archives are read by the executors (``archive``): one task per member
  streams the member in chunks and yields rows with their ordinal.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import timeq as TQ
from . import archive as AR

# ---------------------------------------------------------------------------
# FIXED VALUES: strings the reproduced CSV reader treats as missing
# (the default NA list of its reader)
# ---------------------------------------------------------------------------
NULL_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                "nan", "null"]


def _text(name: str) -> Column:
    """A column of a file without the null markers; one SQL expression, since
    the driver makes one a column of every batch."""
    c = "`" + name.replace("`", "``") + "`"
    markers = ", ".join(f"'{m}'" for m in NULL_MARKERS)
    return F.expr(f"CASE WHEN {c} IN ({markers}) THEN NULL ELSE {c} END")


def _typed(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.StringType):
        return c
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.to_timestamp(c)
    if isinstance(dt, (T.IntegerType, T.LongType)):
        # integer columns may be written with a decimal point (1.0)
        return F.coalesce(c.try_cast(dt), c.cast("decimal(38,6)").cast(dt))
    return c.cast(dt)


CSV_OPTIONS = {"header": True, "mode": "FAILFAST", "quote": '"', "escape": '"'}
_BLANK = "".join(map(chr, range(33)))
#: Bytes of a file in which the driver looks for its header.
BEGINNING = 1 << 13


def _first_records(spark: SparkSession, paths: str | Sequence[str], multi_line: bool) -> DataFrame:
    """(file, start, record) of every split of the files: its first line that
    is not blank, or null.  A task has one split and stops reading there; a
    session of its own holds the settings for that."""
    own = spark.newSession()
    for k, v in (("spark.sql.files.maxPartitionBytes", 1 << 30), ("spark.sql.files.openCostInBytes", 1 << 30),
                 ("spark.sql.files.minPartitionNum", 1), ("spark.sql.execution.arrow.maxRecordsPerBatch", 64)):
        own.conf.set(k, str(v))

    def first(batches):
        at, lines = None, []
        for b in batches:
            for file, start, line in zip(*[c.to_pylist() for c in b.columns], strict=True):
                at = file, start
                if lines or line.strip(_BLANK):
                    lines.append(line)
                    # a quoted name may go on in the next line
                    if not multi_line or sum(x.count('"') for x in lines) % 2 == 0:
                        yield row(at, "\n".join(lines))
                        return
        if at:
            yield row(at, "\n".join(lines) or None)

    def row(at, record):
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([record], pa.string())], names=["file", "start", "record"])

    return (own.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
            .mapInArrow(first, "file string, start long, record string"))


def _first_record(data: bytes, whole: bool, multi_line: bool) -> str | None:
    """The first record of a file's beginning; None where it is not all there."""
    text = data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    *lines, last = re.split(r"\r\n|\n|\r", text)
    if whole:
        lines.append(last)
    got: list[str] = []
    for line in lines:
        if got or line.strip(_BLANK):
            got.append(line)
            # a quoted name may go on in the next line
            if not multi_line or sum(x.count('"') for x in got) % 2 == 0:
                return "\n".join(got)
    return None


def _beginnings(spark: SparkSession, files: Iterable[str], multi_line: bool) -> list[str | None]:
    """The first record of each file, where it lies within the first ``BEGINNING``
    bytes: read by Spark's file system, several files at once."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(file: str) -> str | None:
        path = jvm.org.apache.hadoop.fs.Path(file)
        codec = codecs.getCodec(path)
        stream = path.getFileSystem(conf).open(path)
        try:
            data = (codec.createInputStream(stream) if codec else stream).readNBytes(BEGINNING)
        finally:
            stream.close()
        return _first_record(data, len(data) < BEGINNING, multi_line)

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(first, files))


def csv_headers(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False) -> dict[tuple[str, ...], list[str]]:
    """Column names -> the files that have them, in that order.  The header is
    the first line that is not blank; a file that holds blank lines only is an
    error, an empty file has no rows.  The driver reads the files' beginnings;
    one job reads the files whose header is not within them.  The driver holds
    names only."""
    files = {AR.path_key(f): unquote(f) for f in spark.read.text(paths).inputFiles()}
    records = {k: r for k, r in zip(files, _beginnings(spark, files.values(), multi_line), strict=True) if r is not None}
    late = {k: f for k, f in files.items() if k not in records}
    if late:
        found = (_first_records(spark, sorted(late.values()), multi_line).groupBy("file")
                 .agg(F.min_by("record", F.when(F.col("record").isNotNull(), F.col("start"))).alias("record"),
                      F.min(F.when(F.col("record").isNotNull(), F.col("start"))).alias("start")).collect())
        astray = sorted(r["file"] for r in found if r["record"] is None or r["start"])
        if astray:
            raise ValueError(f"no header at the beginning of {astray}")
        records |= {AR.path_key(r["file"]): r["record"] for r in found}
    out: dict[tuple[str, ...], list[str]] = {}
    for k in sorted(records):
        names = tuple(x or "" for x in next(csv.reader(io.StringIO(records[k].lstrip("\ufeff"), newline=""))))
        out.setdefault(names, []).append(files[k])
    empty = sorted(f for k, f in files.items() if k not in records)   # without a line
    if empty:
        full = [r["path"] for r in spark.read.format("binaryFile").load(empty).where("length > 0").select("path").collect()]
        if full:
            raise ValueError(f"no header found in {full}")
    return out


def scan_typed(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType,
               with_ordinal: bool = True, multi_line: bool = False) -> DataFrame:
    """Typed CSV scan with header (S1) plus the file-order ordinal.

    Columns are bound by name; those missing from a file are null.  The
    ``_ordinal`` struct orders rows by their position on disk.
    """
    def one(names: tuple[str, ...], files: list[str]) -> DataFrame:
        own = [f"c{i}" for i in range(len(names))]
        text = T.StructType([T.StructField(c, T.StringType()) for c in own])
        raw = spark.read.schema(text).options(**CSV_OPTIONS).option("multiLine", multi_line).csv(files)
        at = {n: c for n, c in reversed(list(zip(names, own, strict=True)))}
        cols = [_typed(_text(at[f.name]) if f.name in at else F.lit(None).cast("string"), f.dataType).alias(f.name)
                for f in schema.fields]
        if with_ordinal:
            cols.append(F.struct(F.col("_metadata.file_path").alias("file"),
                                 F.col("_metadata.file_block_start").alias("start"),
                                 F.monotonically_increasing_id().alias("row")).alias("_ordinal"))
            cols.append(F.col("_metadata.file_path").alias("_file"))
        return raw.select(*cols)

    parts = [one(n, f) for n, f in csv_headers(spark, paths, multi_line).items()]
    return reduce(DataFrame.unionByName, parts) if parts else no_rows(spark, schema, with_ordinal)


def no_rows(spark: SparkSession, schema: T.StructType, with_ordinal: bool = True) -> DataFrame:
    """A scan of no files."""
    none = spark.createDataFrame([], schema)
    if with_ordinal:
        none = none.select("*", F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("start"),
                                         F.lit(0).cast("long").alias("row")).alias("_ordinal"), F.lit("").alias("_file"))
    return none


def route_files(files: Iterable[str], tables: Sequence[str]) -> dict[str, list[str]]:
    """Assign each CSV file to the table whose ``<name>_year`` prefix it carries.

    A CSV that matches no table is an error (S2 routing).
    """
    out: dict[str, list[str]] = {t: [] for t in tables}
    for f in files:
        if not f.endswith(".csv") and ".csv" not in f.rsplit("/", 1)[-1]:
            continue
        hit = [t for t in sorted(tables, key=len, reverse=True) if f"{t}_year" in f]
        if not hit:
            raise ValueError(f"{f} has no matching table prefix")
        out[hit[0]].append(f)
    return out


# ---------------------------------------------------------------------------
# archives
# ---------------------------------------------------------------------------

def archive_members(spark: SparkSession, archives: Sequence[str]) -> DataFrame:
    """(archive, member, base) and the place of every CSV member of every
    archive.  Only the zip directories are read here (names, no data)."""
    return spark.createDataFrame([r for r in AR.list_members(spark, archives) if r[1].endswith(".csv")], AR.MEMBER)


def override_members(members: DataFrame, overrides: DataFrame) -> DataFrame:
    """Members replaced by same-named members of another archive (S3).  An
    override that replaces nothing is an error."""
    astray = [r["base"] for r in overrides.join(members.select("base"), "base", "left_anti").select("base").collect()]
    if astray:                                          # member names only
        raise ValueError(f"overrides that match no member: {astray}")
    keep = members.join(overrides.select("base"), "base", "left_anti")
    return keep.unionByName(overrides.join(members.select("base"), "base", "left_semi"))


def read_members(members: DataFrame, schema: T.StructType, chunk_rows: int = 200_000) -> DataFrame:
    """Rows of the listed archive members (one task per member).

    Each member is streamed in chunks of ``chunk_rows`` rows; every row gets
    ``_member`` and ``_row`` (its position in the member, i.e. file order).
    """
    import pandas as pd

    names = [f.name for f in schema.fields]
    out_schema = T.StructType([T.StructField(n, T.StringType()) for n in names] +
                              [T.StructField("_member", T.StringType()),
                               T.StructField("_row", T.LongType())])

    def read(archive, member, stream):
        pos = 0
        for chunk in pd.read_csv(io.TextIOWrapper(stream, encoding="utf-8"), dtype=str,
                                 keep_default_na=False, chunksize=chunk_rows):
            chunk = chunk.reindex(columns=names).astype(object)
            chunk = chunk.where(chunk.notna(), None)      # absent columns are null
            chunk["_member"] = member
            chunk["_row"] = range(pos, pos + len(chunk))
            pos += len(chunk)
            yield chunk

    raw = AR.map_members(members, read, out_schema)
    cols = [_typed(_text(f.name), f.dataType).alias(f.name) for f in schema.fields]
    return raw.select(*cols, F.struct(F.col("_member").alias("file"),
                                      F.col("_row").alias("row")).alias("_ordinal"),
                      F.col("_member").alias("_file"))


# ---------------------------------------------------------------------------
# summary files, dimension CSVs, GeoJSON
# ---------------------------------------------------------------------------

def read_summaries(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``summary.json`` files -> (table = parent folder name, last_dt)."""
    df = spark.read.option("multiLine", True).json(paths)
    if "last_dt" not in df.columns:
        df = df.withColumn("last_dt", F.lit(None).cast("string"))
    # a summary may be a file or a folder that Spark wrote
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/summary\.json(?:/[^/]+)?$", 1)
    return df.select(folder.alias("table"), F.col("last_dt").cast("string").alias("last_dt"))


def read_archive_summaries(spark: SparkSession, archives: Sequence[str]) -> DataFrame:
    """``csvs/<table>/summary.json`` members of zip archives -> (table, last_dt).

    The driver lists member names; the executors read the (small) JSON
    members.  A table folder without a summary gets a row with a null date,
    which :func:`check_latest_full_quarter` rejects.
    """
    import json

    import pandas as pd

    listed = AR.list_members(spark, archives)
    summaries = [r for r in listed if re.fullmatch(r"csvs/[^/]+/summary\.json", r[1])]
    have = {(r[0], r[1].split("/")[1]) for r in summaries}
    lacking = sorted({(r[0], r[1].split("/")[1]) for r in listed if r[1].startswith("csvs/") and r[1].count("/") >= 2} - have)

    def read(archive, member, stream):
        last = json.loads(stream.read()).get("last_dt")
        yield pd.DataFrame([(member.split("/")[1], None if last is None else str(last))], columns=["table", "last_dt"])

    shape = "table string, last_dt string"
    return AR.map_members(spark.createDataFrame(summaries, AR.MEMBER), read, shape).unionByName(
        spark.createDataFrame([(t, None) for _, t in lacking], shape))


def check_latest_full_quarter(summaries: DataFrame) -> str:
    """Raise unless every table has a date and all agree; return the quarter."""
    r = (summaries.select("table", "last_dt",
                          TQ.previous_full_quarter(F.to_date("last_dt")).alias("quarter"))
         .agg(F.countDistinct("quarter").alias("n"), F.min("quarter").alias("q"),
              F.sum(F.col("last_dt").isNull().cast("int")).alias("missing")).collect()[0])
    if r["missing"]:
        raise ValueError("'last_dt' missing in a summary")
    if r["n"] != 1:
        raise ValueError(f"tables disagree on the most recent quarter ({r['n']} distinct)")
    return r["q"]


def scan_dim_csv(spark: SparkSession, path: str, key_cols: Sequence[str],
                 count_cols: Sequence[str] = ()) -> DataFrame:
    """Dimension CSV: keys stay text (leading zeros kept), counts become ints."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(*[F.col(c).cast("string") for c in key_cols],
                     *[F.col(c).cast("long").alias(c) for c in count_cols])


_GEOM = T.StructType([T.StructField("type", T.StringType()),
                      T.StructField("coordinates", T.StringType())])


def read_geojson(spark: SparkSession, path: str, label_prop: str) -> DataFrame:
    """FeatureCollection -> (pos, label, rings) for Polygon / MultiPolygon.

    ``rings`` is an array of closed rings (array of [x, y]); all rings of a
    feature (holes and parts) belong to it, which is what the even-odd test
    needs.
    """
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StringType())])))])
    fc = spark.read.schema(schema).option("multiLine", True).json(path)
    f = fc.select(F.posexplode("features").alias("pos", "f"))
    g = F.from_json(F.col("f.geometry"), _GEOM)
    ring3 = "array<array<array<double>>>"
    ring4 = "array<array<array<array<double>>>>"
    rings = (F.when(g["type"] == "Polygon", F.from_json(g["coordinates"], ring3))
              .when(g["type"] == "MultiPolygon", F.flatten(F.from_json(g["coordinates"], ring4))))
    return f.select("pos", F.col("f.properties").getItem(label_prop).alias("label"),
                    rings.alias("rings"))


def read_geojson_lines(spark: SparkSession, path: str, name_prop: str) -> DataFrame:
    """LineString / MultiLineString features -> one row per segment
    ``(name, x1, y1, x2, y2)`` (the network lines of J10)."""
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StringType())])))])
    fc = spark.read.schema(schema).option("multiLine", True).json(path)
    f = fc.select(F.explode("features").alias("f"))
    g = F.from_json(F.col("f.geometry"), _GEOM)
    lines = (F.when(g["type"] == "LineString",
                    F.array(F.from_json(g["coordinates"], "array<array<double>>")))
              .when(g["type"] == "MultiLineString",
                    F.from_json(g["coordinates"], "array<array<array<double>>>")))
    ln = f.select(F.col("f.properties").getItem(name_prop).alias("name"),
                  F.explode(lines).alias("line"))
    n = F.size("line") - 1
    seg = ln.select("name", F.explode(F.arrays_zip(F.slice("line", 1, n).alias("a"),
                                                   F.slice("line", 2, n).alias("b"))).alias("s"))
    return seg.select("name", F.col("s.a")[0].alias("x1"), F.col("s.a")[1].alias("y1"),
                      F.col("s.b")[0].alias("x2"), F.col("s.b")[1].alias("y2"))


# ---------------------------------------------------------------------------
# writing person files (fixture side: derived from the tables)
# ---------------------------------------------------------------------------

def write_member_csvs(df: DataFrame, root: str, table: str, year_col: str,
                      order_cols: Sequence[str], group_cols: Sequence[str] | None = None,
                      columns: Sequence[str] | None = None, compression: str = "none",
                      derive: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Write ``df`` as yearly CSV members ``<root>/<table>/member=<table>_year_<Y>/``.

    Rows are range-partitioned by ``group_cols`` (a prefix of ``order_cols``,
    e.g. the stop key: equal keys always land in the same part file, so no
    stop spans two files) and sorted by ``order_cols`` within each file, so
    the file order on disk *is* that order (part files are numbered in range
    order).  The session decides on the number of ranges.  ``columns`` is the
    order of the columns in the files.  A file packed by ``compression`` is read
    by one task; it holds no more than a range.  ``derive`` makes the files'
    rows of the dealt and sorted ones, row by row; it keeps ``member``.
    """
    out = f"{root}/{table}"
    member = F.concat(F.lit(f"{table}_year_"), F.col(year_col).cast("string"))
    # sorted by member first: the partitioned writer then keeps this order
    # (otherwise it re-sorts each task by member and loses the row order)
    rows = (df.withColumn("member", member)
              .repartitionByRange(*(group_cols or order_cols))
              .sortWithinPartitions("member", *order_cols))
    columns = columns or df.columns
    if derive:
        rows = derive(rows)
    (rows.select(*columns, "member")
       .write.mode("overwrite").option("header", True).option("escape", '"')
       .option("compression", compression).partitionBy("member").csv(out))
    return out


def schema_of(df: DataFrame, drop: Iterable[str] = ()) -> T.StructType:
    d = set(drop)
    return T.StructType([f for f in df.schema.fields if f.name not in d])


def file_year(path_col: Column) -> Column:
    return F.regexp_extract(path_col, r"_year_(\d{4})", 1).cast("int")

