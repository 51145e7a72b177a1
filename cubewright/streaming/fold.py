"""Incremental cube build with Structured Streaming.

The reproduced build folds yearly person files one at a time into the cube
(concat + regroup).  Here new files landing in a folder are a file stream;
each micro-batch (``maxFilesPerTrigger`` files) is collapsed within its own
files, turned into a cube and merged into the cube table:

    table/data/v=<batch>/year=<y>   the merged cube of the years of the batch
    table/manifest/v=<batch>        year -> folder, for all years so far

A version rewrites only the years that its batch brings and names the folders
of the others, so what a batch reads and writes follows the batch and not the
table.  The manifest is written last and makes the version visible.

Every batch starts from the newest version older than itself, so a replayed
batch (after a failure, from the streaming checkpoint) rewrites the same
version: exactly-once without a transactional sink.  Versions beyond the
newest ``keep`` are removed once a newer one is visible, with the folders that
no version left names.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..operators import collapse as CO
from ..operators import cube as CU
from ..functions import timeq as TQ
from ..session import remove_path
from ..sources import files as FS

#: Versions kept: the newest, and the one that a replay of its batch starts from.
KEEP = 2
#: Files of a landing folder that are no person files.
BESIDE = ("summary.json",)
MANIFEST = "year int, folder string"


def _manifest_path(table: str, batch_id: int) -> str:
    return f"{table}/manifest/v={batch_id}"


def versions(spark: SparkSession, table: str) -> list[int]:
    """The written versions, oldest first (from the file listing, names only)."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
               .option("pathGlobFilter", "*.parquet"))
    try:
        files = listing.load(f"{table}/manifest").inputFiles()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted({int(m.group(1)) for f in files for m in [re.search(r"/v=(\d+)/", f)] if m})


def folders(spark: SparkSession, table: str, version: int) -> dict[int, str]:
    """{year: folder} of a version; one row a year.  Any error in reading a
    written manifest is raised."""
    return {r["year"]: r["folder"] for r in spark.read.schema(MANIFEST).parquet(_manifest_path(table, version)).collect()}


def latest_version(spark: SparkSession, table: str, before: int | None = None,
                   years: Sequence[int] | None = None) -> DataFrame | None:
    """The newest cube (optionally of a version older than batch ``before``, or
    of some years only); None where there is none."""
    have = [v for v in versions(spark, table) if before is None or v < before]
    if not have:
        return None
    chosen = [f for y, f in folders(spark, table, have[-1]).items() if years is None or y in years]
    return spark.read.parquet(*[f"{table}/{f}" for f in chosen]) if chosen else None


def remove_old(spark: SparkSession, table: str, keep: int = KEEP, known: Mapping[int, Mapping[int, str]] | None = None) -> list[str]:
    """Remove all but the newest ``keep`` versions and the folders that none of
    those names; returns what was removed.  ``known`` holds what ``folders`` gives
    for versions already read."""
    have = versions(spark, table)
    if len(have) <= keep:
        return []
    named = {v: (known or {}).get(v) or folders(spark, table, v) for v in have}
    used = {f for v in have[-keep:] for f in named[v].values()}
    gone = []
    for v in have[:-keep]:
        # the data first: a version without its manifest would never be found again
        gone += [f for f in named[v].values() if f not in used and f not in gone]
    for f in gone:
        remove_path(spark, f"{table}/{f}")
    for v in have[:-keep]:
        remove_path(spark, _manifest_path(table, v))
    return gone


def person_files(paths: Sequence[str]) -> list[str]:
    """The CSV files of a batch; files that are neither CSV nor known to lie
    beside them are an error."""
    names = {p: p.rsplit("/", 1)[-1] for p in paths}
    astray = sorted(p for p, n in names.items() if ".csv" not in n and n not in BESIDE)
    if astray:
        raise ValueError(f"landed files that are no CSV: {astray}")
    return [p for p, n in names.items() if ".csv" in n]


def fold_batch(files: DataFrame, batch_id: int, table: str, schema: T.StructType,
               most_recent_quarter: str, stop_key: Sequence[str], keep: int = KEEP) -> None:
    """foreachBatch body: the batch's files (``path``) -> typed rows, by the
    same scan as the one-pass build -> stops (within file) -> cube -> merge
    with the same years of the version before."""
    spark = files.sparkSession
    paths = person_files([r["path"] for r in files.select("path").collect()])   # names of the batch's files
    # a batch without rows makes a version all the same, of the version before
    typed = FS.scan_typed(spark, paths, schema) if paths else FS.no_rows(spark, schema)
    stops = CO.classify_stops(CO.collapse_stops(typed, ["_ordinal"], ["_file", *stop_key]))
    cube = CU.stop_cube_reason(stops, most_recent_quarter).select(*C.REASON_KEYS, *C.STOP_MEASURES, "year")
    brought = f"{table}/incoming/v={batch_id}"
    cube.write.mode("overwrite").parquet(brought)
    # the shape of a cube is known: no job looks for it in the files
    batch = spark.read.schema(cube.schema).parquet(brought)
    years = sorted(r["year"] for r in batch.select("year").distinct().collect())

    have = [v for v in versions(spark, table) if v < batch_id]
    before = folders(spark, table, have[-1]) if have else {}
    data = f"data/v={batch_id}"
    if years:
        parts = [batch]
        same = [f"{table}/{before[y]}" for y in years if y in before]
        if same:
            parts.append(spark.read.schema(cube.drop("year").schema).parquet(*same))
        merged = CU.merge_cubes(parts, C.REASON_KEYS, C.STOP_MEASURES)
        year = F.substring("quarter", 1, 4).cast("int")
        merged.withColumn("year", year).repartition("year").write.mode("overwrite").partitionBy("year").parquet(f"{table}/{data}")
    named = before | {y: f"{data}/year={y}" for y in years}
    spark.createDataFrame(sorted(named.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(_manifest_path(table, batch_id))
    remove_path(spark, brought)
    remove_old(spark, table, keep, {batch_id: named} | ({have[-1]: before} if have else {}))


def start_fold(spark: SparkSession, landing: str, table: str, checkpoint: str,
               schema: T.StructType, most_recent_quarter: str,
               stop_key: Sequence[str] = ("datetimeoccur", "location"),
               files_per_batch: int = 1, available_now: bool = True, keep: int = KEEP):
    """Start the fold stream over the CSV files that land in a folder; returns
    the StreamingQuery.  The stream itself carries file names only; a file that
    is no CSV fails it."""
    shape = "path string, modificationTime timestamp, length long, content binary"
    stream = (spark.readStream.format("binaryFile").schema(shape)
              .option("maxFilesPerTrigger", files_per_batch)
              .load(landing).select("path"))
    w = (stream.writeStream
         .foreachBatch(lambda df, bid: fold_batch(df, bid, table, schema, most_recent_quarter, stop_key, keep))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def final_cube(spark: SparkSession, table: str) -> DataFrame:
    """The newest cube version with its calendar columns."""
    df = latest_version(spark, table)
    if df is None:
        raise ValueError("no cube version written yet")
    return TQ.add_calendar(df.select(*C.REASON_KEYS, *C.STOP_MEASURES))
