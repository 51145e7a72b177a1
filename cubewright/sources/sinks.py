"""Sinks: cube tables, chart rows, KPI rows and GeoJSON features.

Everything is written by the executors (``df.write``); nothing is collected
to the driver.  Cube tables are partitioned by ``year`` so the report
filters prune whole directories.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import rank as RK
from ..operators import spatial as SP


#: Columns that reports select places and quarters by; tables are sorted by
#: them within a file, and the places have Bloom filters.
SKIP_BY, BLOOM = ("districtoccur", "psa", "quarter"), ("districtoccur", "psa")


def write_tables(tables: Mapping[str, DataFrame], path: str, partition_by: str | None = "year") -> None:
    """Replace each table under ``path/<name>`` (S9), laid out so that a report
    on a place or a quarter skips most row groups: rows are sorted by place and
    quarter within each file, so row groups hold narrow ranges (P1, P3)."""
    for name, df in tables.items():
        by = [partition_by] if partition_by and partition_by in df.columns else []
        skip = [c for c in SKIP_BY if c in df.columns]
        if skip:
            df = df.sortWithinPartitions(*by, *skip)
        w = df.write.mode("overwrite")
        for c in BLOOM:
            if c in skip:
                w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
        if by:
            w = w.partitionBy(*by)
        w.parquet(f"{path}/{name}")


def row_groups(spark, path: str, name: str) -> DataFrame:
    """(file, row_group, rows, column, least, most) of a written table's place
    and quarter columns, from the files' footers: how much a location leaves to
    read."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    def footers(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                meta = pq.ParquetFile(pa.BufferReader(content)).metadata
                rows = [(file, g, meta.row_group(g).num_rows, c.path_in_schema, c.statistics.min, c.statistics.max)
                        for g in range(meta.num_row_groups) for c in (meta.row_group(g).column(i) for i in range(meta.num_columns))
                        if c.path_in_schema in SKIP_BY and c.statistics is not None and c.statistics.has_min_max]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)],
                                                     names=["file", "row_group", "rows", "column", "least", "most"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{published(spark, path)}/{name}")
    return files.select("path", "content").mapInArrow(footers, "file string, row_group int, rows long, column string, least string, most string")


def published(spark, path: str) -> str:
    """The folder of the newest published build under ``path``; ``path``
    itself where tables were written to it directly."""
    try:
        settings = spark.read.parquet(f"{path}/settings")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return path
    if "build" not in settings.columns:
        return path
    return f"{path}/{settings.agg(F.max_by('build', 'published_at')).first()[0]}"


def publish(spark, path: str, build: str, most_recent_quarter: str) -> None:
    """Make a written build the one that readers get: one row more in
    ``settings``.  Readers of the build before keep its tables."""
    (spark.range(1).select(F.lit(most_recent_quarter).alias("most_recent_quarter"), F.lit(build).alias("build"),
                           F.current_timestamp().alias("published_at"))
     .write.mode("append").parquet(f"{path}/settings"))


def most_recent_quarter(spark, path: str) -> str:
    settings = spark.read.parquet(f"{path}/settings")
    if "build" not in settings.columns:
        return settings.select("most_recent_quarter").first()[0]
    return settings.agg(F.max_by("most_recent_quarter", "published_at")).first()[0]


def read_table(spark, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{published(spark, path)}/{name}")


def write_rows(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Chart/KPI rows as JSON lines (S11); NaN/Inf never occur (try_divide)."""
    df.write.mode("overwrite").format(fmt).save(path)


def chart_rows(df: DataFrame, figure: str, x: str, y: str, group: str | None = None,
               annotation: str | None = None, extra: Sequence[str] = (),
               trend: str | None = None) -> DataFrame:
    """A figure as tidy rows ``(figure, kind, group, x, y, annotation, ...)``.

    ``kind`` is ``'data'`` for the bars/points and ``'trendline'`` for the
    fitted values in column ``trend`` (kept apart, as in the response body).
    Ratios are already null where the reproduced system had NaN/Inf.
    """
    base = [F.lit(figure).alias("figure"),
            (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("group"),
            F.col(x).cast("string").alias("x")]
    ann = (F.col(annotation).cast("string") if annotation else F.lit(None).cast("string")).alias("annotation")
    data = df.select(*base, F.lit("data").alias("kind"), F.col(y).cast("double").alias("y"), ann,
                     *[F.col(c) for c in extra])
    if trend is None:
        return data
    tl = df.select(*base, F.lit("trendline").alias("kind"), F.col(trend).cast("double").alias("y"),
                   F.lit(None).cast("string").alias("annotation"),
                   *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in extra])
    return data.unionByName(tl)


def figure_documents(rows: DataFrame, titles: Mapping[str, str] | None = None) -> DataFrame:
    """One JSON document per figure: ``{"figure", "data": [...], "trendlines": [...]}``.

    A figure's rows are bounded by its categories x time points, so they are
    gathered per figure (one group per figure, never the whole table).
    """
    item = F.struct("group", "x", "y", "annotation")
    g = rows.groupBy("figure").agg(
        F.collect_list(F.when(F.col("kind") == "data", item)).alias("data"),
        F.collect_list(F.when(F.col("kind") == "trendline", F.struct("x", "y"))).alias("trendlines"))
    if titles:
        t = None
        for k, v in titles.items():
            t = F.when(F.col("figure") == k, F.lit(v)) if t is None else t.when(F.col("figure") == k, F.lit(v))
        g = g.withColumn("title", t)
    return g.select("figure", F.to_json(F.struct(*g.columns)).alias("document"))


def export_report(frames: Mapping[str, DataFrame], path: str) -> None:
    """Write every part of a report (chart rows, KPI rows, features) as JSON
    lines under ``path/<part>`` (the response body, without the figures)."""
    for name, df in frames.items():
        write_rows(df, f"{path}/{name}")


def point_features(df: DataFrame, x: str, y: str, props: Sequence[str]) -> DataFrame:
    """One GeoJSON Feature (a JSON string) per row."""
    geom = F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))
    feat = F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"),
                    geom.alias("geometry"))
    return df.withColumn("feature", F.to_json(feat))


def polygon_features(polys: DataFrame, props: Sequence[str], rings_col: str = "rings") -> DataFrame:
    """One GeoJSON Polygon Feature per row of ``(…, rings)`` — e.g. district
    shapes joined to their report attributes (S13, the map of R15)."""
    geom = F.struct(F.lit("Polygon").alias("type"), F.col(rings_col).alias("coordinates"))
    feat = F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"),
                    geom.alias("geometry"))
    return polys.withColumn("feature", F.to_json(feat))


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON features, written by the tasks."""
    features.select("feature").write.mode("overwrite").text(path)


def hin_points(points: DataFrame, segments: DataFrame, n: int, d: float, seed: int = 42,
               x: str = "x", y: str = "y", key: str = "vec_id") -> DataFrame:
    """R14 rows: a seeded sample of locatable points, left-joined to the lines
    within ``d`` (a point near two lines appears twice), labelled."""
    s = RK.sample_n(points.where(F.col(y) < C.LOCATABLE_MAX_Y), n, [key], seed)
    j = SP.points_near_lines(s, segments, d, x, y, mode="all")
    on = F.col("line_name").isNotNull()
    return j.select(key, F.col(x).alias("lng"), F.col(y).alias("lat"), on.alias("on_hin"),
                    F.col("line_name").alias("stname"),
                    F.when(on, F.lit("Traffic stop on the HIN"))
                     .otherwise(F.lit("Traffic stop not on the HIN")).alias("hover_text"))
