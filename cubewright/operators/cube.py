"""Quarterly cubes (A3-A7, A21) and their merge.

Cubes are small (keys: place x quarter x demographics x reason), the input
is not: every builder is one aggregate with map-side partial
aggregation, so the shuffle carries at most one row per key per task.
Rows with a null key are dropped *before* grouping (the reproduced system
drops them when it regroups; filtering first gives the same cube and
shuffles less).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules as R
from ..functions import timeq as TQ
from .collapse import before_quarter_end


def _sums(measures: Sequence[str]):
    return [F.sum(m).cast("long").alias(m) for m in measures]


def stop_cube_reason(classified_stops: DataFrame, most_recent_quarter: str,
                     extra_keys: Sequence[str] = ()) -> DataFrame:
    """Cube keyed by place, quarter, race, gender, age band and reason.

    ``extra_keys`` (e.g. the source file) keeps per-file cubes apart so they
    can be folded later with :func:`merge_cubes`.
    """
    s = before_quarter_end(classified_stops, most_recent_quarter)
    cube = (s.na.drop(subset=C.REASON_KEYS)
             .groupBy(*C.REASON_KEYS, *extra_keys)
             .agg(F.count(F.lit(1)).alias("n_stopped"),
                  F.sum("n_people_in_car").cast("long").alias("n_people_in_stopped_vehicles"),
                  F.sum("was_searched").cast("long").alias("n_searched"),
                  F.sum("was_arrested").cast("long").alias("n_arrested"),
                  F.sum("was_found_with_contraband").cast("long").alias("n_contraband"),
                  F.sum("was_frisked").cast("long").alias("n_frisked"),
                  F.sum("was_intruded").cast("long").alias("n_intruded")))
    return TQ.add_calendar(cube)


def roll_up(cube: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Drop dimensions: re-aggregate ``measures`` over ``keys`` (A5); the
    calendar columns are re-derived when the quarter is kept."""
    out = cube.groupBy(*keys).agg(*_sums(measures))
    return TQ.add_calendar(out) if "quarter" in keys else out


def stop_cube(reason_cube: DataFrame) -> DataFrame:
    return roll_up(reason_cube, C.STOP_KEYS, C.STOP_MEASURES)


def hin_cube(persons: DataFrame, most_recent_quarter: str, ts_col: str = "datetimeoccur",
             tz: str = C.LOCAL_TZ) -> DataFrame:
    """People (all stop types) locatable / on the high-injury network."""
    local = TQ.to_local(F.col(ts_col), tz)
    p = before_quarter_end(persons.withColumn("local_ts", local), most_recent_quarter)
    cube = (p.withColumn("quarter", TQ.quarter_label(F.col("local_ts")))
             .na.drop(subset=C.HIN_KEYS)
             .groupBy(*C.HIN_KEYS).agg(*_sums(C.HIN_MEASURES)))
    return TQ.add_calendar(cube)


def shootings_cube(shootings: DataFrame, most_recent_quarter: str, ts_col: str = "date_",
                   dist_col: str = "dist", tz: str = C.LOCAL_TZ) -> DataFrame:
    """Shootings per quarter and zero-padded district."""
    local = TQ.to_local(F.col(ts_col), tz)
    s = before_quarter_end(shootings.withColumn("local_ts", local), most_recent_quarter)
    cube = (s.select(TQ.quarter_label(F.col("local_ts")).alias("quarter"),
                     R.pad_district(F.col(dist_col)).alias("districtoccur"),
                     F.col("inside"))
             .groupBy(*C.SHOOTING_KEYS)
             .agg(F.count(F.lit(1)).alias("n_shootings"),
                  F.sum(F.when(F.col("inside") == 0, 1).otherwise(0)).cast("long").alias("n_outside")))
    return TQ.add_calendar(cube)


def merge_cubes(cubes: Sequence[DataFrame], keys: Sequence[str],
                measures: Sequence[str]) -> DataFrame:
    """Fold cubes built from different files into one.

    ``unionByName`` + one aggregate; associative and commutative, so a new
    batch can be merged into an existing cube table.
    """
    u = cubes[0].select(*keys, *measures)
    for c in cubes[1:]:
        u = u.unionByName(c.select(*keys, *measures))
    return u.na.drop(subset=list(keys)).groupBy(*keys).agg(*_sums(measures))


def snapshot_diff(new: DataFrame, old: DataFrame, keys: Sequence[str],
                  measure: str) -> DataFrame:
    """Per-key sums in two snapshots and their difference."""
    a = new.groupBy(*keys).agg(F.sum(measure).cast("long").alias("new_total"))
    b = old.groupBy(*keys).agg(F.sum(measure).cast("long").alias("old_total"))
    j = a.join(b, list(keys), "full")
    return j.select(*keys,
                    F.coalesce("new_total", F.lit(0)).alias("new_total"),
                    F.coalesce("old_total", F.lit(0)).alias("old_total"),
                    (F.coalesce("new_total", F.lit(0)) - F.coalesce("old_total", F.lit(0)))
                    .alias("diff"))
