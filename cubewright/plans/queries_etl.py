"""Registered queries for the build side (scan -> collapse -> classify -> cubes).

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole test tables.  Oracles for the same keys are in ``oracles_etl``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules as R
from ..functions import timeq as TQ
from ..operators import collapse as CO
from ..operators import cube as CU
from ..operators import quality as QU
from ..sources import analog as A
from .analog_tables import AnalogTables

TS_FMT = "yyyy-MM-dd HH:mm:ss"


def _t(spark, sf_dir) -> AnalogTables:
    return AnalogTables(spark, sf_dir)


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclassified stops of the analog (grouped by the order key, see
    ``collapse_stops(key_determined=True)``)."""
    return CO.collapse_stops(A.persons(spark, sf_dir), A.PERSON_ORDER,
                             cluster_keys=A.STOP_CLUSTER_KEYS, key_determined=True)


def q_stop_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stops(spark, sf_dir)
    return s.select("source_year", F.date_format("datetimeoccur", TS_FMT).alias("datetimeoccur"),
                    "location", "n_people_in_car", "districtoccur", "psa", "mvc_code_max",
                    "was_searched", "was_arrested", "was_found_with_contraband",
                    "was_frisked", "was_intruded")


def q_stop_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stops(spark, sf_dir)
    return s.select("source_year", "location",
                    F.col("driver.race").alias("driver_race"),
                    F.col("driver.gender").alias("driver_gender"),
                    F.col("driver.age").alias("driver_age"))


def q_any_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stops(spark, sf_dir)
    flags = ["was_searched", "was_arrested", "was_found_with_contraband", "was_frisked",
             "was_intruded"]
    return s.groupBy("source_year").agg(
        F.count(F.lit(1)).alias("n_stops"),
        *[F.sum(f).cast("long").alias(f) for f in flags])


def q_stop_cube_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir).reason_cube()
    return c.select(*C.REASON_KEYS, *C.STOP_MEASURES, "year", "q_str")


def q_stop_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir).cube()
    return c.select(*C.STOP_KEYS, *C.STOP_MEASURES, "year", "q_str")


def q_null_key_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops before the cut-off, and how many leave the cube per null key."""
    s = CO.before_quarter_end(_t(spark, sf_dir).stops(), C.ANALOG["most_recent_quarter"])
    anynull = None
    for k in C.REASON_KEYS:
        anynull = F.col(k).isNull() if anynull is None else (anynull | F.col(k).isNull())
    return s.agg(
        F.count(F.lit(1)).alias("n_stops"),
        F.sum(F.when(anynull, 0).otherwise(1)).cast("long").alias("n_in_cube"),
        *[F.sum(F.when(F.col(k).isNull(), 1).otherwise(0)).cast("long").alias(f"n_null_{k}")
          for k in ("districtoccur", "psa", "race", "gender")])


def q_code_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir).stops()
    return (s.groupBy("mvc_code_max")
             .agg(F.count(F.lit(1)).alias("n_stops"))
             .select(F.col("mvc_code_max").alias("mvc_code"),
                     R.clean_code(F.col("mvc_code_max")).alias("mvc_code_clean"), "n_stops"))


def q_violation_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir).reason_cube()
    return c.groupBy("violation_category").agg(F.sum("n_stopped").cast("long").alias("n_stopped"))


def q_recode_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.persons(spark, sf_dir)
    return (p.groupBy("race").agg(F.count(F.lit(1)).alias("n_people"))
             .select(F.col("race").alias("raw_race"),
                     R.lookup_of("race", C.RACE_RECODE.items(), keep=True).alias("race"), "n_people"))


def q_age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.persons(spark, sf_dir)
    return (p.withColumn("age_range", R.age_band_of("age"))
             .groupBy("age_range")
             .agg(F.count(F.lit(1)).alias("n_people"),
                  F.min("age").alias("min_age"), F.max("age").alias("max_age")))


def q_tz_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons by UTC quarter and local quarter (start ISO string)."""
    p = A.persons(spark, sf_dir)
    local = TQ.to_local(F.col("datetimeoccur"))
    return (p.select(TQ.quarter_label(F.col("datetimeoccur")).alias("utc_quarter"),
                     TQ.quarter_iso(local).alias("quarter_dt_str"),
                     TQ.quarter_label(local).alias("quarter"))
             .groupBy("utc_quarter", "quarter_dt_str", "quarter")
             .agg(F.count(F.lit(1)).alias("n_people")))


def q_calendar_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir).cube()
    return (c.groupBy("quarter", "quarter_dt_str", "q_str", "year")
             .agg(F.sum("n_stopped").cast("long").alias("n_stopped"))
             .withColumn("season", TQ.year_season(F.col("quarter"))))


def q_hin_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir).hin_cube()
    return c.select(*C.HIN_KEYS, *C.HIN_MEASURES, "year", "q_str")


def q_hin_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locatable / on-network person counts per source year (P13), from the points."""
    p = A.persons_on_network(spark, sf_dir)
    return p.groupBy("source_year").agg(
        F.count(F.lit(1)).alias("n_people"),
        F.sum("n_stopped_locatable").cast("long").alias("n_stopped_locatable"),
        F.sum("n_stopped_locatable_on_hin").cast("long").alias("n_stopped_locatable_on_hin"))


def q_shootings_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir).shootings_cube()
    return c.select(*C.SHOOTING_KEYS, *C.SHOOTING_MEASURES, "year", "q_str")


def q_merge_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes of the earlier and of the later source files merged into one.

    Equals the one-pass cube; the fold is the same ``merge_cubes`` used to
    add a new batch to an existing cube table.
    """
    t = _t(spark, sf_dir)
    late = F.col("source_year") >= 1996
    cubes = [CU.stop_cube_reason(t.stops().where(c), t.most_recent_quarter) for c in (~late, late)]
    return CU.merge_cubes(cubes, C.REASON_KEYS, C.STOP_MEASURES)


def q_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New build vs a build cut one quarter earlier: yearly stop totals."""
    t = _t(spark, sf_dir)
    new = t.reason_cube()
    old = CU.stop_cube_reason(t.stops(), "2000-Q3")
    return CU.snapshot_diff(new, old, ["year"], "n_stopped")


def q_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarter gate of the cubes and of an empty one, the agreement gate
    where a table lacks its quarter, and the seed check (Q1-Q3)."""
    t = _t(spark, sf_dir)
    q = QU.quarter_gate_report({"stop_cube": t.cube(), "shootings": t.shootings_cube(),
                                "hin": t.hin_cube(), "empty": t.cube().where("year < 0")}, t.most_recent_quarter)
    latest = t.cube().groupBy("districtoccur").agg(F.max("quarter").alias("quarter"))
    short = F.when(F.col("districtoccur") != "07", F.lit(t.most_recent_quarter))
    agree = QU.agree_report(latest.select(short.alias("quarter")))
    seed = QU.total_report(t.cube(), "n_stopped", 1)
    return (q.unionByName(agree.select(F.lit("agreement").alias("table"), F.col("quarter").alias("max_quarter"),
                                       F.col("n_tables").alias("n_rows"), "ok"))
            .unionByName(seed.select(F.lit("seed").alias("table"), F.lit(None).cast("string").alias("max_quarter"),
                                     F.col("total").alias("n_rows"), "ok")))


def q_null_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QU.null_rate(A.persons(spark, sf_dir), ["psa", "gender", "age", "mvc_code", "location"])


QUERIES = {
    "stop_collapse": q_stop_collapse,
    "stop_driver": q_stop_driver,
    "any_flags": q_any_flags,
    "stop_cube_reason": q_stop_cube_reason,
    "stop_cube": q_stop_cube,
    "null_key_drop": q_null_key_drop,
    "code_clean": q_code_clean,
    "violation_category": q_violation_category,
    "recode_race": q_recode_race,
    "age_band": q_age_band,
    "tz_quarter": q_tz_quarter,
    "calendar_cols": q_calendar_cols,
    "hin_cube": q_hin_cube,
    "hin_flags": q_hin_flags,
    "shootings_cube": q_shootings_cube,
    "merge_cubes": q_merge_cubes,
    "snapshot_diff": q_snapshot_diff,
    "quality_gate": q_quality_gate,
    "null_rate": q_null_rate,
}
