"""Person rows -> incidents ("stops"): A1, A2, J1, J2.

The reproduced system finds each stop's driver with a self-join
(``min(id)`` per stop joined back to the persons) and joins the driver to
the stop aggregate.  Here both joins disappear: one aggregate per stop
key (sort-based: string minima and the driver struct have no fixed width) computes the counts, flags, minimum district/PSA, maximum code and the
driver's attributes through ``min_by(struct, ordinal)``.  Every aggregate
used is partial-aggregatable, so a stop key holding a third of all rows is
combined map-side before the single shuffle on the stop key.

Where the persons are a stored table, ``coded_stops`` gives the same stops by a
hash aggregate over numbers: the few different districts, PSAs, codes and
drivers are numbered once, in their order, and classified once each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules as R
from ..functions import timeq as TQ
from ..session import cut_lineage

DEFAULT_STOP_KEY = ("source_year", "datetimeoccur", "location")


def collapse_stops(persons: DataFrame, order_cols: Sequence[str],
                   stop_key: Sequence[str] = DEFAULT_STOP_KEY,
                   district_col: str = "districtoccur", psa_col: str = "psa",
                   cluster_keys: Sequence[str] = (), key_determined: bool = False) -> DataFrame:
    """One row per vehicle stop.

    ``order_cols`` is the person order inside a stop (file order); the first
    person is the driver.  Persons without a timestamp or location never form
    a stop; pedestrians are ignored.

    ``cluster_keys`` are extra grouping columns that are functionally
    dependent on the stop key (they never split a stop) and by which the
    input is already hash-partitioned, e.g. the join key of an upstream
    join.  Grouping on them too lets the planner reuse that partitioning
    instead of shuffling the person rows a second time.

    ``key_determined=True`` states that the cluster keys alone identify a
    stop (every stop-key column is a function of them once rows with a null
    stop key are dropped).  The aggregate then groups by the cluster keys
    only and carries the stop-key columns, so an input that is already sorted
    by them (a sort-merge join's output) needs no second sort either.
    """
    if key_determined and not cluster_keys:
        raise ValueError("key_determined needs cluster_keys")
    keys = list(cluster_keys) + list(stop_key)
    group_keys = list(cluster_keys) if key_determined else keys
    carried = [F.min(k).alias(k) for k in stop_key] if key_determined else []
    ordinal = F.struct(*[F.col(c) for c in order_cols])
    driver = F.struct("race", "gender", "age")
    have = set(persons.columns)

    def s(c):  # a flag column the input lacks counts as all-null (sum -> null)
        return F.sum(F.col(c)) if c in have else F.sum(F.lit(None).cast("double"))
    return (persons
            .where(F.col("stoptype") == "vehicle")
            .na.drop(subset=keys)
            .groupBy(*group_keys)
            .agg(*carried,
                 F.count(F.lit(1)).alias("n_people_in_car"),
                 F.min(district_col).alias("districtoccur"),
                 F.min(psa_col).alias("psa"),
                 F.max("mvc_code").alias("mvc_code_max"),
                 F.min_by(driver, ordinal).alias("driver"),
                 *_flags(s)))


def _flags(s) -> list[Column]:
    """The stop's flags from sums of its persons' columns (A2)."""
    return [R.any_positive(s("individual_searched"), s("vehicle_searched")).alias("was_searched"),
            R.any_positive(s("individual_arrested")).alias("was_arrested"),
            R.any_positive(s("individual_contraband"), s("vehicle_contraband")).alias("was_found_with_contraband"),
            R.any_positive(s("individual_frisked"), s("vehicle_frisked")).alias("was_frisked"),
            R.any_positive(s("individual_frisked"), s("vehicle_frisked"), s("individual_searched"), s("vehicle_searched")).alias("was_intruded")]


#: More different values than this are not numbered.
MAX_CODES = 1 << 16
_CODED = {"districtoccur": ["districtoccur"], "psa": ["psa"], "mvc_code": ["mvc_code"], "driver": ["race", "gender", "age"]}


def find_codes(persons: DataFrame) -> dict[str, DataFrame] | None:
    """{name: (its columns, code)}: the different values among vehicle persons,
    numbered in their order, each with what classification makes of it; None
    where there are more than ``MAX_CODES`` of a kind.  Reads narrow columns, so
    it is for stored tables."""
    out = {}
    for name, cols in _CODED.items():
        values = cut_lineage(persons.where(F.col("stoptype") == "vehicle").select(*cols).distinct().limit(MAX_CODES + 1))
        if values.count() > MAX_CODES:
            return None
        # at most MAX_CODES rows in one window
        out[name] = values.withColumn("code", (F.row_number().over(Window.orderBy(*[F.col(c).asc_nulls_first() for c in cols])) - 1).cast("int"))
    code = out["mvc_code"].withColumn("_code", R.clean_code(F.col("mvc_code")))
    out["mvc_code"] = code.withColumn("violation_category", R.violation_category_of("_code")).drop("_code")
    driver = out["driver"].withColumns({"_race": F.col("race"), "_age": F.col("age")})
    out["driver"] = driver.select("race", "gender", "age", "code", R.lookup_of("_race", C.RACE_RECODE.items(), keep=True).alias("model_race"),
                                  R.age_band_of("_age").alias("age_range"))
    return {name: cut_lineage(df) for name, df in out.items()}


def coded_stops(persons: DataFrame, codes: dict[str, DataFrame], stop_key: Sequence[str], ordinal: str = "_ordinal",
                ts_col: str = "datetimeoccur", tz: str = C.LOCAL_TZ) -> DataFrame:
    """What ``classify_stops(collapse_stops(persons, [ordinal], stop_key))``
    gives, by codes.

    ``ordinal`` is a scan's struct of file, start and row, or of member and
    row; a stop must not span files.  The first person of a stop is the least
    of (place in the file, driver's code) in one number.  A person whose values
    have no code fails the job."""
    have = set(persons.columns)
    fields = persons.schema[ordinal].dataType.fieldNames()
    df = persons.where(F.col("stoptype") == "vehicle").na.drop(subset=list(stop_key))
    for name, cols in _CODED.items():
        d = codes[name].select(*[F.col(c).alias(f"_{c}") for c in cols], F.col("code").alias(f"{name}_code"))
        same = None
        for c in cols:
            one = df[c].eqNullSafe(F.col(f"_{c}"))
            same = one if same is None else same & one
        df = df.join(F.broadcast(d), same, "left").drop(*[f"_{c}" for c in cols])
        known = F.when(F.col(f"{name}_code").isNull(), F.raise_error(F.lit(f"a {name} has no code")).cast("int")).otherwise(F.col(f"{name}_code"))
        # a null value takes no part in a minimum or maximum
        df = df.withColumn(f"{name}_code", known if name == "driver" else F.when(F.col(cols[0]).isNotNull(), known))
    row = F.col(f"{ordinal}.row")
    big = lambda c: c.cast("decimal(19,0)")
    if "start" in fields:  # rows of a split are numbered in 33 bits
        place = (big(F.col(f"{ordinal}.start")) * F.lit(1 << 33).cast("decimal(11,0)") + big(row.bitwiseAND((1 << 33) - 1))).cast("decimal(30,0)")
    else:
        place = row.cast("decimal(30,0)")
    first = (place * F.lit(MAX_CODES + 1).cast("decimal(6,0)") + F.col("driver_code").cast("decimal(6,0)")).cast("decimal(38,0)")

    def s(c):
        return F.sum(F.col(c)) if c in have else F.sum(F.lit(None).cast("double"))

    stops = df.groupBy(*stop_key).agg(
        F.count(F.lit(1)).alias("n_people_in_car"), F.min("districtoccur_code").alias("_d"), F.min("psa_code").alias("_p"),
        F.max("mvc_code_code").alias("_c"), F.min(first).alias("_first"), *_flags(s))
    stops = stops.withColumn("_who", (F.col("_first") % F.lit(MAX_CODES + 1)).cast("int"))
    for name, key, keep in (("districtoccur", "_d", {"districtoccur": "districtoccur"}), ("psa", "_p", {"psa": "psa"}),
                            ("mvc_code", "_c", {"mvc_code": "mvc_code_max", "violation_category": "_category"}),
                            ("driver", "_who", {"model_race": "race", "gender": "gender", "age_range": "age_range"})):
        d = codes[name].select(F.col("code").alias(f"_{name}"), *[F.col(a).alias(b) for a, b in keep.items()])
        stops = stops.join(F.broadcast(d), stops[key] == F.col(f"_{name}"), "left")
    return (stops.withColumn("local_ts", TQ.to_local(F.col(ts_col), tz))
            .select(*stop_key, "n_people_in_car", "districtoccur", "psa", "mvc_code_max", "was_searched", "was_arrested",
                    "was_found_with_contraband", "was_frisked", "was_intruded", "local_ts", TQ.quarter_label(F.col("local_ts")).alias("quarter"),
                    "race", "gender", "age_range", F.coalesce("_category", F.lit(C.VIOLATION_NONE)).alias("violation_category")))


def classify_stops(stops: DataFrame, ts_col: str = "datetimeoccur",
                   tz: str = C.LOCAL_TZ) -> DataFrame:
    """Local time, quarter, model race, age band and violation category."""
    # local time and the cleaned code are computed once in their own
    # projection: the rule table and the quarter label test them many times
    s = stops.withColumns({"local_ts": TQ.to_local(F.col(ts_col), tz),
                           "_code": R.clean_code(F.col("mvc_code_max")),
                           "_race": F.col("driver.race"), "_age": F.col("driver.age")})
    return s.select(
        *[c for c in stops.columns if c != "driver"],
        "local_ts",
        TQ.quarter_label(F.col("local_ts")).alias("quarter"),
        R.lookup_of("_race", C.RACE_RECODE.items(), keep=True).alias("race"),
        F.col("driver.gender").alias("gender"),
        R.age_band_of("_age").alias("age_range"),
        R.violation_category_of("_code").alias("violation_category"),
    )


def before_quarter_end(df: DataFrame, most_recent_quarter: str,
                       local_col: str = "local_ts") -> DataFrame:
    """Keep rows whose local time is at or before the end of the given quarter."""
    cutoff = TQ.next_quarter_start_py(most_recent_quarter)
    return df.where(F.col(local_col) < F.lit(cutoff).cast("timestamp"))
