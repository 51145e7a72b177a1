"""Calendar and quarter expressions (all JVM-side Column expressions).

Quarters are carried as the label ``'YYYY-Qn'``; ``quarter_date`` is the
first day of the quarter.  Parameters given by a caller (``'1997-Q2'`` or
``'1997-04-01'``) are parsed on the driver into plain dates; only those
literals enter the plan.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

_Q_RE = re.compile(r"^(\d{4})-Q([1-4])$")


# --------------------------------------------------------------------------
# driver-side parameter parsing (scalars only)
# --------------------------------------------------------------------------

def parse_bound(value) -> _dt.date | None:
    """A bound given as a date, ``'YYYY-MM-DD'`` or ``'YYYY-Qn'`` -> date."""
    if value is None or value == "":
        return None
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    m = _Q_RE.match(str(value))
    if m:
        return _dt.date(int(m.group(1)), 3 * int(m.group(2)) - 2, 1)
    return _dt.date.fromisoformat(str(value)[:10])


def quarter_label_py(d: _dt.date) -> str:
    return f"{d.year}-Q{(d.month - 1) // 3 + 1}"


def quarter_start_py(label: str) -> _dt.date:
    m = _Q_RE.match(label)
    if not m:
        raise ValueError(f"not a quarter label: {label!r}")
    return _dt.date(int(m.group(1)), 3 * int(m.group(2)) - 2, 1)


def next_quarter_start_py(label: str) -> _dt.date:
    d = quarter_start_py(label)
    return _dt.date(d.year + (d.month == 10), (d.month + 3 - 1) % 12 + 1, 1)


def quarters_between_py(first: str, last: str) -> list[str]:
    out, d, end = [], quarter_start_py(first), quarter_start_py(last)
    while d <= end:
        out.append(quarter_label_py(d))
        d = _dt.date(d.year + (d.month == 10), (d.month + 3 - 1) % 12 + 1, 1)
    return out


# --------------------------------------------------------------------------
# column expressions
# --------------------------------------------------------------------------

def to_local(ts: Column, tz: str = C.LOCAL_TZ) -> Column:
    """UTC instant -> naive local wall time (session time zone must be UTC)."""
    return F.from_utc_timestamp(ts.cast("timestamp"), tz)


def quarter_start_ts(local_ts: Column) -> Column:
    return F.date_trunc("quarter", local_ts)


def quarter_iso(local_ts: Column) -> Column:
    """Quarter start as ``YYYY-MM-01T00:00:00.000000Z`` (the raw cube key)."""
    return F.date_format(quarter_start_ts(local_ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def quarter_label(d: Column) -> Column:
    """Any date/timestamp -> ``'YYYY-Qn'``."""
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def quarter_date_of_label(label: Column) -> Column:
    """``'YYYY-Qn'`` -> first day of the quarter."""
    y = F.substring(label, 1, 4).cast("int")
    q = F.substring(label, 7, 1).cast("int")
    return F.make_date(y, q * 3 - 2, F.lit(1))


def previous_full_quarter(d: Column) -> Column:
    """The last quarter that is complete on date ``d`` -> ``'YYYY-Qn'``."""
    return quarter_label(F.add_months(F.trunc(d.cast("date"), "quarter"), -3))


def add_calendar(df: DataFrame, label_col: str = "quarter") -> DataFrame:
    """Append the calendar columns every cube carries.

    ``quarter`` must hold ``'YYYY-Qn'``.  Adds ``quarter_date`` (date),
    ``quarter_dt_str`` (ISO start), ``q_str`` (``'Qn'``) and ``year`` (int).
    """
    qd = quarter_date_of_label(F.col(label_col))
    return df.withColumns({
        "quarter_date": qd,
        "quarter_dt_str": F.date_format(qd, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        "q_str": F.substring(F.col(label_col), 6, 2),
        "year": F.substring(F.col(label_col), 1, 4).cast("int"),
    })


def season_label(q_str: Column, how: str = "season") -> Column:
    """``'Qn'`` -> season/month label (``season``, ``start`` or ``end``)."""
    table = {"season": C.SEASON_LABEL, "start": C.SEASON_START, "end": C.SEASON_END}[how]
    expr = None
    for k, v in table.items():
        expr = (F.when(q_str == k, F.lit(v)) if expr is None
                else expr.when(q_str == k, F.lit(v)))
    return expr


def year_season(label: Column) -> Column:
    """``'1997-Q3'`` -> ``'July-Sep 1997'``."""
    return F.concat(season_label(F.substring(label, 6, 2)), F.lit(" "),
                    F.substring(label, 1, 4))


def quarter_spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per quarter from ``first`` to ``last`` (labels ``YYYY-Qn``).

    Built from a one-row range and ``sequence``; a calendar dimension whose
    size is the number of quarters in the range.
    """
    start, end = quarter_start_py(first), quarter_start_py(last)
    df = spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 3 months")))
        .alias("quarter_date"))
    return (df.withColumn("quarter", quarter_label(F.col("quarter_date")))
              .withColumn("q_str", F.substring("quarter", 6, 2))
              .withColumn("year", F.year("quarter_date")))
