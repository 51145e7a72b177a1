"""Slicing the cube: location, quarter range, demographics.

Parameters are parsed on the driver into Column predicates; the predicates
reach the cube scan (and, for a partitioned cube table, prune partitions).
Division membership is either a small mapping or a (division, district)
dimension DataFrame, used as a broadcast semi-join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import timeq as TQ


def parse_location(location: str, divisions: Iterable[str]) -> tuple[str, str | None, str | None]:
    """``'*'`` | division | ``'DD'`` / ``'DD*'`` | ``'DD-P'`` -> (kind, district, psa)."""
    if location == "":
        raise ValueError("empty location; use '*' for the whole city")
    if location == "*":
        return ("city", None, None)
    if location in set(divisions):
        return ("division", location, None)
    parts = location.rstrip("*").split("-")
    return ("district", parts[0], parts[1] if len(parts) > 1 else None)


def filter_location(df: DataFrame, location: str,
                    divisions: Mapping[str, Sequence[str]] | DataFrame = C.DIVISION_DISTRICTS,
                    district_col: str = "districtoccur", psa_col: str = "psa",
                    division_names: Iterable[str] | None = None) -> DataFrame:
    """Keep the rows of one location; unknown locations give an empty frame."""
    if isinstance(divisions, DataFrame):
        # without a name list, anything that is not a district code is looked
        # up as a division (an unknown name then matches nothing, as before)
        head = location.rstrip("*").split("-")[0]
        names = list(division_names) if division_names is not None else (
            [location] if location not in ("", "*") and not head.isdigit() else [])
    else:
        names = list(divisions)
    kind, a, b = parse_location(location, names)
    if kind == "city":
        return df
    if kind == "division":
        if isinstance(divisions, DataFrame):
            members = F.broadcast(divisions.where(F.col("division") == a)
                                  .select(F.col("district").alias("_member")).distinct())
            return df.join(members, F.col(district_col) == F.col("_member"), "left_semi")
        return df.where(F.col(district_col).isin(list(divisions[a])))
    cond = F.col(district_col) == F.lit(a)
    if b is not None:
        cond = cond & (F.col(psa_col) == F.lit(b))
    return df.where(cond)


def window_quarters(spine: Sequence[str], start=None, end=None) -> list[str] | None:
    """Spine quarters whose start lies in [start, end].

    Both bounds missing -> None (no filter); one bound only -> the whole spine.
    """
    if not start and not end:
        return None
    if not (start and end):
        return list(spine)
    s, e = TQ.parse_bound(start), TQ.parse_bound(end)
    return [q for q in spine if s <= TQ.quarter_start_py(q) <= e]


def filter_quarters(df: DataFrame, spine: Sequence[str], start=None, end=None,
                    quarter_col: str = "quarter") -> DataFrame:
    qs = window_quarters(spine, start, end)
    if qs is None:
        return df
    cond = F.col(quarter_col).isin(qs)
    if "year" in df.columns:
        # implied by the quarter list; lets a year-partitioned table prune
        cond = F.col("year").isin(sorted({int(q[:4]) for q in qs})) & cond
    return df.where(cond)


def require_rows(df: DataFrame) -> DataFrame:
    """Raise when ``df`` is empty (one-row probe, the report edge)."""
    if df.isEmpty():
        raise ValueError("no rows for this selection")
    return df


def demo_predicate(ages: Sequence[str], genders: Sequence[str], races: Sequence[str]) -> Column:
    """age in A and gender in G and race in R."""
    return (F.col("age_range").isin(list(ages)) & F.col("gender").isin(list(genders))
            & F.col("race").isin(list(races)))


def cohort_predicate(choices: Sequence[Mapping[str, str | None]]) -> Column:
    """OR over choices of AND over the given fields; a missing field is 'any' (P5)."""
    ors = []
    for ch in choices:
        ands = [F.col(k) == F.lit(v) for k, v in ch.items() if v is not None]
        ors.append(reduce(and_, ands) if ands else F.lit(True))
    return reduce(or_, ors) if ors else F.lit(False)


def exclude_categories(df: DataFrame, values: Sequence[str],
                       col: str = "violation_category") -> DataFrame:
    return df.where(~F.col(col).isin(list(values)))


def keep_categories(df: DataFrame, values: Sequence[str],
                    col: str = "violation_category") -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def measure_columns(df: DataFrame, prefix: str = "n_") -> list[str]:
    """All measure columns by prefix."""
    return [c for c in df.columns if c.startswith(prefix)]
