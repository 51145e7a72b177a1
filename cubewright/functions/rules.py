"""Classification and recoding expressions.

Rule tables live in :mod:`cubewright.config` as data; here they are compiled
into a single chained ``CASE WHEN`` so the whole classification stays inside
whole-stage codegen.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def clean_code(code: Column) -> Column:
    """Lower-case ``i`` -> ``1``, drop ``( ) -`` and spaces, then upper-case."""
    return F.upper(F.translate(code, "i()- ", "1"))


def _q(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal(v: str) -> str:
    return re.sub(r"([^0-9A-Za-z ])", r"\\\1", v)


def _clause_pattern(clause: dict) -> str:
    """A clause as a pattern that is tried at the beginning of a text."""
    parts = []
    if "prefix" in clause:
        parts.append(f"(?={_literal(clause['prefix'])})")
    if "not_prefix" in clause:
        parts.append(f"(?!{_literal(clause['not_prefix'])})")
    if "contains" in clause:
        parts.append(f"(?=.*{_literal(clause['contains'])})")
    if "not_contains" in clause:
        parts.append(f"(?!.*{_literal(clause['not_contains'])})")
    if "exact" in clause:
        parts.append(f"{_literal(clause['exact'])}\\z")
    return "".join(parts)


def violation_category_of(col: str, rules=C.VIOLATION_RULES) -> Column:
    """Category of a cleaned code, by column *name*: the first matching rule
    wins, another code is 'Other', null is 'None'.  A rule is one pattern: with
    a test per clause the generated code of a stage that classifies and
    aggregates was too long for the JVM to compile."""
    c = F.col(f"`{col}`")
    found = F.when(c.isNull(), F.lit(C.VIOLATION_NONE))
    for cat, clauses in rules:
        found = found.when(c.rlike("(?s)\\A(?:" + "|".join(map(_clause_pattern, clauses)) + ")"), F.lit(cat))
    return found.otherwise(F.lit(C.VIOLATION_OTHER))


def lookup_of(col: str, mapping, default: str | None = None, keep: bool = False) -> Column:
    """A fixed value -> value lookup over a column name as one SQL ``CASE``;
    unmatched -> ``default`` (or the value itself when ``keep``)."""
    c = f"`{col}`"
    whens = " ".join(f"WHEN {c} = {_q(k) if isinstance(k, str) else k} THEN "
                     f"{'NULL' if v is None else _q(v)}" for k, v in mapping)
    other = c if keep else ("NULL" if default is None else _q(default))
    return F.expr(f"CASE {whens} ELSE {other} END")


def age_band_of(col: str) -> Column:
    """Age band over a column name as one SQL ``CASE``; null is in the last."""
    c = f"`{col}`"
    whens = " ".join(f"WHEN {c} < {up} THEN {_q(lab)}" for up, lab in C.AGE_BANDS)
    return F.expr(f"CASE {whens} ELSE {_q(C.AGE_BAND_ELSE)} END")


def any_positive(*sums: Column) -> Column:
    """1 when any of the (possibly null) sums is > 0, else 0."""
    return F.when(reduce(or_, [s > 0 for s in sums]), F.lit(1)).otherwise(F.lit(0))


def pad_district(dist: Column) -> Column:
    """``printf('%02d', dist)``: ``'9'`` and ``'9.0'`` -> ``'09'``; non-numeric or
    null -> ``'00'``."""
    as_int = F.coalesce(dist.try_cast("int"), dist.try_cast("double").try_cast("int"), F.lit(0))
    return F.format_string("%02d", as_int)


def remap_district(dist: Column) -> Column:
    """Districts 06/09 -> 09 and 6/9 -> 9; others unchanged."""
    expr = None
    for src, dst in C.REMAP_DISTRICTS.items():
        expr = F.when(dist == src, F.lit(dst)) if expr is None else expr.when(dist == src, F.lit(dst))
    return expr.otherwise(dist)


def rank_of(label: Column, order: list[str]) -> Column:
    """Position of ``label`` in ``order`` (0-based); null when not a member."""
    expr = None
    for i, v in enumerate(order):
        expr = F.when(label == v, F.lit(i)) if expr is None else expr.when(label == v, F.lit(i))
    return expr
