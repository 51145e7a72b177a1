"""Hex (E)WKB point -> (x, y) as built-in SQL expressions.

A hex point is ``<order:1><type:4>[<srid:4>]<x:8><y:8>`` (bytes).  The
decode stays inside whole-stage codegen: the byte order is undone with
``substr``/``concat``, each IEEE-754 double is rebuilt from its two 32-bit
halves (``conv`` base 16 -> bigint) as sign, exponent and mantissa, and
``mantissa / 2^52`` scaled by ``2^exponent`` is exact for every finite
double.  Points only: other geometry types, malformed text and NaN/Inf
coordinates give null, as a missing geometry does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SRID_FLAG = 0x20000000


def _bytes(h: str, byte_pos: int, n: int) -> str:
    """SQL for the hex of ``n`` bytes starting at byte ``byte_pos`` (0-based)."""
    return f"substr({h}, {2 * byte_pos + 1}, {2 * n})"


def _as_big_endian(h: str, byte_pos: int, n: int, little: str) -> str:
    """Hex of ``n`` bytes in big-endian order (reversed when ``little``)."""
    rev = ", ".join(_bytes(h, byte_pos + n - 1 - i, 1) for i in range(n))
    return f"(CASE WHEN {little} THEN concat({rev}) ELSE {_bytes(h, byte_pos, n)} END)"


def _uint(hex_be: str) -> str:
    return f"CAST(conv({hex_be}, 16, 10) AS BIGINT)"


def _double(h: str, byte_pos: str, little: str) -> str:
    """IEEE-754 double from 8 bytes at a (SQL) byte offset."""
    rev = ", ".join(f"substr({h}, 2 * ({byte_pos} + {7 - i}) + 1, 2)" for i in range(8))
    fwd = f"substr({h}, 2 * {byte_pos} + 1, 16)"
    be = f"(CASE WHEN {little} THEN concat({rev}) ELSE {fwd} END)"
    hi = _uint(f"substr({be}, 1, 8)")
    lo = _uint(f"substr({be}, 9, 8)")
    sign = f"(CASE WHEN {hi} >= 2147483648 THEN -1.0D ELSE 1.0D END)"
    exp = f"(({hi} % 2147483648) DIV 1048576)"
    mant = f"(CAST({hi} % 1048576 AS DOUBLE) * 4294967296.0D + CAST({lo} AS DOUBLE))"
    return (f"(CASE WHEN {exp} = 2047 THEN NULL "
            f"WHEN {exp} = 0 THEN {sign} * ({mant} / 4503599627370496.0D) * pow(2.0D, -1022) "
            f"ELSE {sign} * (1.0D + {mant} / 4503599627370496.0D) * pow(2.0D, {exp} - 1023) END)")


def wkb_point(hex_col: Column | str) -> Column:
    """Struct ``(x, y)`` from a hex (E)WKB point column (JVM-side)."""
    name = hex_col if isinstance(hex_col, str) else None
    if name is None:
        raise TypeError("pass the column name")
    h = f"upper(`{name}`)"
    little = f"({_bytes(h, 0, 1)} = '01')"
    typ = _uint(_as_big_endian(h, 1, 4, little))
    is_point = f"({typ} % 65536 = 1)"
    has_srid = f"((({typ} DIV {_SRID_FLAG}) % 2) = 1)"
    start = f"(CASE WHEN {has_srid} THEN 9 ELSE 5 END)"
    ok = (f"(`{name}` IS NOT NULL AND {h} RLIKE '^[0-9A-F]+$' AND {_bytes(h, 0, 1)} IN ('00', '01') "
          f"AND {is_point} AND length({h}) = 2 * ({start} + 16))")
    x = _double(h, start, little)
    y = _double(h, f"({start} + 8)", little)
    return F.expr(f"CASE WHEN {ok} THEN named_struct('x', {x}, 'y', {y}) END")


def with_point(df: DataFrame, geom_col: str = "the_geom", x: str = "point_x",
               y: str = "point_y") -> DataFrame:
    """Fill ``x``/``y`` from the hex geometry where they are missing."""
    out = df.withColumn("_pt", wkb_point(geom_col))
    out = out.withColumn(x, F.coalesce(F.col(x), F.col("_pt.x")) if x in df.columns else F.col("_pt.x"))
    out = out.withColumn(y, F.coalesce(F.col(y), F.col("_pt.y")) if y in df.columns else F.col("_pt.y"))
    return out.drop("_pt")
