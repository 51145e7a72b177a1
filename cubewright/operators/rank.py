"""Ranking, ordering, top-k and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R


def rank_min_desc(x: Column) -> Column:
    """Rank, largest first, ties share the lowest rank; null stays null.

    Over a grouped frame (one row per district).
    """
    r = F.rank().over(Window.orderBy(x.desc_nulls_last()))
    return F.when(x.isNotNull(), r)


def rank_max_asc(x: Column) -> Column:
    """Rank, smallest first, ties share the highest rank; null stays null."""
    w = Window.orderBy(x.asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(x.isNotNull(), F.count(x).over(w))


def enum_order(label: Column, order: Sequence[str]) -> Column:
    """Position in an ordered enum; null when outside it (O1)."""
    return R.rank_of(label, list(order))


def top_k(df: DataFrame, k: int, by: Sequence[Column], tiebreak: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows in the given order (O3/O4); TakeOrdered, no full sort."""
    return df.orderBy(*by, *[F.col(c).asc() for c in tiebreak]).limit(k)


def sample_n(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a seeded hash of the key.

    Deterministic across runs and partitionings: rows are ordered by
    ``md5(seed || key)`` and the first ``n`` kept (per-partition top-n, then
    one merge of at most n rows per partition).
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols]))
    return df.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")
