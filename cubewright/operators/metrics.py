"""Measures over cube slices: totals, averages, shares, rates, baselines,
least-squares trend (A8-A20, W4-W6, C9-C12).

Windows without a partition key (shares of a total, baseline lookups, the
trend fit) are applied only to *grouped* frames whose row count is bounded
by a dimension (members of a demographic, districts), never to raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import mathx as M


def measure_of(action_or_column: str) -> str:
    """A police action (``stop``, ``frisk``, ``search``, ``intrusion``) or a
    measure column name -> the cube measure column (C16)."""
    return C.ACTIONS.get(action_or_column, action_or_column)


def sums(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Group by ``keys`` and sum ``measures``."""
    return df.groupBy(*keys).agg(*[F.sum(m).cast("long").alias(m) for m in measures])


def avg_monthly_expr(total: Column, n_quarters: Column) -> Column:
    """total / quarters / 3, rounded half-even to an integer."""
    return F.rint(F.try_divide(F.try_divide(total.cast("double"), n_quarters.cast("double")),
                               F.lit(3.0))).cast("long")


def avg_monthly(df: DataFrame, measure: str, quarter_col: str = "quarter") -> DataFrame:
    """Average per month over the quarters *present* in ``df`` (A10); one row."""
    return df.agg(F.sum(measure).alias("_t"), F.countDistinct(quarter_col).alias("_n")) \
             .select(avg_monthly_expr(F.col("_t"), F.col("_n")).alias("value"))


def avg_monthly_calendar(df: DataFrame, measure: str, n_quarters: int) -> DataFrame:
    """Average per month over the quarters *in the range* (A11); one row."""
    return df.agg(F.sum(measure).alias("_t")) \
             .select(avg_monthly_expr(F.col("_t"), F.lit(n_quarters)).alias("value"))


def quarter_sets(df: DataFrame, keys: Sequence[str], measures: Sequence[str], quarter_col: str = "quarter") -> DataFrame:
    """Per key: the measures' sums and the set of quarters as a bitmap
    (``quarters``; bit n is the n-th quarter from 1900 on), so that averages
    over the quarters present need no second look at the rows (A10, A15)."""
    year = F.substring(quarter_col, 1, 4).cast("long")
    number = (year - 1900) * 4 + F.substring(quarter_col, -1, 1).cast("long")
    return df.groupBy(*keys).agg(*[F.sum(m).cast("long").alias(m) for m in measures],
                                 F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("quarters"))


def merge_quarter_sets(parts: Sequence[DataFrame], keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Quarter sets of different rows as one: sums are added, sets united, so a
    quarter that several parts hold counts once."""
    u = parts[0].select(*keys, *measures, "quarters")
    for p in parts[1:]:
        u = u.unionByName(p.select(*keys, *measures, "quarters"))
    return u.groupBy(*keys).agg(*[F.sum(m).cast("long").alias(m) for m in measures], F.bitmap_or_agg("quarters").alias("quarters"))


def avg_monthly_of_sets(sets: DataFrame, measure: str, out: str = "value") -> DataFrame:
    """A10 from quarter sets."""
    return sets.withColumn(out, avg_monthly_expr(F.col(measure), F.bitmap_count("quarters"))).drop("quarters")


def share_of_total(df: DataFrame, value_col: str, out: str = "percentage",
                   within: Sequence[str] = (), dp: int | None = 1) -> DataFrame:
    """value / sum(value) * 100 over the whole (grouped) frame or within groups."""
    w = Window.partitionBy(*within) if within else Window.partitionBy()
    share = F.try_divide(F.col(value_col).cast("double"), F.sum(value_col).over(w).cast("double")) \
        * F.lit(100.0)
    return df.withColumn(out, M.round_even(share, dp) if dp is not None else share)


def share_within(df: DataFrame, value_col: str, group_col: str, out: str = "pct_stopped",
                 dp: int = 1) -> DataFrame:
    """``100 * (value / group total)`` (J12/W5), rounded."""
    tot = F.sum(value_col).over(Window.partitionBy(group_col)).cast("double")
    return df.withColumn(out, M.round_even(F.lit(100.0) * F.try_divide(
        F.col(value_col).cast("double"), tot), dp))


def baseline_value(value: Column, member: Column, baseline: str) -> Column:
    """The value of the baseline member, spread to every row."""
    return F.max(F.when(member == F.lit(baseline), value)).over(Window.partitionBy())


def has_member(member: Column, baseline: str) -> Column:
    return F.max((member == F.lit(baseline)).cast("int")).over(Window.partitionBy()) == 1


def baseline_status(member: Column, baseline: str, num: Column, den: Column) -> Column:
    """Baseline / zero of baseline / above baseline / ratio."""
    return (F.when(member == F.lit(baseline), F.lit("Baseline"))
             .when((den == 0) & (num == 0), F.lit("zero"))
             .when(num.isNull() | den.isNull(), F.lit("zero"))
             .when(den == 0, F.lit("above"))
             .otherwise(F.lit("ratio")))


def ols_fit(df: DataFrame, x: str, y: str, out: str, dp: int | None = None) -> DataFrame:
    """Least-squares line y ~ x over the (small, grouped) frame, clipped at 0.

    ``dp`` rounds the fitted values half-even.
    """
    w = Window.partitionBy()
    b1 = F.regr_slope(F.col(y), F.col(x)).over(w)
    b0 = F.regr_intercept(F.col(y), F.col(x)).over(w)
    fit = M.clip0(b0 + b1 * F.col(x))
    return df.withColumn(out, M.round_even(fit, dp) if dp is not None else fit)
