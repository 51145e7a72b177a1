"""Quality gates (Q1-Q3, C6) as aggregates; raising happens at the edge.

``*_report`` functions return a DataFrame (lazy, registered as queries);
``check_*`` functions run the one-row aggregate and raise on failure.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import timeq as TQ

# ---------------------------------------------------------------------------
# gates from the writing pass: the metrics of an observed write, so nothing is
# read a second time.  They are observed after the last shuffle of a write,
# where every row is counted once however often tasks are retried.
# ---------------------------------------------------------------------------


def observed_quarter(cube: DataFrame, name: str, seed_before: int | None = None, measure: str = "n_stopped") -> tuple[DataFrame, Observation]:
    """The cube with its latest quarter and rows (Q1) and, if asked for, the
    measure's total before a year (Q3) observed as it is written."""
    obs = Observation(name)
    seed = F.lit(None).cast("long") if seed_before is None else F.coalesce(F.sum(F.when(F.col("year") < seed_before, F.col(measure))), F.lit(0)).cast("long")
    return cube.observe(obs, F.max("quarter_date").alias("max_quarter_date"), F.count(F.lit(1)).alias("n_rows"), seed.alias("seed")), obs


def check_observed_quarters(metrics: Mapping[str, Mapping], most_recent_quarter: str) -> None:
    """Raise unless every written cube ends with the given quarter (Q1); an
    empty cube has no latest quarter and does not pass."""
    def label(d):
        return None if d is None else f"{d.year}-Q{(d.month + 2) // 3}"

    bad = {n: label(m["max_quarter_date"]) for n, m in metrics.items() if label(m["max_quarter_date"]) != most_recent_quarter}
    if bad:
        raise ValueError(f"most recent quarter mismatch (want {most_recent_quarter}): " + ", ".join(f"{n}={q}" for n, q in sorted(bad.items())))


def check_observed_total(metrics: Mapping, expected: int, measure: str = "n_stopped") -> None:
    """Raise unless the known total before the seed year is met (Q3)."""
    if metrics["seed"] != int(expected):
        raise ValueError(f"{measure} total {metrics['seed']} != expected {expected}")


def observed_unknown(remapped: DataFrame, name: str, psa_col: str = "psa") -> tuple[DataFrame, Observation]:
    """The rows with their number and that of unknown PSAs (C6) observed."""
    obs = Observation(name)
    return remapped.observe(obs, F.sum(F.col(psa_col).isNull().cast("long")).alias("n_unknown"), F.count(F.lit(1)).alias("n_rows")), obs


def unknown_row(spark: SparkSession, metrics: Mapping, table: str) -> DataFrame:
    """The row of :func:`unknown_geometry` from observed numbers."""
    n, total = metrics["n_unknown"], metrics["n_rows"]
    return spark.createDataFrame([(table, n, total, None if not total else n / total * 100.0)],
                                 "table string, n_unknown long, n_rows long, pct_unknown double")


def quarter_gate_report(cubes: Mapping[str, DataFrame], most_recent_quarter: str) -> DataFrame:
    """Per cube: its latest quarter and whether it equals the requested one (Q1)."""
    parts = []
    for name, cube in cubes.items():
        parts.append(cube.agg(F.max("quarter_date").alias("max_quarter_date"),
                              F.count(F.lit(1)).alias("n_rows"))
                     .select(F.lit(name).alias("table"),
                             TQ.quarter_label(F.col("max_quarter_date")).alias("max_quarter"),
                             "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # an empty cube has no latest quarter and does not pass
    return out.withColumn("ok", F.col("max_quarter").eqNullSafe(F.lit(most_recent_quarter)))


def check_quarter(cubes: Mapping[str, DataFrame], most_recent_quarter: str) -> None:
    bad = quarter_gate_report(cubes, most_recent_quarter).where(~F.col("ok")).collect()
    if bad:
        raise ValueError(f"most recent quarter mismatch (want {most_recent_quarter}): "
                         + ", ".join(f"{r['table']}={r['max_quarter']}" for r in bad))


def agree_report(quarters: DataFrame, col: str = "quarter") -> DataFrame:
    """One row: number of distinct quarters across tables (Q2); ok when 1 and
    no table lacks its quarter."""
    return quarters.agg(F.countDistinct(col).alias("n_distinct"),
                        F.count(F.lit(1)).alias("n_tables"), F.count(col).alias("n_present"),
                        F.min(col).alias("quarter")) \
        .withColumn("ok", (F.col("n_distinct") == 1) & (F.col("n_present") == F.col("n_tables"))).drop("n_present")


def total_report(cube: DataFrame, measure: str, expected: int, where=None) -> DataFrame:
    """One row ``(measure, total, expected, ok)``: a known total (Q3)."""
    c = cube.where(where) if where is not None else cube
    return c.agg(F.sum(measure).cast("long").alias("total")).select(
        F.lit(measure).alias("measure"), "total", F.lit(int(expected)).cast("long").alias("expected"),
        F.col("total").eqNullSafe(F.lit(int(expected)).cast("long")).alias("ok"))


def check_total(cube: DataFrame, measure: str, expected: int, where=None) -> None:
    """Seed check: raise unless the known total is met (Q3)."""
    got = total_report(cube, measure, expected, where).first()
    if not got["ok"]:
        raise ValueError(f"{measure} total {got['total']} != expected {expected}")


def null_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Percent of rows with a null value, per column (C6), as tidy rows."""
    aggs = [(F.avg(F.col(c).isNull().cast("double")) * 100.0).alias(c) for c in cols]
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr("n_rows", f"stack({len(cols)}, {stack}) as (column_name, pct_null)")


def unknown_geometry(remapped: DataFrame, table: str, psa_col: str = "psa") -> DataFrame:
    """Rows whose PSA is unknown after the remap, as a percentage of all rows
    of the file (C6): one row ``(table, n_unknown, n_rows, pct)``."""
    return remapped.agg(F.sum(F.col(psa_col).isNull().cast("long")).alias("n_unknown"),
                        F.count(F.lit(1)).alias("n_rows")) \
        .select(F.lit(table).alias("table"), "n_unknown", "n_rows",
                (F.col("n_unknown") / F.col("n_rows") * F.lit(100.0)).alias("pct_unknown"))
