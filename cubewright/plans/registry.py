"""Collects every registered query and its oracle SQL."""

from __future__ import annotations

from functools import wraps


def _utc(fn):
    """Queries run with the session time zone set to UTC (timestamps are UTC
    instants; local time is derived explicitly)."""
    @wraps(fn)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    return run


def all_queries() -> dict:
    from . import queries_etl, queries_reports, queries_sources
    out = {}
    for mod in (queries_etl, queries_reports, queries_sources):
        out.update({k: _utc(v) for k, v in mod.QUERIES.items()})
    return out


def all_oracles() -> dict:
    from . import oracles_etl, oracles_reports
    e = oracles_etl.ORACLES
    out = {**e, **oracles_reports.ORACLES}
    # the file-source keys must give what the parquet path gives (through a
    # CSV file an empty text field reads back as null)
    csv_nulls = oracles_etl.csv_variant
    out.update({
        "scan_typed": csv_nulls(e["stop_cube_reason"]),
        "stop_cube_coded": csv_nulls(e["stop_cube_reason"]),
        "scan_archive": csv_nulls(e["stop_cube_reason"]),
        "row_ordinal": csv_nulls(e["stop_driver"]),
        "incremental_fold": csv_nulls(e["stop_cube_reason"]),
        "sink_roundtrip": e["stop_cube_reason"],
        "dim_population_csv": oracles_reports.ORACLES["dim_population"],
        "scan_override": oracles_reports.SCAN_OVERRIDE,
        "json_summaries": oracles_reports.ORACLES["latest_full_quarter"],
        "wkb_points": f"WITH {oracles_reports.PTS} SELECT vec_id, x, y FROM o_pts",
        "unknown_geometry": f"""
SELECT 'persons' AS "table", CAST(sum(CASE WHEN psa IS NULL THEN n_people ELSE 0 END) AS BIGINT) AS n_unknown,
  CAST(sum(n_people) AS BIGINT) AS n_rows,
  100.0 * CAST(sum(CASE WHEN psa IS NULL THEN n_people ELSE 0 END) AS DOUBLE) / CAST(sum(n_people) AS DOUBLE) AS pct_unknown
FROM ({oracles_reports.ORACLES["remap_district"]})""",
    })
    return out
