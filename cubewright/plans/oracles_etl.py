"""DuckDB oracle SQL for the build-side keys (see ``queries_etl``)."""

from __future__ import annotations

from .. import config as C
from . import oracle_base as B

_W = B.with_blocks
_CUBE = B.CUBE_BLOCKS
_MRQ = C.ANALOG["most_recent_quarter"]
_TS = "strftime(datetimeoccur, '%Y-%m-%d %H:%M:%S')"

ORACLES = {
    "stop_collapse": _W(B.A_PERSONS, B.STOPS) + f"""
SELECT source_year, {_TS} AS datetimeoccur, location, n_people_in_car, districtoccur, psa,
       mvc_code_max, was_searched, was_arrested, was_found_with_contraband, was_frisked,
       was_intruded
FROM o_stop_agg""",

    "stop_driver": _W(B.A_PERSONS, B.STOPS) + """
SELECT source_year, location, d_race AS driver_race, d_gender AS driver_gender,
       d_age AS driver_age
FROM o_driver""",

    "any_flags": _W(B.A_PERSONS, B.STOPS) + """
SELECT source_year, count(*) AS n_stops,
       CAST(sum(was_searched) AS BIGINT) AS was_searched,
       CAST(sum(was_arrested) AS BIGINT) AS was_arrested,
       CAST(sum(was_found_with_contraband) AS BIGINT) AS was_found_with_contraband,
       CAST(sum(was_frisked) AS BIGINT) AS was_frisked,
       CAST(sum(was_intruded) AS BIGINT) AS was_intruded
FROM o_stop_agg GROUP BY source_year""",

    "stop_cube_reason": _W(*_CUBE) + f"""
SELECT {', '.join(C.REASON_KEYS)}, {', '.join(C.STOP_MEASURES)}, year, q_str
FROM o_reason_cube""",

    "stop_cube": _W(*_CUBE) + f"""
SELECT {', '.join(C.STOP_KEYS)}, {', '.join(C.STOP_MEASURES)}, year, q_str
FROM o_cube""",

    "null_key_drop": _W(B.A_PERSONS, B.STOPS) + f"""
SELECT count(*) AS n_stops,
  CAST(sum(CASE WHEN {' OR '.join(f'{k} IS NULL' for k in C.REASON_KEYS)} THEN 0 ELSE 1 END) AS BIGINT) AS n_in_cube,
  {', '.join(f'CAST(sum(CASE WHEN {k} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null_{k}' for k in ('districtoccur', 'psa', 'race', 'gender'))}
FROM o_stops WHERE local_ts < {B.cutoff_lit(_MRQ)}""",

    "code_clean": _W(B.A_PERSONS, B.STOPS) + """
SELECT mvc_code_max AS mvc_code,
  upper(replace(replace(replace(replace(replace(mvc_code_max, 'i', '1'), '(', ''), ')', ''), '-', ''), ' ', '')) AS mvc_code_clean,
  count(*) AS n_stops
FROM o_stops GROUP BY mvc_code_max""",

    "violation_category": _W(*_CUBE) + """
SELECT violation_category, CAST(sum(n_stopped) AS BIGINT) AS n_stopped
FROM o_reason_cube GROUP BY violation_category""",

    "recode_race": _W(B.A_PERSONS) + f"""
SELECT race AS raw_race, {B._race_recode('race')} AS race, count(*) AS n_people
FROM a_persons GROUP BY race""",

    "age_band": _W(B.A_PERSONS) + f"""
SELECT {B._age_band('age')} AS age_range, count(*) AS n_people, min(age) AS min_age,
       max(age) AS max_age
FROM a_persons GROUP BY 1""",

    "tz_quarter": _W(B.A_PERSONS) + f"""
SELECT {B.quarter_label('datetimeoccur')} AS utc_quarter,
  strftime(date_trunc('quarter', {B.local_ts('datetimeoccur')}), '%Y-%m-%dT%H:%M:%S.000000Z') AS quarter_dt_str,
  {B.quarter_label(B.local_ts('datetimeoccur'))} AS quarter,
  count(*) AS n_people
FROM a_persons GROUP BY 1, 2, 3""",

    "calendar_cols": _W(*_CUBE) + f"""
SELECT quarter,
  strftime(make_date(year, CAST(substr(q_str, 2, 1) AS INTEGER) * 3 - 2, 1), '%Y-%m-%dT%H:%M:%S.000000Z') AS quarter_dt_str,
  q_str, year, CAST(sum(n_stopped) AS BIGINT) AS n_stopped,
  CASE q_str {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SEASON_LABEL.items())} END || ' ' || CAST(year AS VARCHAR) AS season
FROM o_cube GROUP BY quarter, q_str, year""",

    "hin_cube": _W(B.A_PERSONS) + f"""
SELECT districtoccur, psa, quarter,
  CAST(sum(n_stopped_locatable) AS BIGINT) AS n_stopped_locatable,
  CAST(sum(n_stopped_locatable_on_hin) AS BIGINT) AS n_stopped_locatable_on_hin,
  {B.calendar_sql()}
FROM (SELECT *, {B.quarter_label(B.local_ts('datetimeoccur'))} AS quarter,
             {B.local_ts('datetimeoccur')} AS local_ts FROM a_persons) p
WHERE local_ts < {B.cutoff_lit(_MRQ)} AND districtoccur IS NOT NULL AND psa IS NOT NULL
GROUP BY districtoccur, psa, quarter""",

    "hin_flags": _W(B.A_PERSONS) + """
SELECT source_year, count(*) AS n_people,
  CAST(sum(n_stopped_locatable) AS BIGINT) AS n_stopped_locatable,
  CAST(sum(n_stopped_locatable_on_hin) AS BIGINT) AS n_stopped_locatable_on_hin
FROM a_persons GROUP BY source_year""",

    "shootings_cube": f"""
WITH s AS (
  SELECT o.o_orderdate AS date_, CAST(c.c_nationkey AS VARCHAR) AS dist,
    CASE o.o_orderstatus WHEN 'O' THEN 0.0 WHEN 'F' THEN 1.0 ELSE NULL END AS inside,
    {B.local_ts('o.o_orderdate')} AS local_ts
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderpriority = '1-URGENT')
SELECT {B.quarter_label('local_ts')} AS quarter,
  printf('%02d', coalesce(TRY_CAST(dist AS INTEGER), 0)) AS districtoccur,
  count(*) AS n_shootings,
  CAST(sum(CASE WHEN inside = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_outside,
  CAST(year(local_ts) AS INTEGER) AS year, 'Q' || CAST(quarter(local_ts) AS VARCHAR) AS q_str
FROM s WHERE local_ts < {B.cutoff_lit(_MRQ)}
GROUP BY 1, 2, 5, 6""",

    "merge_cubes": _W(*_CUBE) + f"""
SELECT {', '.join(C.REASON_KEYS)}, {', '.join(C.STOP_MEASURES)}
FROM o_reason_cube""",

    "snapshot_diff": _W(*_CUBE) + f"""
, old AS (SELECT CAST(year(local_ts) AS INTEGER) AS year, count(*) AS n FROM o_stops
          WHERE local_ts < {B.cutoff_lit('2000-Q3')} AND {' AND '.join(f'{k} IS NOT NULL' for k in C.REASON_KEYS)}
          GROUP BY 1),
  new AS (SELECT year, CAST(sum(n_stopped) AS BIGINT) AS n FROM o_reason_cube GROUP BY year)
SELECT coalesce(new.year, old.year) AS year,
  CAST(coalesce(new.n, 0) AS BIGINT) AS new_total, CAST(coalesce(old.n, 0) AS BIGINT) AS old_total,
  CAST(coalesce(new.n, 0) - coalesce(old.n, 0) AS BIGINT) AS diff
FROM new FULL JOIN old ON new.year = old.year""",

    "quality_gate": _W(*_CUBE) + f"""
, hin AS (SELECT {B.quarter_label(B.local_ts('datetimeoccur'))} AS quarter, districtoccur, psa
          FROM a_persons WHERE {B.local_ts('datetimeoccur')} < {B.cutoff_lit(_MRQ)}),
  hin_cube AS (SELECT quarter FROM hin WHERE districtoccur IS NOT NULL AND psa IS NOT NULL
               GROUP BY districtoccur, psa, quarter),
  sh AS (SELECT {B.local_ts('o.o_orderdate')} AS local_ts, c.c_nationkey
         FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
         WHERE o.o_orderpriority = '1-URGENT'),
  sh_cube AS (SELECT {B.quarter_label('local_ts')} AS quarter FROM sh
              WHERE local_ts < {B.cutoff_lit(_MRQ)} GROUP BY 1, c_nationkey),
  parts AS (
    SELECT 'stop_cube' AS "table", max(make_date(year, CAST(substr(q_str, 2, 1) AS INTEGER) * 3 - 2, 1)) AS m, count(*) AS n_rows FROM o_cube
    UNION ALL SELECT 'shootings', max(make_date(CAST(substr(quarter,1,4) AS INTEGER), CAST(substr(quarter, 7, 1) AS INTEGER) * 3 - 2, 1)), count(*) FROM sh_cube
    UNION ALL SELECT 'hin', max(make_date(CAST(substr(quarter,1,4) AS INTEGER), CAST(substr(quarter, 7, 1) AS INTEGER) * 3 - 2, 1)), count(*) FROM hin_cube)
SELECT "table", {B.quarter_label('m')} AS max_quarter, n_rows,
       {B.quarter_label('m')} = '{_MRQ}' AS ok
FROM parts
UNION ALL SELECT 'empty', NULL, 0, false
UNION ALL SELECT 'agreement', '{_MRQ}', count(DISTINCT districtoccur), false FROM o_cube
UNION ALL SELECT 'seed', NULL, CAST(sum(n_stopped) AS BIGINT), false FROM o_cube""",

    "null_rate": _W(B.A_PERSONS) + """
, w AS (SELECT count(*) AS n_rows,
      avg(CASE WHEN psa IS NULL THEN 1.0 ELSE 0.0 END) * 100.0 AS psa,
      avg(CASE WHEN gender IS NULL THEN 1.0 ELSE 0.0 END) * 100.0 AS gender,
      avg(CASE WHEN age IS NULL THEN 1.0 ELSE 0.0 END) * 100.0 AS age,
      avg(CASE WHEN mvc_code IS NULL THEN 1.0 ELSE 0.0 END) * 100.0 AS mvc_code,
      avg(CASE WHEN location IS NULL THEN 1.0 ELSE 0.0 END) * 100.0 AS location
    FROM a_persons)
SELECT n_rows, 'psa' AS column_name, psa AS pct_null FROM w
UNION ALL SELECT n_rows, 'gender', gender FROM w
UNION ALL SELECT n_rows, 'age', age FROM w
UNION ALL SELECT n_rows, 'mvc_code', mvc_code FROM w
UNION ALL SELECT n_rows, 'location', location FROM w""",
}


def csv_variant(sql: str) -> str:
    """The same query over person rows that went through a CSV file: the
    reader maps an empty text field to null (so an empty code is 'None')."""
    assert "    k.mvc_code," in sql
    return sql.replace("    k.mvc_code,", "    nullif(k.mvc_code, '') AS mvc_code,")
