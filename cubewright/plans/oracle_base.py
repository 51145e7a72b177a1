"""DuckDB SQL building blocks for the oracle side of the correctness check.

Every oracle query is ``WITH <blocks> SELECT ...`` over the pre-registered
test tables.  The blocks restate the analog views and the cube build in
plain SQL (window ``row_number`` for the driver, explicit joins), so the
Spark plans are checked against an independent formulation.
"""

from __future__ import annotations

from .. import config as C
from ..sources import analog as A
from ..functions import timeq as TQ


def _lit(v) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + str(v).replace("'", "''") + "'"


def _codes_values() -> str:
    rows = ",\n    ".join(f"({_lit(b)}, {_lit(c)})" for b, c in A.BRAND_CODES)
    return f"(VALUES\n    {rows}) t(p_brand, mvc_code)"


def _race_case(idx: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {_lit(v)}" for i, v in enumerate(A.RAW_RACES[:-1]))
    return f"CASE {idx} {whens} ELSE {_lit(A.RAW_RACES[-1])} END"


def seg_distance(px, py, x1, y1, x2, y2) -> str:
    """Distance of a point to a segment: to the nearest end, or, where the
    foot of the perpendicular lies between the ends, to the line."""
    dot = f"(({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1}))"
    len2 = f"(pow({x2} - {x1}, 2) + pow({y2} - {y1}, 2))"
    return (f"CASE WHEN {dot} <= 0 THEN sqrt(pow({px} - {x1}, 2) + pow({py} - {y1}, 2)) "
            f"WHEN {dot} >= {len2} THEN sqrt(pow({px} - {x2}, 2) + pow({py} - {y2}, 2)) "
            f"ELSE abs(({px} - {x1}) * ({y2} - {y1}) - ({py} - {y1}) * ({x2} - {x1})) / sqrt({len2}) END")


_NEAR = " OR ".join(f"{seg_distance('point_x', 'point_y', *map(repr, map(float, s[1:])))} <= {A.SEGMENT_DISTANCE!r}"
                    for s in A.SEGMENTS)

A_PERSONS = f"""
a_codes AS (SELECT * FROM {_codes_values()}),
a_persons AS (
  SELECT
    year(o.o_orderdate) AS source_year,
    l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_shipdate,
    o.o_orderdate AS datetimeoccur,
    CASE WHEN l.l_orderkey % 97 = 0 THEN NULL ELSE l.l_orderkey END AS location,
    CASE WHEN l.l_linenumber <= 6 THEN 'vehicle' ELSE 'pedestrian' END AS stoptype,
    lpad(CAST(c.c_nationkey AS VARCHAR), 2, '0') AS districtoccur,
    r.r_name AS division,
    CASE WHEN l.l_suppkey % 11 = 0 THEN NULL ELSE CAST(l.l_suppkey % 4 AS VARCHAR) END AS psa,
    {_race_case('(c.c_custkey + l.l_partkey) % 8')} AS race,
    CASE WHEN l.l_suppkey % 9 <= 4 THEN 'Male' WHEN l.l_suppkey % 9 <= 7 THEN 'Female' ELSE NULL END AS gender,
    CASE WHEN l.l_quantity = 50 THEN NULL ELSE l.l_quantity + 17 END AS age,
    CASE WHEN l.l_quantity > 45 THEN 1.0 ELSE 0.0 END AS individual_searched,
    CASE WHEN l.l_tax >= 0.08 THEN 1.0 ELSE 0.0 END AS vehicle_searched,
    CASE WHEN l.l_discount >= 0.09 THEN 1.0 ELSE 0.0 END AS individual_frisked,
    CAST(NULL AS DOUBLE) AS vehicle_frisked,
    CASE WHEN l.l_quantity = 1 THEN 1.0 ELSE 0.0 END AS individual_arrested,
    CASE WHEN l.l_linestatus = 'F' AND l.l_quantity > 42 THEN 1.0 ELSE 0.0 END AS individual_contraband,
    CAST(NULL AS DOUBLE) AS vehicle_contraband,
    k.mvc_code,
    CAST((l.l_partkey * 7 + l.l_suppkey) % 800 - 400 AS DOUBLE) / 1000.0 AS point_x,
    CAST((l.l_orderkey * 13 + l.l_linenumber) % 800 - 400 AS DOUBLE) / 1000.0 AS point_y,
    CASE WHEN point_y < {A.NETWORK_MAX_Y} THEN 1 ELSE 0 END AS n_stopped_locatable,
    CASE WHEN point_y < {A.NETWORK_MAX_Y} AND ({_NEAR}) THEN 1 ELSE 0 END AS n_stopped_locatable_on_hin
  FROM lineitem l
  JOIN orders o   ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n   ON c.c_nationkey = n.n_nationkey
  JOIN region r   ON n.n_regionkey = r.r_regionkey
  JOIN part p     ON l.l_partkey = p.p_partkey
  LEFT JOIN a_codes k ON p.p_brand = k.p_brand)"""


def local_ts(col: str) -> str:
    return f"timezone('{C.LOCAL_TZ}', {col} AT TIME ZONE 'UTC')"


def quarter_label(col: str) -> str:
    return f"(CAST(year({col}) AS VARCHAR) || '-Q' || CAST(quarter({col}) AS VARCHAR))"


def cutoff_lit(most_recent_quarter: str) -> str:
    return f"TIMESTAMP '{TQ.next_quarter_start_py(most_recent_quarter).isoformat()} 00:00:00'"


def _violation_case(col: str) -> str:
    whens = []
    for cat, clauses in C.VIOLATION_RULES:
        ors = []
        for cl in clauses:
            ands = []
            if "exact" in cl:
                ands.append(f"{col} = {_lit(cl['exact'])}")
            if "prefix" in cl:
                ands.append(f"{col} LIKE {_lit(cl['prefix'] + '%')}")
            if "contains" in cl:
                ands.append(f"{col} LIKE {_lit('%' + cl['contains'] + '%')}")
            if "not_prefix" in cl:
                ands.append(f"{col} NOT LIKE {_lit(cl['not_prefix'] + '%')}")
            if "not_contains" in cl:
                ands.append(f"{col} NOT LIKE {_lit('%' + cl['not_contains'] + '%')}")
            ors.append("(" + " AND ".join(ands) + ")")
        whens.append(f"WHEN {' OR '.join(ors)} THEN {_lit(cat)}")
    return ("CASE " + "\n      ".join(whens) +
            f" WHEN {col} IS NOT NULL THEN {_lit(C.VIOLATION_OTHER)} ELSE {_lit(C.VIOLATION_NONE)} END")


def _race_recode(col: str) -> str:
    whens = " ".join(f"WHEN {col} = {_lit(k)} THEN {_lit(v)}" for k, v in C.RACE_RECODE.items())
    return f"CASE {whens} ELSE {col} END"


def _age_band(col: str) -> str:
    whens = " ".join(f"WHEN {col} < {u} THEN {_lit(lab)}" for u, lab in C.AGE_BANDS)
    return f"CASE {whens} ELSE {_lit(C.AGE_BAND_ELSE)} END"


def _any(*sums: str) -> str:
    return "CASE WHEN " + " OR ".join(f"sum({s}) > 0" for s in sums) + " THEN 1 ELSE 0 END"


STOPS = f"""
o_vehicle AS (
  SELECT * FROM a_persons
  WHERE stoptype = 'vehicle' AND datetimeoccur IS NOT NULL AND location IS NOT NULL),
o_stop_agg AS (
  SELECT source_year, datetimeoccur, location,
    count(*) AS n_people_in_car,
    min(districtoccur) AS districtoccur, min(psa) AS psa, max(mvc_code) AS mvc_code_max,
    {_any('individual_searched', 'vehicle_searched')} AS was_searched,
    {_any('individual_arrested')} AS was_arrested,
    {_any('individual_contraband', 'vehicle_contraband')} AS was_found_with_contraband,
    {_any('individual_frisked', 'vehicle_frisked')} AS was_frisked,
    {_any('individual_frisked', 'vehicle_frisked', 'individual_searched', 'vehicle_searched')} AS was_intruded
  FROM o_vehicle GROUP BY source_year, datetimeoccur, location),
o_driver AS (
  SELECT source_year, datetimeoccur, location, race AS d_race, gender AS d_gender, age AS d_age
  FROM (SELECT *, row_number() OVER (PARTITION BY source_year, datetimeoccur, location
                  ORDER BY {', '.join(A.PERSON_ORDER)}) AS rn FROM o_vehicle) x
  WHERE rn = 1),
o_stops AS (
  SELECT s.*, {local_ts('s.datetimeoccur')} AS local_ts,
    {quarter_label(local_ts('s.datetimeoccur'))} AS quarter,
    {_race_recode('d.d_race')} AS race,
    d.d_gender AS gender,
    {_age_band('d.d_age')} AS age_range,
    {_violation_case("upper(replace(replace(replace(replace(replace(s.mvc_code_max, 'i', '1'), '(', ''), ')', ''), '-', ''), ' ', ''))")} AS violation_category
  FROM o_stop_agg s JOIN o_driver d
    ON s.source_year = d.source_year AND s.datetimeoccur = d.datetimeoccur AND s.location = d.location)"""


def calendar_sql(q: str = "quarter") -> str:
    return (f"CAST(substr({q}, 1, 4) AS INTEGER) AS year, substr({q}, 6, 2) AS q_str")


def reason_cube(mrq: str = "2000-Q4") -> str:
    keys = ", ".join(C.REASON_KEYS)
    notnull = " AND ".join(f"{k} IS NOT NULL" for k in C.REASON_KEYS)
    return f"""
o_reason_cube AS (
  SELECT {keys},
    CAST(count(*) AS BIGINT) AS n_stopped,
    CAST(sum(n_people_in_car) AS BIGINT) AS n_people_in_stopped_vehicles,
    CAST(sum(was_searched) AS BIGINT) AS n_searched,
    CAST(sum(was_arrested) AS BIGINT) AS n_arrested,
    CAST(sum(was_found_with_contraband) AS BIGINT) AS n_contraband,
    CAST(sum(was_frisked) AS BIGINT) AS n_frisked,
    CAST(sum(was_intruded) AS BIGINT) AS n_intruded,
    {calendar_sql()}
  FROM o_stops WHERE local_ts < {cutoff_lit(mrq)} AND {notnull}
  GROUP BY {keys}),
o_cube AS (
  SELECT {', '.join(C.STOP_KEYS)},
    {', '.join(f'CAST(sum({m}) AS BIGINT) AS {m}' for m in C.STOP_MEASURES)},
    {calendar_sql()}
  FROM o_reason_cube GROUP BY {', '.join(C.STOP_KEYS)})"""


def with_blocks(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip("\n") for b in blocks) + "\n"


CUBE_BLOCKS = (A_PERSONS, STOPS, reason_cube(C.ANALOG["most_recent_quarter"]))
