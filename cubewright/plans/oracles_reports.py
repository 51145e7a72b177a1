"""DuckDB oracle SQL for the report-side keys (see ``queries_reports``).

Written independently of the Spark code: plain GROUP BY / window / UNION
ALL SQL over the cube CTEs of ``oracle_base``.  Ratios use ``nullif`` (the
Spark side uses ``try_divide``), half-even rounding uses ``round_even``.
"""

from __future__ import annotations

from .. import config as C
from ..operators.filters import window_quarters
from ..sources import analog as A
from . import oracle_base as B
from .queries_reports import (AN, BASELINE_SLICES, CHOICES, COHORT1, COHORT2, COMPARE, LAST4,
                              SPINE, YEAR)

_W = B.with_blocks

O_DIVMAP = f"""
o_divmap AS (
  SELECT r.r_name AS division, lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') AS district
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION
  SELECT r_name, '{AN["shared_district"][0]}' FROM region WHERE r_name = '{AN["shared_district"][1]}')"""

O_POP = """
o_pop AS (
  SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS district,
    count(*) AS total,
    CAST(sum(CASE WHEN c_custkey % 100 < 4 * c_nationkey THEN 1 ELSE 0 END) AS BIGINT) AS white,
    CAST(sum(CASE WHEN c_custkey % 100 >= 4 * c_nationkey AND c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 1 ELSE 0 END) AS BIGINT) AS black,
    CAST(sum(CASE WHEN c_custkey % 100 >= 4 * c_nationkey AND c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END) AS BIGINT) AS asian,
    CAST(sum(CASE WHEN c_custkey % 100 >= 4 * c_nationkey AND c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END) AS BIGINT) AS hispanic_or_latino,
    CAST(sum(CASE WHEN c_custkey % 100 >= 4 * c_nationkey AND c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END) AS BIGINT) AS american_indian,
    CAST(0 AS BIGINT) AS unknown
  FROM customer GROUP BY c_nationkey)"""

CUBE = B.CUBE_BLOCKS + (O_DIVMAP, O_POP)


def W(*extra: str) -> str:
    return _W(*CUBE, *extra)


def qin(start, end) -> str:
    qs = window_quarters(SPINE, start, end)
    return "quarter IN (" + ", ".join(f"'{q}'" for q in qs) + ")"


def loc(location: str) -> str:
    if location == "*":
        return "TRUE"
    head = location.rstrip("*").split("-")
    if not head[0].isdigit() and head[0] != "zz":
        return f"districtoccur IN (SELECT district FROM o_divmap WHERE division = '{location}')"
    cond = f"districtoccur = '{head[0]}'"
    if len(head) > 1:
        cond += f" AND psa = '{head[1]}'"
    return cond


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def r1(x: str) -> str:
    return f"(round_even(({x}) * 10.0, 0) / 10.0)"


def avgm(total: str, nq: str) -> str:
    return f"CAST(round_even({ratio(total, nq)} / 3.0, 0) AS BIGINT)"


def enum_case(col: str, order) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{v}' THEN {i}" for i, v in enumerate(order)) + " END"


def season(col: str = "quarter") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SEASON_LABEL.items())
    return f"(CASE substr({col}, 6, 2) {whens} END || ' ' || substr({col}, 1, 4))"


def year_in(y: int) -> str:
    return qin(f"{y}-01-01", f"{y}-12-31")


NULLS = "CAST(NULL AS VARCHAR)"

# ---------------------------------------------------------------------------
# stops reports
# ---------------------------------------------------------------------------


def _num_stops(location: str, grain: str) -> str:
    x = "CAST(year AS VARCHAR)" if grain == "year" else "quarter"
    xl = "CAST(year AS VARCHAR)" if grain == "year" else season()
    eras = "".join(
        f"\nUNION ALL SELECT 'avg_monthly_era{i}', {NULLS}, {NULLS}, "
        f"CAST({avgm(f'sum(CASE WHEN {qin(s, e)} THEN n_stopped END)', f'count(DISTINCT CASE WHEN {qin(s, e)} THEN quarter END)')} AS DOUBLE) FROM d"
        for i, (s, e) in enumerate(AN["eras"], 1))
    return W(f"d AS (SELECT * FROM o_cube WHERE {loc(location)})") + f"""
SELECT 'n_stopped' AS series, {x} AS x, {xl} AS x_label, CAST(sum(n_stopped) AS DOUBLE) AS value
FROM d GROUP BY {grain}, year
UNION ALL SELECT 'total', {NULLS}, {NULLS}, CAST(sum(n_stopped) AS DOUBLE) FROM d""" + eras


def _kpi(rows: list[tuple[str, str]], src: str) -> str:
    return "\nUNION ALL ".join(f"SELECT '{m}' AS metric, CAST({v} AS DOUBLE) AS value FROM {src}"
                               for m, v in rows)


def _time_slice(start, end, location) -> str:
    return W(f"d AS (SELECT * FROM o_cube WHERE {loc(location)} AND {qin(start, end)})") + _kpi(
        [("total", "sum(n_stopped)"),
         ("avg_monthly", avgm("sum(n_stopped)", "count(DISTINCT quarter)"))], "d")


def _seasonal(quarters, location) -> str:
    ql = ", ".join(f"'{q}'" for q in quarters)
    return W() + f"""
SELECT year, CAST(sum(n_stopped) AS BIGINT) AS n_stopped FROM o_cube
WHERE {loc(location)} AND q_str IN ({ql})
GROUP BY year HAVING count(DISTINCT q_str) = {len(quarters)}"""


ENUMS = {"race": C.RACE_ORDER, "gender": C.GENDER_ORDER, "age_range": C.AGE_ORDER}


def _share_by_demo(cat, start, end, location="*") -> str:
    where = f"{loc(location)}" + (f" AND {qin(start, end)}" if start or end else "")
    return W() + f"""
, g AS (SELECT {cat} AS member, CAST(sum(n_stopped) AS BIGINT) AS n_stopped FROM o_cube
        WHERE {where} GROUP BY {cat})
SELECT member, n_stopped, {r1(f"{ratio('n_stopped', 'sum(n_stopped) OVER ()')} * 100.0")} AS percentage,
  {enum_case('member', ENUMS[cat])} AS member_order,
  CASE WHEN ({enum_case('member', ENUMS[cat])}) IS NOT NULL THEN member END AS label
FROM g"""


def _most_frequent(start, end, location="*", only_top=False) -> str:
    where = f"{loc(location)}" + (f" AND {qin(start, end)}" if start or end else "")
    return W() + f"""
, g AS (SELECT race, gender, age_range, CAST(sum(n_stopped) AS BIGINT) AS n_stopped FROM o_cube
        WHERE {where} GROUP BY race, gender, age_range),
  s AS (SELECT *, {r1(f"{ratio('n_stopped', 'sum(n_stopped) OVER ()')} * 100.0")} AS pct,
          row_number() OVER (ORDER BY n_stopped DESC, race, gender, age_range) = 1 AS is_top FROM g)
SELECT * FROM s WHERE pct > 0{' AND is_top' if only_top else ''}"""


def _demo(g) -> str:
    def lst(v):
        return ", ".join(f"'{x}'" for x in v)
    return (f"age_range IN ({lst(g['age_range'])}) AND gender IN ({lst(g['gender'])}) "
            f"AND race IN ({lst(g['race'])})")


def _cohorts(start=None, end=None) -> str:
    where = "TRUE" + (f" AND {qin(start, end)}" if start or end else "")
    ms = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in C.STOP_MEASURES)
    return W() + f"""
, u AS (SELECT 'Group 1' AS "group", * FROM o_cube WHERE {where} AND {_demo(COHORT1)}
        UNION ALL
        SELECT 'Group 2', * FROM o_cube WHERE {where} AND {_demo(COHORT2)})
SELECT "group", quarter, {ms}, {season()} AS season FROM u GROUP BY "group", quarter"""


def _snapshot(only_race=False) -> str:
    last = "quarter IN (" + ", ".join(f"'{q}'" for q in SPINE[-4:]) + ")"
    b, a = qin(*AN["before"]), qin(*AN["after"])

    def s(cond, m="n_stopped"):
        return f"sum(CASE WHEN {cond} THEN {m} END)"
    kpis = _kpi([
        ("n_total", s(last)),
        ("avg_monthly", avgm(s(last), f"count(DISTINCT CASE WHEN {last} THEN quarter END)")),
        ("pct_not_found", f"(1.0 - {ratio(s(last, 'n_contraband'), s(last, 'n_intruded'))}) * 100.0"),
        ("n_before", s(b)), ("n_after", s(a)),
        ("pct_decrease", r1(f"{ratio(f'{s(b)} - {s(a)}', s(b))} * 100.0")),
    ], "o_cube")
    metrics = ["pct_stops", "pct_population", "n_traffic_stops", "n_population", "pct_before",
               "pct_after", "n_before", "n_after", "decrease"]
    race_rows = "\nUNION ALL ".join(
        f"SELECT 'race' AS section, race, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM wide"
        for m in metrics)

    def share(c):
        return r1(f"{ratio(c, f'sum({c}) OVER ()')} * 100.0")
    body = f"""
, by_race AS (SELECT race, {s(last)} AS n_last, {s(b)} AS n_b, {s(a)} AS n_a FROM o_cube
              WHERE {last} OR {b} OR {a} GROUP BY race),
  pop_tot AS (SELECT sum(white) AS white, sum(black) AS black, sum(asian) AS asian,
                     sum(hispanic_or_latino) AS latino, sum(american_indian) + sum(unknown) AS other
              FROM o_pop),
  pop AS (SELECT 'White' AS race, white AS n_population FROM pop_tot
          UNION ALL SELECT 'Black', black FROM pop_tot
          UNION ALL SELECT 'Asian', asian FROM pop_tot
          UNION ALL SELECT 'Latino', latino FROM pop_tot
          UNION ALL SELECT 'All Other Races', other FROM pop_tot),
  j AS (SELECT coalesce(b.race, p.race) AS race, n_last, n_b, n_a, n_population
        FROM by_race b FULL JOIN pop p ON b.race = p.race),
  wide AS (SELECT race, {share('n_last')} AS pct_stops, {share('n_population')} AS pct_population,
             n_last AS n_traffic_stops, n_population, {share('n_b')} AS pct_before,
             {share('n_a')} AS pct_after, n_b AS n_before, n_a AS n_after, n_b - n_a AS decrease FROM j)
"""
    if only_race:
        return W() + body + race_rows
    k = "\nUNION ALL ".join(
        f"SELECT 'kpi' AS section, {NULLS} AS race, metric, value FROM ({q})"
        for q in kpis.split("\nUNION ALL "))
    return W() + body + k + "\nUNION ALL " + race_rows


# ---------------------------------------------------------------------------
# neighborhoods
# ---------------------------------------------------------------------------

def _intrusions(location, grain) -> str:
    x = "CAST(year AS VARCHAR)" if grain == "year" else "quarter"
    xl = "CAST(year AS VARCHAR)" if grain == "year" else season()
    rows = [("num_total", "sum(n_intruded)"),
            ("pct_total", r1(ratio("sum(n_intruded) * 100.0", "sum(n_stopped)")))]
    for i, (s, e) in enumerate(AN["eras"], 1):
        nq = len(window_quarters(SPINE, s, e))
        v = f"(CAST(sum(CASE WHEN {qin(s, e)} THEN n_intruded END) AS DOUBLE) / {nq}.0)"
        vs = f"(CAST(sum(CASE WHEN {qin(s, e)} THEN n_stopped END) AS DOUBLE) / {nq}.0)"
        rows += [(f"avg_monthly_era{i}", f"round_even({v} / 3.0, 0)"),
                 (f"avg_monthly_stops_era{i}", f"round_even({vs} / 3.0, 0)"),
                 (f"pct_era{i}", r1(f"{ratio(v, vs)} * 100.0"))]
    k = "\nUNION ALL ".join(f"SELECT {NULLS}, {NULLS}, '{m}', CAST({v} AS DOUBLE) FROM d" for m, v in rows)
    return W(f"d AS (SELECT * FROM o_cube WHERE {loc(location)})") + f"""
, g AS (SELECT {x} AS x, {xl} AS x_label, sum(n_intruded) AS n_intruded, sum(n_stopped) AS n_stopped
        FROM d GROUP BY {grain}, year)
SELECT x, x_label, 'n_intruded' AS series, CAST(n_intruded AS DOUBLE) AS value FROM g
UNION ALL SELECT x, x_label, 'intrusion_rate', {r1(f"{ratio('n_intruded', 'n_stopped')} * 100.0")} FROM g
UNION ALL {k}"""


def _search_frisk(location, grain) -> str:
    x = "CAST(year AS VARCHAR)" if grain == "year" else "quarter"
    xl = "CAST(year AS VARCHAR)" if grain == "year" else season()
    return W() + f"""
, g AS (SELECT {x} AS x, {xl} AS x_label, CAST(sum(n_frisked) AS BIGINT) AS n_frisked,
          CAST(sum(n_searched) AS BIGINT) AS n_searched, CAST(sum(n_stopped) AS BIGINT) AS n_stopped
        FROM o_cube WHERE {loc(location)} GROUP BY {grain}, year),
  r AS (SELECT *, {r1(ratio('100.0 * n_searched', 'n_stopped'))} AS search_rate,
          {r1(ratio('100.0 * n_frisked', 'n_stopped'))} AS frisk_rate FROM g)
SELECT x, x_label, n_frisked, n_searched, n_stopped, search_rate, frisk_rate,
  '# of searches' AS "group", n_searched AS total_count FROM r
UNION ALL SELECT x, x_label, n_frisked, n_searched, n_stopped, search_rate, frisk_rate,
  '# of frisks', n_frisked FROM r"""


def _status(num: str, den: str, baseline: str) -> str:
    return (f"CASE WHEN member = '{baseline}' THEN 'Baseline' WHEN {den} = 0 AND {num} = 0 THEN 'zero' "
            f"WHEN {num} IS NULL OR {den} IS NULL THEN 'zero' WHEN {den} = 0 THEN 'above' "
            f"ELSE 'ratio' END")


def _baseline(cat, baseline, start, end, location="*", label_only=False) -> str:
    cols = []
    for col, tag in (("percentage", ""), ("no_contraband", "nc_"), ("percentage_found", "found_")):
        b = f"max(CASE WHEN member = '{baseline}' THEN {col} END) OVER ()"
        cols += [col, f"{ratio(col, b)} AS {tag}multiplier",
                 f"{r1(f'abs({ratio(col, b)})')} AS {tag}multiplier_1dp",
                 f"{_status(col, b, baseline)} AS {tag}status"]
        if col == "percentage":
            cols.append(f"{ratio(f'100.0 * ({col} - {b})', b)} AS percentage_diff")
    sel = ",\n  ".join(cols)
    if label_only:
        outer = (f"'{location}' AS slice, member, percentage, multiplier, status, no_contraband, "
                 "nc_multiplier, nc_status, percentage_found, found_multiplier, found_status")
    else:
        outer = "*"
    return W() + f"""
, g AS (SELECT {cat} AS member, CAST(sum(n_stopped) AS BIGINT) AS n_stopped,
          CAST(sum(n_intruded) AS BIGINT) AS n_intruded, CAST(sum(n_contraband) AS BIGINT) AS n_contraband
        FROM o_cube WHERE {loc(location)} AND {qin(start, end)} GROUP BY {cat}),
  h AS (SELECT *, {r1(ratio('100.0 * n_intruded', 'n_stopped'))} AS percentage,
          greatest(n_intruded - n_contraband, 0) AS no_contraband,
          coalesce({r1(f"100.0 - (100.0 - {ratio('n_contraband', 'n_intruded')} * 100.0)")}, 0.0) AS percentage_found
        FROM g),
  o AS (SELECT member, {enum_case('member', ENUMS[cat])} AS member_order, n_stopped, n_intruded, n_contraband,
  {sel},
  {ratio('sum(n_intruded) OVER ()', 'sum(n_stopped) OVER ()')} * 100.0 AS total_rate,
  (1.0 - {ratio('sum(n_contraband) OVER ()', 'sum(n_intruded) OVER ()')}) * 100.0 AS total_not_found
  FROM h WHERE EXISTS (SELECT 1 FROM h h2 WHERE h2.member = '{baseline}'))
SELECT {outer} FROM o"""


def _whiteness(measure, start, end) -> str:
    others = [c for c in ("n_stopped", "n_intruded", "n_contraband") if c != measure]
    where = qin(start, end) if start or end else "TRUE"

    def fit(col):
        return (f"(round_even(greatest(regr_intercept({col}, whiteness) OVER () + "
                f"regr_slope({col}, whiteness) OVER () * whiteness, 0.0) * 10000.0, 0) / 10000.0) AS fit_{col}")
    return W() + f"""
, g AS (SELECT districtoccur, {', '.join(f'CAST(sum({m}) AS BIGINT) AS {m}' for m in C.STOP_MEASURES)}
        FROM o_cube WHERE {where} GROUP BY districtoccur),
  wh AS (SELECT district, total AS n_people, {r1(f"{ratio('white', 'total')} * 100.0")} AS whiteness FROM o_pop),
  j AS (SELECT g.districtoccur, wh.whiteness, wh.n_people, g.{measure}, {', '.join('g.' + c for c in others)},
          {r1(f"{ratio('n_intruded', 'n_stopped')} * 100.0")} AS intrusion_rate,
          {r1(f"{ratio('n_intruded - n_contraband', 'n_intruded')} * 100.0")} AS intrusion_miss_rate,
          {r1(f"{ratio('n_contraband', 'n_intruded')} * 100.0")} AS contraband_hit_rate
        FROM g JOIN wh ON g.districtoccur = wh.district
        WHERE g.districtoccur <> '{C.AIRPORT_DISTRICT}' AND wh.whiteness IS NOT NULL)
SELECT *, {fit(measure)}, {fit('intrusion_rate')}, {fit('contraband_hit_rate')} FROM j"""


def _compare(districts, measure, start, end) -> str:
    one = []
    for i, d in enumerate(districts):
        head, _, psa = d.rstrip("*").partition("-")
        if d == "*":
            label, cond = "CAST(NULL AS VARCHAR)", "true"
        elif d.isalpha() and d.isupper():
            label = "CAST(NULL AS VARCHAR)"
            cond = f"districtoccur IN (SELECT district FROM o_divmap WHERE division = '{d}')"
        else:
            label, cond = f"'{head}'", f"districtoccur = '{head}'" + (f" AND psa = '{psa}'" if psa else "")
        one.append(f"SELECT {i} AS pos, {label} AS district, CAST(coalesce(sum({measure}), 0) AS BIGINT) AS {measure} "
                   f"FROM o_cube WHERE {qin(start, end)} AND {cond}")
    return W() + "\n" + "\nUNION ALL\n".join(one)


# ---------------------------------------------------------------------------
# safety
# ---------------------------------------------------------------------------

HIN_CUBE = f"""
o_hin AS (
  SELECT districtoccur, psa, quarter,
    CAST(sum(n_stopped_locatable) AS BIGINT) AS n_stopped_locatable,
    CAST(sum(n_stopped_locatable_on_hin) AS BIGINT) AS n_stopped_locatable_on_hin,
    CAST(substr(quarter, 1, 4) AS INTEGER) AS year
  FROM (SELECT *, {B.quarter_label(B.local_ts('datetimeoccur'))} AS quarter,
               {B.local_ts('datetimeoccur')} AS local_ts FROM a_persons) p
  WHERE local_ts < {B.cutoff_lit(AN['most_recent_quarter'])} AND districtoccur IS NOT NULL AND psa IS NOT NULL
  GROUP BY districtoccur, psa, quarter)"""


def _hin(location, grain) -> str:
    x = "CAST(year AS VARCHAR)" if grain == "year" else "quarter"
    b, a = qin(*AN["before"]), qin(*AN["after"])

    def s(cond, m):
        return f"sum(CASE WHEN {cond} THEN {m} END)"
    rb = ratio(s(b, "n_stopped_locatable_on_hin"), s(b, "n_stopped_locatable"))
    ra = ratio(s(a, "n_stopped_locatable_on_hin"), s(a, "n_stopped_locatable"))
    return _W(B.A_PERSONS, O_DIVMAP, HIN_CUBE) + f"""
SELECT 'pct_in_hin' AS series, {x} AS x, {x} AS x_label,
  {r1(ratio('100.0 * sum(n_stopped_locatable_on_hin)', 'sum(n_stopped_locatable)'))} AS value
FROM o_hin WHERE {loc(location)} GROUP BY {grain}, year
UNION ALL SELECT 'ratio_before', {NULLS}, {NULLS}, {rb} FROM o_hin
UNION ALL SELECT 'ratio_after', {NULLS}, {NULLS}, {ra} FROM o_hin
UNION ALL SELECT 'pct_increase', {NULLS}, {NULLS}, {r1(ratio(f'100.0 * ({ra} - {rb})', rb))} FROM o_hin"""


SHOOT_CUBE = f"""
o_sh AS (
  SELECT {B.quarter_label('local_ts')} AS quarter,
    printf('%02d', coalesce(TRY_CAST(dist AS INTEGER), 0)) AS districtoccur,
    count(*) AS n_shootings
  FROM (SELECT CAST(c.c_nationkey AS VARCHAR) AS dist, {B.local_ts('o.o_orderdate')} AS local_ts
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        WHERE o.o_orderpriority = '1-URGENT') s
  WHERE local_ts < {B.cutoff_lit(AN['most_recent_quarter'])}
  GROUP BY 1, 2)"""


def _compare_windows(start, end, dec, inc) -> str:
    def side(win, tag):
        return f"""
  s_{tag} AS (SELECT quarter, districtoccur, sum(n_stopped) AS n_stopped FROM o_cube
              WHERE {qin(*win)} GROUP BY quarter, districtoccur),
  d_{tag} AS (SELECT s.districtoccur, CAST(sum(s.n_stopped) AS BIGINT) AS n_stopped_{tag},
                CAST(coalesce(sum(sh.n_shootings), 0) AS BIGINT) AS n_shootings_{tag}
              FROM s_{tag} s LEFT JOIN o_sh sh ON s.quarter = sh.quarter AND s.districtoccur = sh.districtoccur
              GROUP BY s.districtoccur)"""

    def pch(c):
        return ratio(f"100.0 * ({c}_end - {c}_start)", f"{c}_start")

    def key(c):
        return f"CASE WHEN {c}_start = 0 AND {c}_end > 0 THEN 'infinity'::DOUBLE ELSE {pch(c)} END"
    return W(SHOOT_CUBE) + f""",{side(start, 'start')},{side(end, 'end')},
  j AS (SELECT a.districtoccur, n_stopped_start, n_shootings_start, n_stopped_end, n_shootings_end
        FROM d_start a LEFT JOIN d_end b ON a.districtoccur = b.districtoccur
        WHERE a.districtoccur <> '{C.AIRPORT_DISTRICT}'),
  k AS (SELECT *, {key('n_stopped')} AS key_n_stopped, {key('n_shootings')} AS key_n_shootings,
          {pch('n_stopped')} AS pct_change_n_stopped, {pch('n_shootings')} AS pct_change_n_shootings FROM j),
  r AS (SELECT *,
          CASE WHEN key_{inc} IS NOT NULL THEN rank() OVER (ORDER BY key_{inc} DESC NULLS LAST) END AS ranked_{inc}_increase,
          CASE WHEN key_{dec} IS NOT NULL THEN count(key_{dec}) OVER (ORDER BY key_{dec} ASC NULLS LAST
               RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS ranked_{dec}_decrease
        FROM k),
  f AS (SELECT *, coalesce(ranked_{dec}_decrease <= 5, FALSE) AS is_top_5_decrease,
          coalesce(ranked_{inc}_increase <= 5, FALSE) AS is_top_5_increase,
          CAST(sum(n_stopped_start) OVER () AS BIGINT) AS total_stopped_start,
          CAST(sum(n_stopped_end) OVER () AS BIGINT) AS total_stopped_end FROM r)"""


_FCOLS = ("districtoccur, n_stopped_start, n_shootings_start, n_stopped_end, n_shootings_end, "
          "pct_change_n_stopped, pct_change_n_shootings, {ri}, {rd}, is_top_5_decrease, "
          "is_top_5_increase, total_stopped_start, total_stopped_end")


def _window_map(start, end, dec, inc) -> str:
    cols = _FCOLS.format(ri=f"ranked_{inc}_increase", rd=f"ranked_{dec}_decrease")
    return _compare_windows(start, end, dec, inc) + f"""
SELECT * FROM (SELECT {cols}, 'most_decreased' AS source FROM f
               ORDER BY key_{dec} ASC NULLS LAST, districtoccur LIMIT 5)
UNION ALL
SELECT * FROM (SELECT {cols}, 'most_increased' AS source FROM f
               ORDER BY key_{inc} DESC NULLS LAST, districtoccur LIMIT 5)"""


POLY_VALUES = ", ".join(f"({i}, '{lab}')" for i, (lab, _) in enumerate(A.POLYGONS))


def _topk_flags() -> str:
    (s, e), = AN["map_windows"]
    a = _window_map(s, e, "n_shootings", "n_stopped")
    b = _window_map(AN["before"], AN["after"], "n_stopped", "n_shootings")

    parts = []
    for sql, tag in ((a, "surge"), (b, "before_after")):
        parts.append(f"""
SELECT p.pos, p.label, substr(p.label, 1, 2) AS district, t.source, t.is_top_5_decrease,
  t.is_top_5_increase, '{tag}' AS map
FROM (VALUES {POLY_VALUES}) p(pos, label)
JOIN (SELECT *, row_number() OVER (PARTITION BY districtoccur
                 ORDER BY CASE WHEN source = 'most_decreased' THEN 0 ELSE 1 END) AS rn
      FROM ({sql})) t
  ON substr(p.label, 1, 2) = t.districtoccur AND t.rn = 1""")
    return parts


def _reason_by_race(year) -> str:
    return W() + f"""
, g AS (SELECT race, violation_category, CAST(sum(n_stopped) AS BIGINT) AS n_stopped FROM o_reason_cube
        WHERE {year_in(year)} AND violation_category NOT IN ('Other', 'None')
        GROUP BY race, violation_category)
SELECT *, {r1(f"100.0 * {ratio('n_stopped', 'sum(n_stopped) OVER (PARTITION BY race)')}")} AS pct_stopped,
  CAST(row_number() OVER (ORDER BY CASE WHEN race = 'Black' THEN 0 ELSE 1 END, n_stopped DESC, race,
                          violation_category) AS INTEGER) AS display_order
FROM g WHERE race IN ('White', 'Black')"""


def _reason_by_area(year) -> str:
    return W() + f"""
, ms AS (SELECT district, CASE WHEN {ratio('white', 'total')} > 0.5 THEN 'Majority white'
                               WHEN {ratio('white', 'total')} <= 0.5 THEN 'Majority non-white' END AS majority_district
         FROM o_pop),
  g AS (SELECT violation_category, ms.majority_district, CAST(sum(n_stopped) AS BIGINT) AS n_stopped
        FROM o_reason_cube r JOIN ms ON r.districtoccur = ms.district
        WHERE {year_in(year)} AND violation_category NOT IN ('Other', 'None') AND ms.majority_district IS NOT NULL
        GROUP BY violation_category, ms.majority_district)
SELECT *, {r1(f"100.0 * {ratio('n_stopped', 'sum(n_stopped) OVER (PARTITION BY majority_district)')}")} AS pct_stopped,
  CAST(row_number() OVER (ORDER BY CASE WHEN majority_district = 'Majority non-white' THEN 0 ELSE 1 END,
                          n_stopped DESC, majority_district, violation_category) AS INTEGER) AS display_order
FROM g"""


def _covered(start, end, grain) -> str:
    x = "CAST(year AS VARCHAR)" if grain == "year" else "quarter"
    xl = "CAST(year AS VARCHAR)" if grain == "year" else season()
    cats = ", ".join(f"'{c}'" for c in C.COVERED_CATEGORIES)
    return W() + f"""
SELECT {x} AS x, {xl} AS x_label, violation_category, CAST(sum(n_stopped) AS BIGINT) AS n_stopped
FROM o_reason_cube WHERE {qin(start, end)} AND violation_category IN ({cats})
GROUP BY {grain}, year, violation_category"""


def _operational(year) -> str:
    cats = ", ".join(f"'{c}'" for c in C.OPERATIONAL_CATEGORIES)
    return W() + f"""
, g AS (SELECT race, CAST(sum(CASE WHEN violation_category IN ({cats}) THEN n_stopped END) AS BIGINT) AS n_operational,
          CAST(sum(n_stopped) AS BIGINT) AS n_stopped
        FROM o_reason_cube WHERE {year_in(year)} GROUP BY race)
SELECT race, {enum_case('race', C.RACE_ORDER)} AS member_order, n_operational, n_stopped,
  {r1(f"{ratio('n_operational', 'n_stopped')} * 100.0")} AS pct_operational FROM g"""


# ---------------------------------------------------------------------------
# spatial
# ---------------------------------------------------------------------------

def _edges_values() -> str:
    rows = []
    for pos, (lab, ring) in enumerate(A.POLYGONS):
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
            rows.append(f"({pos}, '{lab}', {float(x1)!r}, {float(y1)!r}, {float(x2)!r}, {float(y2)!r})")
    return "(VALUES " + ", ".join(rows) + ") t(pos, label, x1, y1, x2, y2)"


def _segs_values() -> str:
    rows = [f"('{n}', {float(a)!r}, {float(b)!r}, {float(c)!r}, {float(d)!r})" for n, a, b, c, d in A.SEGMENTS]
    return "(VALUES " + ", ".join(rows) + ") t(name, x1, y1, x2, y2)"


PTS = "o_pts AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)"


def _pip(points="o_pts", x="x", y="y", key="vec_id") -> str:
    # the side of the edge that the point lies on, no division
    turn = f"((e.x2 - e.x1) * (p.{y} - e.y1) - (p.{x} - e.x1) * (e.y2 - e.y1))"
    cross = f"((e.y1 > p.{y}) <> (e.y2 > p.{y}) AND CASE WHEN e.y2 > e.y1 THEN {turn} > 0 ELSE {turn} < 0 END)"
    onedge = (f"({turn} = 0 AND p.{x} >= least(e.x1, e.x2) AND p.{x} <= greatest(e.x1, e.x2) "
              f"AND p.{y} >= least(e.y1, e.y2) AND p.{y} <= greatest(e.y1, e.y2))")
    return f"""
  o_edges AS (SELECT * FROM {_edges_values()}),
  o_par AS (SELECT p.{key}, e.pos, e.label,
              sum(CASE WHEN {cross} THEN 1 ELSE 0 END) AS n_cross,
              max(CASE WHEN {onedge} THEN 1 ELSE 0 END) AS on_edge
            FROM {points} p JOIN o_edges e ON p.{y} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)
            GROUP BY p.{key}, e.pos, e.label),
  o_in AS (SELECT {key}, arg_min(label, pos) AS label FROM o_par
           WHERE n_cross % 2 = 1 AND on_edge = 0 GROUP BY {key})"""


def _dist(px, py) -> str:
    return B.seg_distance(px, py, "s.x1", "s.y1", "s.x2", "s.y2")


def _sample(n=100) -> str:
    return (f"o_sample AS (SELECT * FROM o_pts WHERE y < {C.LOCATABLE_MAX_Y} "
            f"ORDER BY md5('42' || '|' || CAST(vec_id AS VARCHAR)) LIMIT {n})")


def _hin_points() -> str:
    return f"""WITH {PTS}, {_sample()},
  o_segs AS (SELECT * FROM {_segs_values()}),
  o_j AS (SELECT p.vec_id, p.x AS lng, p.y AS lat, s.name AS stname
          FROM o_sample p LEFT JOIN o_segs s ON {_dist('p.x', 'p.y')} <= {A.SEGMENT_DISTANCE!r})
"""


# ---------------------------------------------------------------------------

(_S, _E), = AN["map_windows"]
_T5 = _topk_flags()

ORACLES = {
    "r_num_stops": _num_stops("*", "year"),
    "r_time_slice": _time_slice(*LAST4, "*"),
    "r_seasonal": _seasonal(["Q1", "Q3"], "07*"),
    "r_share_by_demo": _share_by_demo("race", *LAST4),
    "r_most_frequent": _most_frequent(*LAST4),
    "r_cohorts": _cohorts(*LAST4),
    "r_snapshot": _snapshot(),
    "r_intrusions": _intrusions("*", "quarter"),
    "r_search_frisk": _search_frisk("ASIA", "year"),
    "r_baseline": _baseline("age_range", "35-44", SPINE[0], SPINE[-1]),
    "r_whiteness": _whiteness("n_frisked", SPINE[0], SPINE[-1]),
    "r_compare_districts": _compare(COMPARE, "n_frisked", SPINE[0], SPINE[-1]),
    "r_hin": _hin("*", "year"),
    "r_surge_map": _window_map(_S, _E, "n_shootings", "n_stopped"),
    "r_before_after_map": _window_map(AN["before"], AN["after"], "n_stopped", "n_shootings"),
    "r_reason_by_race": _reason_by_race(YEAR),
    "r_reason_by_area": _reason_by_area(YEAR),
    "r_covered_reasons": _covered(f"{YEAR}-01-01", SPINE[-1], "quarter"),
    "r_operational": _operational(YEAR),
    "r_hin_points": _hin_points() + """
SELECT vec_id, lng, lat, stname IS NOT NULL AS on_hin, stname,
  CASE WHEN stname IS NOT NULL THEN 'Traffic stop on the HIN' ELSE 'Traffic stop not on the HIN' END AS hover_text
FROM o_j""",
    "map_extent": _hin_points() + """
SELECT quantile_cont(lat, 0.5) AS median_lat, quantile_cont(lng, 0.5) AS median_lng, count(*) AS n_rows,
  CAST(sum(CASE WHEN stname IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_on_hin FROM o_j""",
    "sample_n": f"WITH {PTS}, {_sample()} SELECT vec_id, x, y FROM o_sample",
    "point_in_polygon": f"WITH {PTS}, {_pip()}" + f"""
SELECT p.vec_id, i.label AS psa_num, coalesce(right(i.label, 1), '{C.UNKNOWN_PSA}') AS psa
FROM o_pts p LEFT JOIN o_in i ON p.vec_id = i.vec_id""",
    "points_near_lines": f"WITH {PTS}, o_segs AS (SELECT * FROM {_segs_values()})" + f"""
SELECT p.vec_id, s.name AS line_name
FROM o_pts p LEFT JOIN o_segs s ON {_dist('p.x', 'p.y')} <= {A.SEGMENT_DISTANCE!r}""",
    "hin_points_any": f"WITH {PTS}, o_segs AS (SELECT * FROM {_segs_values()})" + f"""
SELECT p.vec_id, count(s.name) > 0 AS on_line, CAST(count(s.name) AS INTEGER) AS n_lines, min(s.name) AS line_name
FROM o_pts p LEFT JOIN o_segs s ON {_dist('p.x', 'p.y')} <= {A.SEGMENT_DISTANCE!r}
GROUP BY p.vec_id""",
    "remap_district": _W(B.A_PERSONS) + ", o_pp AS (SELECT row_number() OVER () AS pid, * FROM a_persons), "
    + "o_need AS (SELECT pid, point_x, point_y FROM o_pp WHERE districtoccur IN ('06', '09')), "
    + _pip("o_need", "point_x", "point_y", "pid").lstrip() + """
SELECT CASE WHEN p.districtoccur IN ('06', '09') THEN '09' ELSE p.districtoccur END AS districtoccur,
  CASE WHEN p.districtoccur IN ('06', '09') THEN coalesce(substr(i.label, 3, 1), '-1') ELSE p.psa END AS psa,
  count(*) AS n_people
FROM o_pp p LEFT JOIN o_in i ON p.pid = i.pid
GROUP BY 1, 2""",
    "topk_flags": "\nUNION ALL\n".join(_T5),
}


def _add(key: str, sql: str) -> None:
    ORACLES[key] = sql


# operator-level keys
_add("filter_location", W() + """
SELECT districtoccur, psa, CAST(sum(n_stopped) AS BIGINT) AS n_stopped, '07*' AS location FROM o_cube
WHERE districtoccur = '07' GROUP BY districtoccur, psa
UNION ALL SELECT districtoccur, psa, CAST(sum(n_stopped) AS BIGINT), '12-3' FROM o_cube
WHERE districtoccur = '12' AND psa = '3' GROUP BY districtoccur, psa
UNION ALL SELECT districtoccur, psa, CAST(sum(n_stopped) AS BIGINT), 'zz' FROM o_cube
WHERE districtoccur = 'zz' GROUP BY districtoccur, psa""")
_add("filter_division", W() + f"""
SELECT districtoccur, CAST(sum(n_stopped) AS BIGINT) AS n_stopped FROM o_cube
WHERE {loc('AFRICA')} GROUP BY districtoccur""")
_add("filter_quarters", W() + f"""
SELECT quarter, CAST(sum(n_stopped) AS BIGINT) AS n_stopped FROM o_cube
WHERE {qin('1996-Q2', '1997-Q3')} GROUP BY quarter""")
_add("filter_demo", W() + f"""
SELECT race, age_range, CAST(sum(n_stopped) AS BIGINT) AS n_stopped FROM o_cube
WHERE {_demo({'age_range': ['Under 25', '65+'], 'gender': ['Female'], 'race': ['Asian', 'White', 'Latino']})}
GROUP BY race, age_range""")
_ch = " OR ".join("(" + (" AND ".join(f"{k} = '{v}'" for k, v in ch.items() if v is not None) or "TRUE") + ")"
                  for ch in CHOICES)
_add("filter_demo_choices", W() + f"""
SELECT gender, race, age_range, CAST(sum(n_stopped) AS BIGINT) AS n_stopped FROM o_cube
WHERE {_ch} GROUP BY gender, race, age_range""")
_ops = ", ".join(f"'{c}'" for c in C.OPERATIONAL_CATEGORIES)
_add("filter_reason", W() + f"""
SELECT 'excluded_other_none' AS metric, CAST(sum(n_stopped) AS BIGINT) AS n_stopped FROM o_reason_cube
WHERE violation_category NOT IN ('Other', 'None')
UNION ALL SELECT 'operational', CAST(sum(n_stopped) AS BIGINT) FROM o_reason_cube
WHERE violation_category IN ({_ops})""")
_add("trend_by_grain", W() + """
SELECT quarter, CAST(sum(n_stopped) AS BIGINT) AS n_stopped, CAST(sum(n_searched) AS BIGINT) AS n_searched,
  CAST(sum(n_frisked) AS BIGINT) AS n_frisked, CAST(sum(n_intruded) AS BIGINT) AS n_intruded
FROM o_cube GROUP BY quarter""")
_add("rollup_prefix", W() + f"""
SELECT year, {', '.join(f'CAST(sum({m}) AS BIGINT) AS {m}' for m in C.STOP_MEASURES)}
FROM o_cube GROUP BY year""")
_add("total_and_rate", W() + _kpi([
    ("n_intruded", "sum(n_intruded)"),
    ("pct_intruded", r1(ratio("100.0 * sum(n_intruded)", "sum(n_stopped)")))], "o_cube"))
_add("avg_monthly", W() + f"""
SELECT {avgm('sum(n_stopped)', 'count(DISTINCT quarter)')} AS value FROM o_cube
WHERE {qin('1998-Q1', '1999-Q4')}""")
_add("avg_monthly_merged", W() + f"""
SELECT districtoccur, CAST(sum(n_stopped) AS BIGINT) AS n_stopped, {avgm('sum(n_stopped)', 'count(DISTINCT quarter)')} AS value,
  count(DISTINCT quarter) AS n_quarters FROM o_cube
WHERE {qin('1998-Q1', '1999-Q4')} GROUP BY districtoccur""")
_nq = len(window_quarters(SPINE, "1998-Q1", "1999-Q4"))
_add("avg_monthly_calendar", W(f"d AS (SELECT * FROM o_cube WHERE districtoccur = '07' AND psa = '1' "
                               f"AND {qin('1998-Q1', '1999-Q4')} AND race = 'Asian')") + _kpi([
    ("avg_present", avgm("sum(n_stopped)", "count(DISTINCT quarter)")),
    ("avg_calendar", avgm("sum(n_stopped)", str(_nq)))], "d"))
_add("share_by_demo", _share_by_demo("age_range", None, None))
_add("rate_by_demo", W() + f"""
SELECT gender, CAST(sum(n_intruded) AS BIGINT) AS n_intruded, CAST(sum(n_stopped) AS BIGINT) AS n_stopped,
  {r1(ratio('100.0 * sum(n_intruded)', 'sum(n_stopped)'))} AS intrusion_rate
FROM o_cube GROUP BY gender""")
_add("operational_share", _operational(1997))
_add("miss_rate", W() + _kpi([("pct_not_found",
                                f"(1.0 - {ratio('sum(n_contraband)', 'sum(n_intruded)')}) * 100.0")], "o_cube"))
_add("seasonal_complete", _seasonal(["Q4", "Q1"], "*"))
_add("compare_list", _compare(["24", "zz", "01-2", "ASIA", "01"], "n_stopped", "1997-01-01", "1997-12-31"))
_add("cohort_compare", _cohorts())
_add("majority_split", _W(O_POP) + f"""
SELECT district, CASE WHEN {ratio('white', 'total')} > 0.5 THEN 'Majority white'
                      WHEN {ratio('white', 'total')} <= 0.5 THEN 'Majority non-white' END AS majority_district
FROM o_pop""")
_add("ols_trend", _whiteness("n_stopped", None, None).replace(
    "\nSELECT *, ", "\nSELECT districtoccur, whiteness, n_stopped, ", 1).rsplit(", (round_even(greatest(regr_intercept(intrusion_rate", 1)[0] + " FROM j")
_pcr_cols = _FCOLS.format(ri="ranked_n_stopped_increase", rd="ranked_n_shootings_decrease")
_add("pct_change_rank", _compare_windows(_S, _E, "n_shootings", "n_stopped") + f"\nSELECT {_pcr_cols} FROM f")
_add("share_within_group", _reason_by_race(1997))
_add("baseline_ratio", _baseline("race", "White", "1997-01-01", "1998-12-31", location="ASIA"))
_add("enum_sort", W() + f"""
SELECT age_range, CAST(sum(n_stopped) AS BIGINT) AS n_stopped, {enum_case('age_range', C.AGE_ORDER)} AS member_order
FROM o_cube GROUP BY age_range""")
_add("most_frequent_group", _most_frequent(None, None, only_top=True))
_add("ranked_demographics", _most_frequent("1996-Q1", "1996-Q4", location="ASIA"))
_add("unpivot_rates", _search_frisk("*", "quarter"))
_add("share_vs_population", _snapshot(only_race=True))
_add("population_by_race", _W(O_POP) + """
, t AS (SELECT sum(white) AS white, sum(black) AS black, sum(asian) AS asian, sum(hispanic_or_latino) AS latino,
               sum(american_indian) + sum(unknown) AS other FROM o_pop)
SELECT 'White' AS race, CAST(white AS BIGINT) AS n_population FROM t
UNION ALL SELECT 'Black', CAST(black AS BIGINT) FROM t
UNION ALL SELECT 'Asian', CAST(asian AS BIGINT) FROM t
UNION ALL SELECT 'Latino', CAST(latino AS BIGINT) FROM t
UNION ALL SELECT 'All Other Races', CAST(other AS BIGINT) FROM t""")
_add("dim_population", _W(O_POP) + " SELECT * FROM o_pop")
_add("dim_rollup", _W(O_POP, O_DIVMAP) + """
SELECT m.division, CAST(sum(p.total) AS BIGINT) AS total, CAST(sum(p.white) AS BIGINT) AS white
FROM o_pop p LEFT JOIN o_divmap m ON p.district = m.district GROUP BY m.division""")
_add("rate_by_whiteness", _whiteness("n_intruded", "1997-Q1", "1999-Q4"))
_add("parse_quarter", W() + """
SELECT DISTINCT quarter,
  CAST(make_date(CAST(substr(quarter, 1, 4) AS INTEGER), CAST(substr(quarter, 7, 1) AS INTEGER) * 3 - 2, 1) AS VARCHAR) AS start,
  CAST(CAST(make_date(CAST(substr(quarter, 1, 4) AS INTEGER), CAST(substr(quarter, 7, 1) AS INTEGER) * 3 - 2, 1)
       + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS last_day
FROM o_cube""")
_spine_vals = ", ".join(f"('{q}', {q[:4]}, '{q[5:]}')" for q in SPINE)
_add("quarter_spine", W() + f"""
, sp AS (SELECT * FROM (VALUES {_spine_vals}) t(quarter, year, q_str)),
  g AS (SELECT quarter, sum(n_stopped) AS v FROM o_cube WHERE districtoccur = '07' AND psa = '1' GROUP BY quarter)
SELECT sp.quarter, CAST(sp.year AS INTEGER) AS year, sp.q_str, CAST(coalesce(g.v, 0) AS BIGINT) AS n_stopped
FROM sp LEFT JOIN g ON sp.quarter = g.quarter""")
_starts = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SEASON_START.items())
_ends = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SEASON_END.items())
_add("season_label", W() + f"""
SELECT DISTINCT quarter, {season()} AS season, CASE q_str {_starts} END AS start_month,
  CASE q_str {_ends} END AS end_month FROM o_cube""")
_pfq = ("CAST(year(date_trunc('quarter', last_dt) - INTERVAL 3 MONTH) AS VARCHAR) || '-Q' || "
        "CAST(quarter(date_trunc('quarter', last_dt) - INTERVAL 3 MONTH) AS VARCHAR)")
_add("latest_full_quarter", f"""
WITH t AS (SELECT 'orders' AS "table", max(o_orderdate) AS last_dt FROM orders
           UNION ALL SELECT 'lineitem', max(l_shipdate) FROM lineitem),
  q AS (SELECT "table", CAST(CAST(last_dt AS DATE) AS VARCHAR) AS last_dt, {_pfq} AS quarter FROM t)
SELECT * FROM q
UNION ALL SELECT '*', CAST(NULL AS VARCHAR), CASE WHEN count(DISTINCT quarter) = 1 THEN min(quarter) END FROM q""")
_add("before_after", W() + f"""
, g AS (SELECT districtoccur, CAST(sum(CASE WHEN {qin(*AN['before'])} THEN n_stopped END) AS BIGINT) AS n_before,
          CAST(sum(CASE WHEN {qin(*AN['after'])} THEN n_stopped END) AS BIGINT) AS n_after
        FROM o_cube GROUP BY districtoccur)
SELECT *, {r1(ratio('100.0 * (n_after - n_before)', 'n_before'))} AS pct_change FROM g""")
_add("kpi_rows", _time_slice("1997-Q1", "1997-Q4", "EUROPE"))
_W_ROWS = _whiteness("n_frisked", SPINE[0], SPINE[-1])
_add("chart_rows", f"""
SELECT 'whiteness' AS figure, 'data' AS kind, districtoccur AS district, CAST(n_frisked AS DOUBLE) AS y,
  CAST(intrusion_rate AS VARCHAR) AS annotation FROM ({_W_ROWS})
UNION ALL SELECT 'whiteness', 'trendline', districtoccur, fit_n_frisked, NULL FROM ({_W_ROWS})""")
_add("geojson_points", _hin_points() + """
SELECT 'Feature' AS type, vec_id, stname IS NOT NULL AS on_hin, stname,
  CASE WHEN stname IS NOT NULL THEN 'Traffic stop on the HIN' ELSE 'Traffic stop not on the HIN' END AS hover_text,
  'Point' AS geometry, lng, lat FROM o_j""")
_YEARLY = "\nUNION ALL\n".join(
    f"""SELECT * FROM (SELECT vec_id, x, y, {y} AS year FROM o_pts WHERE vec_id % 3 = {y - 2020} AND y < {C.LOCATABLE_MAX_Y}
ORDER BY md5('42|' || vec_id || '|' || vec_id || '|{y}-05-01 00:00:00|P' || vec_id) LIMIT {n})""" for y, n in ((2021, 60), (2022, 40)))
_REPORT_SAMPLE = f"""WITH {PTS}, o_yearly AS ({_YEARLY}),
  o_segs AS (SELECT * FROM {_segs_values()}),
  o_rows AS (SELECT p.y AS lat, p.x AS lng, CAST(p.year AS INTEGER) AS year, s.name IS NOT NULL AS on_hin,
               CAST(p.vec_id AS VARCHAR) AS stops_objectid, 'P' || p.vec_id AS location, s.name AS stname
             FROM o_yearly p LEFT JOIN o_segs s ON {_dist('p.x', 'p.y')} <= {A.SEGMENT_DISTANCE!r})
"""
_add("hin_report_points", _REPORT_SAMPLE + """SELECT *,
  CASE WHEN on_hin THEN 'Traffic stop on the HIN' ELSE 'Traffic stop not on the HIN' END AS hover_text FROM o_rows""")
_add("hin_report_extent", _REPORT_SAMPLE + """SELECT quantile_cont(lat, 0.5) AS median_lat, quantile_cont(lng, 0.5) AS median_lng,
  count(*) AS n_rows, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years FROM o_rows""")
_add("point_in_polygon_cover", ORACLES["point_in_polygon"])
_add("geojson_polygons", ORACLES["point_in_polygon"])
_add("geojson_lines", ORACLES["points_near_lines"])
_add("archive_summaries", f"""
WITH t AS (SELECT max(o_orderdate) AS last_dt FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT 'car_ped_stops' AS "table", CAST(CAST(last_dt AS DATE) AS VARCHAR) AS last_dt, {_pfq} AS quarter FROM t""")
_add("baseline_label", "\nUNION ALL\n".join(
    f"SELECT * FROM ({_baseline('gender', 'Female', q, q, location=loc_, label_only=True)})"
    for loc_, q in BASELINE_SLICES))

SCAN_OVERRIDE = _W(B.A_PERSONS) + """
SELECT source_year, stoptype, count(*) AS n_people FROM a_persons
WHERE NOT (source_year = 1997 AND stoptype <> 'vehicle')
GROUP BY source_year, stoptype"""
