"""Write PLANS.md: physical plans of the headline jobs with a shuffle count.

usage: python tools/plans.py [sf_dir]
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cubewright import config as C  # noqa: E402
from cubewright.operators import collapse as CO  # noqa: E402
from cubewright.operators import cube as CU  # noqa: E402
from cubewright.operators import spatial as SP  # noqa: E402
from cubewright.plans import build as BL  # noqa: E402
from cubewright.plans import queries_reports as QR  # noqa: E402
from cubewright.plans import reports as RP  # noqa: E402
from cubewright.session import get_spark, scratch_dir  # noqa: E402
from cubewright.sources import analog as A  # noqa: E402


def plan_text(df) -> str:
    df.write.format("noop").mode("overwrite").save()          # final (adaptive) plan
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summary(text: str) -> dict:
    return {
        "shuffles": len(re.findall(r"(?<!Broadcast)Exchange (?:hashpartitioning|rangepartitioning|"
                                   r"SinglePartition|RoundRobinPartitioning)", text)),
        "broadcasts": len(re.findall(r"BroadcastExchange", text)),
        "sort_merge_joins": text.count("SortMergeJoin"),
        "broadcast_joins": text.count("BroadcastHashJoin"),
    }


def scan_lines(fmt: str) -> list[str]:
    keep = []
    for line in fmt.splitlines():
        if line.startswith(("Location:", "PushedFilters:", "PartitionFilters:", "ReadSchema:")):
            keep.append(re.sub(r"\[file:[^\]]*\]", "[...]", line))
    return keep


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]")
    out = scratch_dir(spark, "plans")
    persons = A.persons(spark, sf)
    stops = CO.classify_stops(CO.collapse_stops(persons, A.PERSON_ORDER, cluster_keys=A.STOP_CLUSTER_KEYS))
    reason = CU.stop_cube_reason(stops, C.ANALOG["most_recent_quarter"])
    t = BL.write_build(BL.build_analog(spark, sf), f"{out}/cubes", C.ANALOG["most_recent_quarter"])
    ctx = RP.ReportCtx({"cube": t["stop_cube"], "reason_cube": t["stop_cube_reason"],
                        "hin_cube": t["hin_cube"], "shootings_cube": t["shootings_cube"],
                        "population": t["population"]}, A.division_map(spark, sf), QR.SPINE)
    (ms, me), = C.ANALOG["map_windows"]
    edges = SP.polygon_edges(A.polygons(spark))
    # the real-file layout: yearly person CSVs (derived from the tables at sf0.01)
    from cubewright.plans import queries_sources as QS
    from cubewright.sources import files as FS
    csv_path, schema = QS._persons_text(spark, sf.replace("sf0.1", "sf0.01"), f"{out}/csv")
    csv_persons = FS.scan_typed(spark, f"{csv_path}/*/*.csv", schema)
    csv_reason = CU.stop_cube_reason(
        CO.classify_stops(CO.collapse_stops(csv_persons, ["_ordinal"], ("_file", "datetimeoccur", "location"))),
        C.ANALOG["most_recent_quarter"])
    csv_persons.write.parquet(f"{out}/csv_persons")
    # persons as the build stages them
    persons.write.parquet(f"{out}/persons")
    stored = spark.read.parquet(f"{out}/persons")
    from cubewright.operators.remap import remap_districts
    jobs = {
        "build: persons -> stops -> reason cube": reason,
        "build (real layout): person CSVs -> stops -> reason cube": csv_reason,
        "build: hin cube (derived flags)": CU.hin_cube(A.persons_on_network(spark, sf), C.ANALOG["most_recent_quarter"]),
        "stored persons: derived flags -> hin cube": CU.hin_cube(SP.network_flags(
            stored, A.segments(spark), A.SEGMENT_DISTANCE, A.NETWORK_MAX_Y), C.ANALOG["most_recent_quarter"]),
        "stored persons: district remap": remap_districts(stored, edges).groupBy("districtoccur", "psa").count(),
        "stored persons: stops by codes": CO.coded_stops(
            spark.read.parquet(f"{out}/csv_persons"), CO.find_codes(spark.read.parquet(f"{out}/csv_persons")), ("_file", "datetimeoccur", "location")),
        "report r_reason_by_race (written cube)": RP.r_reason_by_race(ctx, C.ANALOG["report_year"]),
        "report r_snapshot (written cube)": RP.r_snapshot(ctx, 4, C.ANALOG["before"], C.ANALOG["after"]),
        "report r_surge_map (written cubes)": RP.r_window_map(ctx, ms, me, "n_shootings", "n_stopped"),
        "point_in_polygon": SP.point_in_polygon(A.points(spark, sf), edges, default="-1"),
        "points_near_lines (all)": SP.points_near_lines(A.points(spark, sf), A.segments(spark),
                                                       A.SEGMENT_DISTANCE, mode="all"),
    }
    lines = ["# Physical plans of the headline jobs", "",
             f"Generated by `tools/plans.py` on `{sf}` (local[8], AQE on). Counts are taken from the",
             "final adaptive plan; the scan lines from `explain('formatted')`.", "",
             "| job | shuffles | broadcasts | sort-merge joins | broadcast joins |", "|---|---|---|---|---|"]
    details = []
    for name, df in jobs.items():
        txt = plan_text(df)
        s = summary(txt)
        lines.append(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['sort_merge_joins']} | "
                     f"{s['broadcast_joins']} |")
        fmt = formatted(df)
        tree = fmt.split("\n\n")[0]
        details += [f"## {name}", "", "```", tree, "", *scan_lines(fmt), "```", ""]
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") \
        .write("\n".join(lines + [""] + details))
    spark.stop()


if __name__ == "__main__":
    main()
