"""Command line: run the batch build or a report on a cluster.

    spark-submit --py-files cubewright.zip run_job.py build  --csv-root R --out O [--psa-map M]
                 [--quarter 2024-Q3] [--hin-lines L --sample-year 2023]
    spark-submit --py-files cubewright.zip run_job.py report --tables O --population P --name r_num_stops --out J
    spark-submit --py-files cubewright.zip run_job.py analog --sf-dir D --out O

The session comes from the launcher; only its settings are read.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .. import config as C
from ..sources import files as FS
from ..sources import sinks as SK
from . import build as BL
from . import reports as RP


def _report_ctx(spark, tables: str, population: str, first: str, geographies: str | None = None) -> RP.ReportCtx:
    counts = list(RP.POP_COUNTS)
    if geographies is not None:             # a population row per PSA
        geo = FS.scan_dim_csv(spark, geographies, ["full_psa_num", "district", "division"])
        pop = RP.population_rollup(FS.scan_dim_csv(spark, population, ["PSA_NUM"], counts), geo)
    elif population.endswith(".csv"):
        pop = FS.scan_dim_csv(spark, population, ["district"], counts)
    else:                                   # a written population table
        pop = spark.read.parquet(population).select("district", *counts)
    return RP.ReportCtx.from_tables(spark, tables, population=pop, first_quarter=first, strict=True)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="cubewright")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build")
    src = b.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv-root", help="folder of <table>/<table>_year_<YYYY>.csv + summary.json")
    src.add_argument("--archive", help="zip backup of csvs/<table>/... members")
    b.add_argument("--out", required=True)
    b.add_argument("--psa-map")
    b.add_argument("--quarter")
    b.add_argument("--override", action="append", default=[],
                   help="base_name=path (a file, or another zip for --archive)")
    b.add_argument("--hin-lines", help="GeoJSON of the high-injury network lines")
    b.add_argument("--sample-year", type=int, help="year of the network sample table")
    b.add_argument("--seed-total", help="YEAR=N: stops known before the year; another total fails the build")
    r = sub.add_parser("report")
    r.add_argument("--tables", required=True)
    r.add_argument("--population", required=True,
                   help="district population: CSV (district,total,white,...) or a written table")
    r.add_argument("--geographies", help="CSV full_psa_num,district,division; the population CSV then has a "
                                         "row per PSA_NUM")
    r.add_argument("--name", required=True)
    r.add_argument("--params", default="{}", help="JSON keyword arguments")
    r.add_argument("--first-quarter", default=C.FIRST_QUARTER)
    r.add_argument("--out", required=True)
    a = sub.add_parser("analog")
    a.add_argument("--sf-dir", required=True)
    a.add_argument("--out", required=True)
    args = ap.parse_args(argv)

    spark = SparkSession.builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if args.cmd == "build":
        overrides = dict(o.split("=", 1) for o in args.override)
        seed = tuple(int(x) for x in args.seed_total.split("=")) if args.seed_total else None
        build = BL.build_from_archive if args.archive else BL.build_from_files
        build(spark, args.archive or args.csv_root, args.out, psa_map=args.psa_map,
              most_recent_quarter=args.quarter, overrides=overrides,
              hin_lines=args.hin_lines, sample_year=args.sample_year, seed_total=seed)
    elif args.cmd == "analog":
        BL.write_build(BL.build_analog(spark, args.sf_dir), args.out, C.ANALOG["most_recent_quarter"])
    else:
        ctx = _report_ctx(spark, args.tables, args.population, args.first_quarter, args.geographies)
        fn = getattr(RP, args.name)
        SK.export_report({args.name: fn(ctx, **json.loads(args.params))}, args.out)


if __name__ == "__main__":
    main()
