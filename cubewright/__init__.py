"""cubewright: quarterly incident cubes and comparison reports on Spark.

Main entry points::

    from cubewright import build, reports, get_spark
    tables = build.build_from_files(spark, csv_root, out, psa_map=...)   # or build_from_archive
    ctx = reports.ReportCtx({...cubes...}, divisions, spine)
    rows = reports.r_num_stops(ctx, location="22*", grain="quarter", eras=[...])
"""

__version__ = "0.1.0"

from .plans import build, reports  # noqa: E402,F401
from .session import get_spark  # noqa: E402,F401

__all__ = ["build", "reports", "get_spark", "__version__"]
