"""District merge and PSA re-derivation.

Districts 06 and 09 were merged into 09 (and the unpadded 6/9 into 9).  Rows
of the merged district get their PSA from the point-in-polygon lookup over
the new PSA map: the last character of the containing polygon's label, or
``'-1'`` when the point is in none; rows without a point get null.  Other
rows keep their district and PSA.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules as R
from .spatial import point_in_polygon


def remap_districts(persons: DataFrame, psa_edges: DataFrame, district_col: str = "districtoccur",
                    psa_col: str | None = "psa", x: str = "point_x", y: str = "point_y") -> DataFrame:
    merged = set(C.REMAP_DISTRICTS.values())
    df = persons.withColumn(district_col, R.remap_district(F.col(district_col)))
    if psa_col is None:
        return df
    needs = F.col(district_col).isin(sorted(merged))
    located = F.col(x).isNotNull() & F.col(y).isNotNull()
    df = point_in_polygon(df, psa_edges, x, y, out="_psa_num", only=needs & located)
    new_psa = F.when(located, F.coalesce(F.substring(F.col("_psa_num"), -1, 1), F.lit(C.UNKNOWN_PSA)))
    return (df.withColumn(psa_col, F.when(needs, new_psa).otherwise(F.col(psa_col)))
              .drop("_psa_num"))
