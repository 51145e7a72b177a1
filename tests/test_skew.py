"""Hot keys: a third of all rows in one stop / one grid cell."""
import datetime as dt

from pyspark.sql import functions as F

from cubewright.operators import collapse as CO
from cubewright.operators import spatial as SP
from cubewright.sources import analog as A
from helpers import ORDER, STOP_KEY, frame, person


def test_hot_stop_key_partial_aggregation(spark):
    rows = [person(i, location="HOT" if i % 3 == 0 else f"L{i}", age=float(20 + i % 40))
            for i in range(3000)]
    df = frame(spark, rows).repartition(8)
    s = CO.collapse_stops(df, ORDER, STOP_KEY)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan          # combined map-side before the shuffle
    got = {r["location"]: r["n_people_in_car"] for r in s.collect()}
    assert got["HOT"] == 1000 and len(got) == 2001
    hot = s.where(F.col("location") == "HOT").collect()[0]
    assert hot["driver"]["age"] == 20.0      # first row (row 0) of the hot stop


def test_hot_grid_cell_points_not_shuffled(spark):
    rows = [(i, -0.1, -0.1) if i % 3 == 0 else (i, (i % 70) / 100 - 0.35, (i % 53) / 100 - 0.3)
            for i in range(3000)]
    pts = spark.createDataFrame(rows, "vec_id long, x double, y double").repartition(8)
    edges = SP.polygon_edges(A.polygons(spark))
    r = SP.point_in_polygon(pts, edges, default="-1")
    got = {x["vec_id"]: x["polygon_label"] for x in r.collect()}
    assert all(got[i] == "091" for i in range(0, 3000, 3))
    plan = r._jdf.queryExecution().executedPlan().toString()
    # the only exchange below the join is the tiny band table's aggregation
    assert "BroadcastHashJoin" in plan


def test_hot_shootings_district(spark):
    from cubewright.operators import cube as CU
    ts = dt.datetime(2022, 5, 1, 12)
    rows = [(ts, "9" if i % 3 == 0 else str(i % 20), 0.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "date_ timestamp, dist string, inside double").repartition(8)
    got = {r["districtoccur"]: r["n_shootings"] for r in CU.shootings_cube(df, "2022-Q4").collect()}
    assert sum(got.values()) == 3000 and got["09"] >= 1000


def test_bucketed_persons_need_no_shuffle_for_stops(spark):
    rows = [person(i, location=f"L{i % 50}", age=float(20 + i % 40)) for i in range(500)]
    name = "persons_bucketed_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (frame(spark, rows).write.bucketBy(4, "datetimeoccur", "location").sortBy("datetimeoccur", "location")
     .mode("overwrite").saveAsTable(name))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        s = CO.collapse_stops(spark.table(name), ORDER, STOP_KEY)
        plan = s._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert s.count() == 50
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql(f"DROP TABLE IF EXISTS {name}")
