"""The analog view reproduces the figures FIXTURES.md publishes for sf0.01."""
import os

import pytest
from pyspark.sql import functions as F

from cubewright.operators import spatial as SP
from cubewright.plans import reports as RP
from cubewright.sources import analog as A

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_person_figures(spark):
    p = A.persons(spark, SF)
    r = p.agg(F.count("*"), F.count("location"), F.count("psa"), F.count("gender"), F.count("age"),
              F.count("mvc_code"), F.sum("individual_searched"), F.sum("individual_frisked"),
              F.sum("individual_contraband"), F.sum("n_stopped_locatable"),
              F.sum("n_stopped_locatable_on_hin")).collect()[0]
    assert list(r) == [60000, 59414, 54025, 53337, 58825, 57775, 5967, 8839, 4786, 50784, 17196]


def test_shooting_population_figures(spark):
    s = A.shootings(spark, SF)
    assert (s.count(), s.where("inside is not null").count()) == (2978, 2002)
    pop = A.population(spark, SF)
    assert pop.agg(F.sum("total")).collect()[0][0] == 1500
    assert RP.majority_split(pop).where("majority_district = 'Majority white'").count() == 12


def test_spatial_figures(spark):
    pts = A.points(spark, SF)
    pip = SP.point_in_polygon(pts, SP.polygon_edges(A.polygons(spark)))
    got = {r[0]: r[1] for r in pip.groupBy("polygon_label").count().collect() if r[0]}
    assert got == {"091": 102, "092": 79, "093": 43, "221": 52}
    near = SP.points_near_lines(pts, A.segments(spark), A.SEGMENT_DISTANCE, mode="all")
    got = {r[0]: r[1] for r in near.groupBy("line_name").count().collect() if r[0]}
    assert got == {"A": 68, "B": 63, "C": 59, "D": 5}


def test_collapse_check_figures(spark):
    from cubewright.functions import timeq as TQ
    from cubewright.operators import collapse as CO
    s = CO.collapse_stops(A.persons(spark, SF), A.PERSON_ORDER, cluster_keys=A.STOP_CLUSTER_KEYS,
                          key_determined=True)
    s = (s.withColumn("local_ts", TQ.to_local(F.col("datetimeoccur")))
          .withColumn("quarter", TQ.quarter_label(F.col("local_ts"))))
    s = CO.before_quarter_end(s, "2000-Q4").select(
        "quarter", "districtoccur", "psa", "mvc_code_max", "n_people_in_car", "was_searched", "was_frisked",
        F.col("driver.race").alias("race"), F.col("driver.gender").alias("gender"))
    d = s.na.drop(subset=["districtoccur", "psa", "race", "gender"])
    keys = ["quarter", "districtoccur", "psa", "race", "gender", "mvc_code_max"]
    assert d.groupBy(*keys).count().count() == 11258
    r = d.agg(F.count("*"), F.sum("n_people_in_car"), F.sum("was_searched"), F.sum("was_frisked")).collect()[0]
    assert list(r) == [11500, 41223, 5007, 4714]
    assert d.where(F.col("quarter") == "1994-Q4").count() == 1
