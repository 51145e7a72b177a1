"""The test tables read as incident data (the "analog", FIXTURES.md §3-4).

persons   = lineitem ⋈ part ⋈ (orders ⋈ customer ⋈ nation ⋈ region) (+ code list)
shootings = urgent orders ⋈ customer
population= customers per nation
points    = first two embedding dimensions
polygons / segments = small fixed shapes (a map, not data)

Join plan: the big sides (lineitem, orders, customer, part) are joined on
their keys and left to the planner (sort-merge or, when AQE sees a small
side at run time, broadcast); lineitem joins part first and the order side
last, so the person rows come out partitioned and sorted by order key.
Only the fixed-size dimensions (nation, region, the shapes) are broadcast
explicitly; the 25-entry brand -> code list is a CASE expression, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES of the analog (FIXTURES.md §3-4)
# ---------------------------------------------------------------------------

# p_brand -> violation code
BRAND_CODES = [
    ("Brand#1", "1332-(a)"),
    ("Brand#2", "1332-a-i"),
    ("Brand#3", "1332-A-I"),
    ("Brand#4", "3111"),
    ("Brand#5", "3111-(a)"),
    ("Brand#6", "3111-b"),
    ("Brand#7", "3301"),
    ("Brand#8", "3311-a"),
    ("Brand#9", "3331-b"),
    ("Brand#10", "3334-(b)"),
    ("Brand#11", "4703-a"),
    ("Brand#12", "4706-c-5"),
    ("Brand#13", "4303"),
    ("Brand#14", "4306"),
    ("Brand#15", "4306-a"),
    ("Brand#16", "3112-a-3"),
    ("Brand#17", "3323-b"),
    ("Brand#18", "1301-(a)"),
    ("Brand#19", "3362-a"),
    ("Brand#20", "3714"),
    ("Brand#21", "4524-e-1"),
    ("Brand#22", "4524-(a)"),
    ("Brand#23", None),
    ("Brand#24", ""),
    ("Brand#25", "9999"),
]

# (race index) -> raw race label, index = (c_custkey + l_partkey) % 8
RAW_RACES = ["Black - Non-Latino", "White - Non-Latino", "Black - Latino", "White - Latino",
             "Asian", "American Indian", "Unknown", "Not Listed"]

# polygon rings (label, closed ring of (x, y)); feature order = list order
POLYGONS = [
    ("091", [(-0.2, -0.2), (0.0, -0.2), (0.0, 0.0), (-0.2, 0.0), (-0.2, -0.2)]),
    ("092", [(0.0, 0.0), (0.25, 0.0), (0.0, 0.25), (0.0, 0.0)]),
    ("093", [(0.0, -0.25), (0.2, -0.25), (0.2, -0.05), (0.1, -0.05), (0.1, -0.15),
             (0.0, -0.15), (0.0, -0.25)]),
    ("221", [(-0.3, 0.05), (-0.05, 0.05), (-0.05, 0.3), (-0.3, 0.3), (-0.3, 0.05)]),
]

# line segments (name, x1, y1, x2, y2)
SEGMENTS = [
    ("A", -0.3, -0.3, 0.3, 0.3),
    ("B", -0.3, 0.0, 0.3, 0.0),
    ("C", 0.0, -0.3, 0.0, 0.3),
    ("D", 0.1, 0.1, 0.1, 0.1),
]
SEGMENT_DISTANCE = 0.02
NETWORK_MAX_Y = 0.3     # the guard of locatable points, in the test points' units

# ---------------------------------------------------------------------------


_READS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table.  The test tables are immutable, so a session reuses the
    DataFrame of a path instead of listing and reading its footer again."""
    key = (id(spark), f"{sf_dir}/{name}.parquet")
    df = _READS.get(key)
    if df is None or df.sparkSession is not spark:
        df = _READS[key] = spark.read.parquet(key[1])
    return df


def _entry(labels: list[str | None], no: Column) -> Column:
    return F.get(F.array(*[F.lit(x).cast("string") for x in labels]), no)


# ``marks`` of a person's sources: bits 0 to 2 are tests of the line's tax,
# discount and status, bits 3 to 5 the place in RAW_RACES, the bits from 6 on the
# place in _CODES
_CODES = [None, *[code for _, code in BRAND_CODES]]


def _line_marks() -> Column:
    tests = [F.col("l_tax") >= 0.08, F.col("l_discount") >= 0.09, F.col("l_linestatus") == "F"]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def _code_marks(brand_col: str = "p_brand") -> Column:
    """The fixed brand -> code list as one CASE expression (no join)."""
    from ..functions.rules import lookup_of
    return lookup_of(brand_col, [(b, str(i << 6)) for i, (b, _) in enumerate(BRAND_CODES, 1)], default="0").cast("int")


def _race_marks(idx: Column) -> Column:
    """Another index than those of the first races, or none, is the last race's."""
    last = len(RAW_RACES) - 1
    return F.when(idx.between(0, last - 1), idx).otherwise(last).cast("int") * 8


def order_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation ⋈ region: one row per order with its place."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nr = F.broadcast(
        table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        .join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"),
              F.col("n_regionkey") == F.col("r_regionkey")))
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(nr, F.col("c_nationkey") == F.col("n_nationkey"))
             .select("o_orderkey", "o_orderdate", "c_custkey", "c_nationkey",
                     F.col("r_name").alias("division")))


def person_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person row is made of, one row per person: half the columns, so
    joins and writers deal and sort these and make the person rows
    (``as_persons``) afterwards.  What has few values is one number, ``marks``;
    an order's columns stand together, as do those whose numbers are short, so
    that the rows pack well."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_linenumber", _line_marks().alias("line_marks"), "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice")
    codes = table(spark, sf_dir, "part").select("p_partkey", _code_marks("p_brand").alias("code_marks"))
    coded = (li.join(codes, li.l_partkey == codes.p_partkey)
               .select("l_orderkey", "l_shipdate", "l_linenumber", (F.col("line_marks") + F.col("code_marks")).alias("coded_marks"),
                       "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    places = order_places(spark, sf_dir)
    j = coded.join(places, coded.l_orderkey == places.o_orderkey)
    return j.select(
        # the raw order key: the join output is partitioned by it, and a stop
        # (one order date + one location) never spans two orders
        "l_orderkey",
        F.year("o_orderdate").cast("long").alias("source_year"),
        F.col("o_orderdate").alias("datetimeoccur"),
        F.when(F.col("l_orderkey") % 97 == 0, F.lit(None).cast("long"))
         .otherwise(F.col("l_orderkey")).alias("location"),
        "c_nationkey", "division", "l_shipdate", "l_linenumber",
        (F.col("coded_marks") + _race_marks((F.col("c_custkey") + F.col("l_partkey")) % 8)).alias("marks"),
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )


def as_persons(sources: DataFrame, *more: str) -> DataFrame:
    """The person rows of ``person_sources``, with ``more`` of its columns."""
    q = F.col("l_quantity")
    sk = F.col("l_suppkey")
    marks = F.col("marks")
    return sources.select(
        "l_orderkey", "source_year",
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        "datetimeoccur", "location",
        F.when(F.col("l_linenumber") <= 6, F.lit("vehicle")).otherwise(F.lit("pedestrian"))
         .alias("stoptype"),
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("districtoccur"),
        "division",
        F.when(sk % 11 == 0, F.lit(None).cast("string"))
         .otherwise((sk % 4).cast("string")).alias("psa"),
        _entry(RAW_RACES, F.shiftright(marks, 3).bitwiseAND(7)).alias("race"),
        F.when(sk % 9 <= 4, F.lit("Male")).when(sk % 9 <= 7, F.lit("Female"))
         .alias("gender"),
        F.when(q == 50, F.lit(None).cast("double")).otherwise(q + 17).alias("age"),
        F.when(q > 45, 1.0).otherwise(0.0).alias("individual_searched"),
        F.when(marks.bitwiseAND(1) > 0, 1.0).otherwise(0.0).alias("vehicle_searched"),
        F.when(marks.bitwiseAND(2) > 0, 1.0).otherwise(0.0).alias("individual_frisked"),
        F.lit(None).cast("double").alias("vehicle_frisked"),
        F.when(q == 1, 1.0).otherwise(0.0).alias("individual_arrested"),
        F.when((marks.bitwiseAND(4) > 0) & (q > 42), 1.0).otherwise(0.0)
         .alias("individual_contraband"),
        F.lit(None).cast("double").alias("vehicle_contraband"),
        _entry(_CODES, F.shiftright(marks, 6)).alias("mvc_code"),
        # flags as a flagged file brings them; persons_on_network derives them
        F.when(sk % 7 != 0, 1).otherwise(0).alias("n_stopped_locatable"),
        F.when((sk % 7 != 0) & (F.col("l_partkey") % 3 == 0), 1).otherwise(0)
         .alias("n_stopped_locatable_on_hin"),
        # a planar position per person, for the district/PSA re-derivation
        (((F.col("l_partkey") * 7 + sk) % 800 - 400) / 1000.0).alias("point_x"),
        (((F.col("l_orderkey") * 13 + F.col("l_linenumber")) % 800 - 400) / 1000.0)
         .alias("point_y"),
        *more,
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per person involved in an incident (FIXTURES ``a_persons``)."""
    return as_persons(person_sources(spark, sf_dir))


PERSON_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
# grouping column by which the person rows are hash-partitioned and sorted
# after the order join; once rows without a location are dropped it alone
# identifies a stop (location = order key, date and year come from the order)
STOP_CLUSTER_KEYS = ["l_orderkey"]


def shootings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = (table(spark, sf_dir, "orders")
         .where(F.col("o_orderpriority") == "1-URGENT")
         .select("o_custkey", "o_orderdate", "o_orderstatus"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderdate").alias("date_"),
        F.col("c_nationkey").cast("string").alias("dist"),
        F.when(F.col("o_orderstatus") == "O", 0.0).when(F.col("o_orderstatus") == "F", 1.0)
         .alias("inside"),
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population per district (customers per nation, split by a rule)."""
    c = table(spark, sf_dir, "customer")
    white_cut = (F.col("c_custkey") % 100) < 4 * F.col("c_nationkey")
    seg = F.col("c_mktsegment")

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return (c.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("total"),
        n(white_cut).alias("white"),
        n(~white_cut & seg.isin("BUILDING", "AUTOMOBILE")).alias("black"),
        n(~white_cut & (seg == "FURNITURE")).alias("asian"),
        n(~white_cut & (seg == "HOUSEHOLD")).alias("hispanic_or_latino"),
        n(~white_cut & (seg == "MACHINERY")).alias("american_indian"),
    ).select(F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("district"),
             "total", "white", "black", "asian", "hispanic_or_latino", "american_indian",
             F.lit(0).cast("long").alias("unknown")))


def division_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(division, district): region name -> its nations, plus one shared district."""
    from ..config import ANALOG
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    base = (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("r_name").alias("division"),
                     F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("district")))
    shared_district, extra_division = ANALOG["shared_district"]
    extra = (r.where(F.col("r_name") == extra_division)
              .select(F.col("r_name").alias("division"),
                      F.lit(shared_district).alias("district")))
    return base.unionByName(extra).distinct()


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id",
                    F.col("embedding")[0].cast("double").alias("x"),
                    F.col("embedding")[1].cast("double").alias("y"),
                    "label")


def polygons(spark: SparkSession) -> DataFrame:
    """(pos, label, rings) in feature order; one closed ring per polygon."""
    rows = [(i, lab, [[[float(x), float(y)] for x, y in ring]])
            for i, (lab, ring) in enumerate(POLYGONS)]
    schema = "pos int, label string, rings array<array<array<double>>>"
    return spark.createDataFrame(rows, schema)


def segments(spark: SparkSession) -> DataFrame:
    schema = "name string, x1 double, y1 double, x2 double, y2 double"
    return spark.createDataFrame([tuple(s) for s in SEGMENTS], schema)


def persons_on_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person rows with the two network flags derived from their points."""
    from ..operators.spatial import network_flags
    return network_flags(persons(spark, sf_dir), segments(spark), SEGMENT_DISTANCE, NETWORK_MAX_Y)
