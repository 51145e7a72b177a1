"""The JVM-side WKB point decoder against struct.unpack on many values."""
import random
import struct

from cubewright.functions.wkb import wkb_point, with_point


def ewkb(x, y, srid=None, little=True, typ=1):
    e = "<" if little else ">"
    if srid is None:
        b = struct.pack(e + "BIdd", 1 if little else 0, typ, x, y)
    else:
        b = struct.pack(e + "BIIdd", 1 if little else 0, typ | 0x20000000, srid, x, y)
    return b.hex()


def test_decode_matches_struct_unpack(spark):
    rng = random.Random(5)
    vals = [0.0, -0.0, 1.0, -75.16, 39.95, 1e-300, -1e300, 5e-324, 2.2250738585072014e-308,
            0.1, 1 / 3, 123456789.123456789]
    vals += [rng.uniform(-180, 180) for _ in range(200)] + [rng.uniform(-1e-5, 1e-5) for _ in range(50)]
    rows, want = [], {}
    for i, x in enumerate(vals):
        y = vals[(i * 7 + 3) % len(vals)]
        variant = i % 4
        h = ewkb(x, y, srid=4326 if variant % 2 else None, little=variant < 2)
        if i % 5 == 0:
            h = h.upper()
        rows.append((i, h))
        want[i] = (x, y)
    df = spark.createDataFrame(rows, "id int, g string").select("id", wkb_point("g").alias("p"))
    got = {r["id"]: (r["p"]["x"], r["p"]["y"]) for r in df.collect()}
    assert got == want


def test_bad_values_are_null(spark):
    bad = [None, "zz", "0101", ewkb(1.0, 2.0, typ=2), ewkb(float("nan"), 1.0), ewkb(1.0, 2.0)[:-2]]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "id int, g string")
    got = [r["p"] for r in df.select("id", wkb_point("g").alias("p")).orderBy("id").collect()]
    assert got[0] is None and got[1] is None and got[2] is None and got[3] is None
    assert got[5] is None
    assert got[4] is None or got[4]["x"] is None


def test_with_point_on_spark(spark):
    df = spark.createDataFrame([(1, ewkb(-75.1, 39.9, 4326), None), (2, None, None),
                                (3, ewkb(-75.2, 40.0), 5.0)], "id int, the_geom string, point_x double")
    got = {r["id"]: (r["point_x"], r["point_y"]) for r in with_point(df).collect()}
    assert got == {1: (-75.1, 39.9), 2: (None, None), 3: (5.0, 40.0)}
    plan = with_point(df)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
