"""Driver contract: entry() smoke check and every query against its oracle
(DuckDB over the same parquet tables) at sf0.001."""
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as E

SF = os.environ.get("CUBEWRIGHT_TEST_SF", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(cols, rows):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in idx) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["series", "x", "x_label", "value"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_only_training_data_queries_lack_an_oracle():
    """Those are tested against brute force, beside their code."""
    rest = set(E.queries()) - set(E.oracle_sql())
    assert all(re.fullmatch(r"op\d+_\w+|pipeline", k) for k in rest)


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, key):
    sql = E.oracle_sql().get(key)
    df = E.queries()[key](spark, SF)
    cols = df.columns
    srows = rows_of(cols, [tuple(r) for r in df.collect()])
    rel = duck.execute(sql)
    ocols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(ocols)
    assert srows == rows_of(ocols, rel.fetchall())
    # same column types as the oracle (Spark type -> DuckDB type name)
    types = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
             "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "DateType()": "DATE"}
    got = {f.name: types.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    want = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert got == want


@pytest.mark.parametrize("key", ["stop_cube_reason", "r_most_frequent", "r_surge_map", "r_baseline",
                                 "point_in_polygon", "sample_n", "row_ordinal"])
def test_result_independent_of_partition_count(spark, key):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            df = E.queries()[key](spark, SF)
            return rows_of(df.columns, [tuple(r) for r in df.collect()])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert run(1) == run(13)
