"""Tiny person frames with the domain schema (FIXTURES.md §1-2)."""
import datetime as dt

from pyspark.sql import types as T

PERSON_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("row", T.LongType()),
    T.StructField("datetimeoccur", T.TimestampType()),
    T.StructField("location", T.StringType()),
    T.StructField("stoptype", T.StringType()),
    T.StructField("districtoccur", T.StringType()),
    T.StructField("psa", T.StringType()),
    T.StructField("race", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("individual_searched", T.DoubleType()),
    T.StructField("vehicle_searched", T.DoubleType()),
    T.StructField("individual_frisked", T.DoubleType()),
    T.StructField("vehicle_frisked", T.DoubleType()),
    T.StructField("individual_arrested", T.DoubleType()),
    T.StructField("individual_contraband", T.DoubleType()),
    T.StructField("vehicle_contraband", T.DoubleType()),
    T.StructField("mvc_code", T.StringType()),
    T.StructField("point_x", T.DoubleType()),
    T.StructField("point_y", T.DoubleType()),
])

TS = dt.datetime(2022, 5, 1, 12, 0, 0)


def person(row, location="L1", ts=TS, stoptype="vehicle", district="12", psa="1",
           race="Black - Non-Latino", gender="Male", age=30.0, isearch=0.0, vsearch=0.0,
           ifrisk=0.0, vfrisk=0.0, arrest=0.0, icontra=0.0, vcontra=0.0, code="3111",
           x=None, y=None, file="f2022"):
    return (file, row, ts, location, stoptype, district, psa, race, gender, age, isearch, vsearch,
            ifrisk, vfrisk, arrest, icontra, vcontra, code, x, y)


def frame(spark, rows):
    return spark.createDataFrame(rows, PERSON_SCHEMA)


STOP_KEY = ("file", "datetimeoccur", "location")
ORDER = ["row"]
