"""Declared input schemas of the person, person-on-network and shooting
files (FIXTURES.md §1).  Flags stored as 0/1 are doubles because they are
nullable."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _schema(cols) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols])


PERSON_COLUMNS = [
    ("cartodb_id", _L), ("the_geom", _S), ("the_geom_webmercator", _S), ("objectid", _I),
    ("id", _I), ("weekday", _S), ("location", _S), ("districtoccur", _S), ("psa", _S),
    ("stopcode", _I), ("stoptype", _S), ("inside_or_outside", _S), ("gender", _S), ("race", _S),
    ("age", _D), ("individual_frisked", _D), ("individual_searched", _D),
    ("individual_arrested", _D), ("individual_contraband", _D), ("vehicle_frisked", _D),
    ("vehicle_searched", _D), ("vehicle_contraband", _D), ("vehicle_contraband_list", _S),
    ("individual_contraband_list", _S), ("mvc_code", _S), ("mvc_reason", _S),
    ("mvc_code_sec", _S), ("mvc_code_sec_reason", _S), ("point_x", _D), ("point_y", _D),
    ("datetimeoccur", _TS),
]
PERSONS = _schema(PERSON_COLUMNS)
PERSONS_ON_HIN = _schema(PERSON_COLUMNS + [("n_stopped_locatable_on_hin", _I),
                                           ("n_stopped_locatable", _I)])
SHOOTINGS = _schema([
    ("cartodb_id", _L), ("the_geom", _S), ("the_geom_webmercator", _S), ("objectid", _D),
    ("year", _D), ("dc_key", _S), ("code", _S), ("date_", _TS), ("time", _S), ("race", _S),
    ("sex", _S), ("age", _S), ("wound", _S), ("officer_involved", _S), ("offender_injured", _S),
    ("offender_deceased", _S), ("location", _S), ("latino", _D), ("point_x", _D), ("point_y", _D),
    ("dist", _S), ("inside", _D), ("outside", _D), ("fatal", _D),
])

# table name -> (schema, timestamp column, district column, psa column)
TABLES = {
    "car_ped_stops": (PERSONS, "datetimeoccur", "districtoccur", "psa"),
    "car_ped_stops_on_hin": (PERSONS_ON_HIN, "datetimeoccur", "districtoccur", "psa"),
    "shootings": (SHOOTINGS, "date_", "dist", None),
}
