"""Vocabulary and fixed parameters shared by every job.

Everything under "FIXED VALUES" must equal the values of the system whose
results we reproduce; they are stated plainly, in their natural order.
The analog settings at the end describe how the TPC-H-ish test tables are
read as incident data (see FIXTURES.md).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced system exactly)
# ---------------------------------------------------------------------------

LOCAL_TZ = "America/New_York"

RACE_ORDER = ["Asian", "Black", "Latino", "White", "All Other Races"]
AGE_ORDER = ["Under 25", "25-34", "35-44", "45-54", "55-64", "65+"]
GENDER_ORDER = ["Male", "Female"]

# default baseline member per demographic category
BASELINE_DEFAULTS = {"age_range": "35-44", "gender": "Female", "race": "White"}

# raw race label -> model race; labels not listed pass through unchanged
RACE_RECODE = {
    "Black - Latino": "Latino",
    "White - Latino": "Latino",
    "White - Non-Latino": "White",
    "Black - Non-Latino": "Black",
    "Asian": "Asian",
    "American Indian": "All Other Races",
    "Unknown": "All Other Races",
}

# age bands: (exclusive upper bound, label); anything else (incl. null) is 65+
AGE_BANDS = [(25, "Under 25"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64")]
AGE_BAND_ELSE = "65+"

# division -> districts used by the location filter (district 25 is in two)
DIVISION_DISTRICTS = {
    "SPD": ["01", "03", "17"],
    "NEPD": ["02", "07", "08", "15", "25"],
    "NWPD": ["05", "14", "35", "39"],
    "CPD": ["06", "09", "22"],
    "SWPD": ["12", "16", "18", "19"],
    "EPD": ["24", "25", "26"],
}

# violation rules, first match wins. Each clause is a dict with any of:
# prefix, exact, contains, not_prefix, not_contains (all must hold).
VIOLATION_RULES = [
    ("Display License Plate", [
        {"prefix": "1332", "contains": "A", "not_prefix": "1332AI"},
    ]),
    ("Failure to Obey Traffic Sign/Light", [
        {"exact": "3111"},
        {"prefix": "3111", "contains": "A"},
    ]),
    ("Improper Pass, Lane, One Way", [
        {"prefix": "330"},
        {"prefix": "3311", "contains": "A"},
        {"prefix": "3313"},
        {"prefix": "3315"},
        {"prefix": "3703"},
    ]),
    ("Improper Turn/Signal", [
        {"prefix": "3331"},
        {"prefix": "3332"},
        {"prefix": "3334", "contains": "A"},
        {"prefix": "3334", "contains": "B"},
        {"prefix": "3335"},
        {"prefix": "3336"},
    ]),
    ("Inspection/Emission Sticker", [
        {"prefix": "4703"},
        {"prefix": "4706", "contains": "C"},
    ]),
    ("Lights", [
        {"prefix": "4301"},
        {"prefix": "4302"},
        {"prefix": "4303"},
        {"exact": "4306"},
    ]),
    ("Red Light/Stop Sign/Yield", [
        {"prefix": "3112"},
        {"prefix": "3321"},
        {"prefix": "3322"},
        {"prefix": "3323"},
        {"prefix": "3324"},
        {"prefix": "3325"},
        {"prefix": "3342", "contains": "A"},
        {"prefix": "3345", "contains": "A"},
        {"prefix": "3542"},
        {"prefix": "3710"},
    ]),
    ("Registration", [
        {"prefix": "1301", "contains": "A"},
    ]),
    ("Speeding/Reckless/Careless Driving", [
        {"prefix": "3361"},
        {"prefix": "3362"},
        {"prefix": "3363"},
        {"prefix": "3365"},
        {"prefix": "3367"},
        {"prefix": "3714"},
        {"prefix": "3736"},
    ]),
    ("Tint", [
        {"prefix": "4524", "not_contains": "A"},
    ]),
    ("Windshield Obstruction", [
        {"prefix": "4524", "contains": "A"},
    ]),
]
VIOLATION_OTHER = "Other"      # any other non-null cleaned code (also '')
VIOLATION_NONE = "None"        # null code

OPERATIONAL_CATEGORIES = [
    "Failure to Obey Traffic Sign/Light",
    "Improper Pass, Lane, One Way",
    "Improper Turn/Signal",
    "Red Light/Stop Sign/Yield",
    "Speeding/Reckless/Careless Driving",
]
COVERED_CATEGORIES = [
    "Display License Plate",
    "Inspection/Emission Sticker",
    "Lights",
    "Registration",
    "Windshield Obstruction",
]

# police action -> cube measure
ACTIONS = {
    "stop": "n_stopped",
    "frisk": "n_frisked",
    "search": "n_searched",
    "intrusion": "n_intruded",
}

SEASON_LABEL = {"Q1": "Jan-Mar", "Q2": "Apr-Jun", "Q3": "July-Sep", "Q4": "Oct-Dec"}
SEASON_START = {"Q1": "Jan", "Q2": "Apr", "Q3": "Jul", "Q4": "Oct"}
SEASON_END = {"Q1": "Mar", "Q2": "Jun", "Q3": "Sep", "Q4": "Dec"}

FIRST_QUARTER = "2014-Q1"
BEFORE_WINDOW = ("2021-01-01", "2021-12-31")
AFTER_WINDOW = ("2022-04-01", "2023-03-31")
ERAS_STOPS = [("2014-Q1", "2018-Q4"), ("2019-Q1", "2019-Q4"), ("2020-Q2", "2021-Q1")]
MAP_WINDOWS = [(("2018-01-01", "2018-12-31"), ("2019-01-01", "2019-12-31")),
               (BEFORE_WINDOW, AFTER_WINDOW)]

LOCATABLE_MAX_Y = 42.0            # a point is locatable when y < 42
HIN_DISTANCE = 0.0001             # planar degrees
AIRPORT_DISTRICT = "77"
UNKNOWN_PSA = "-1"
NO_DISTRICT = "00"
REMAP_DISTRICTS = {"06": "09", "09": "09", "6": "9", "9": "9"}

# ---------------------------------------------------------------------------
# Cube layout
# ---------------------------------------------------------------------------

STOP_KEYS = ["districtoccur", "psa", "quarter", "race", "gender", "age_range"]
REASON_KEYS = STOP_KEYS + ["violation_category"]
STOP_MEASURES = [
    "n_stopped",
    "n_people_in_stopped_vehicles",
    "n_searched",
    "n_arrested",
    "n_contraband",
    "n_frisked",
    "n_intruded",
]
HIN_KEYS = ["districtoccur", "psa", "quarter"]
HIN_MEASURES = ["n_stopped_locatable", "n_stopped_locatable_on_hin"]
SHOOTING_KEYS = ["quarter", "districtoccur"]
SHOOTING_MEASURES = ["n_shootings", "n_outside"]

# ---------------------------------------------------------------------------
# Analog parameters (TPC-H-ish test tables read as incidents; FIXTURES.md)
# ---------------------------------------------------------------------------

ANALOG = {
    "most_recent_quarter": "2000-Q4",
    "first_quarter": "1995-Q1",
    "eras": [("1995-Q1", "1996-Q4"), ("1997-Q1", "1997-Q4"), ("1998-Q2", "1999-Q1")],
    "before": ("1997-01-01", "1997-12-31"),
    "after": ("1998-04-01", "1999-03-31"),
    "map_windows": [(("1995-01-01", "1995-12-31"), ("1996-01-01", "1996-12-31"))],
    "report_year": 1998,
    "shared_district": ("24", "AFRICA"),
}
