"""Schemas and fixed values of the observation, station and report tables."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the data product and the report format exactly).
# ---------------------------------------------------------------------------
MISSING_VALUE = -9999          # sentinel of an absent measure in an observation line
SCALE = 10.0                   # scaled measures are stored as tenths
OBSERVATION_TOKENS = 12        # year month day hour + 8 measures
EARTH_RADIUS_KM = 6371         # sphere used by the distance function
STATION_DATE_FORMAT = "yyyyMMdd"
LATITUDE_FORMAT = "%+07.3f"
LONGITUDE_FORMAT = "%+08.3f"
ELEVATION_FORMAT = "%+07.1f"
REPORT_COLUMNS = [
    "YEAR",
    "MONTH",
    "DAY",
    "HOUR",
    "WIND SPEED*10(m/s)",
    "USAF-WBAN",
    "STATION_NAME",
    "COUNTRY",
    "STATE",
    "LATITUDE",
    "LONGITUDE",
    "ELEVATION(m)",
]
# Default job parameters: centre (Houston), elevation in m, radius in m, delta.
DEFAULT_LATITUDE = 29.761993
DEFAULT_LONGITUDE = -95.366302
DEFAULT_ELEVATION = 12.0
DEFAULT_RADIUS_M = 600_000.0
DEFAULT_DELTA = 3.0
# ---------------------------------------------------------------------------

# Scaled (tenths) measures and plain integer measures, in line-token order 4..11.
MEASURES = [
    ("air_temperature", "double"),
    ("dew_point_temperature", "double"),
    ("sea_level_pressure", "double"),
    ("wind_direction", "int"),
    ("wind_speed", "double"),
    ("total_cloud_cover", "int"),
    ("one_hour_precipitation", "double"),
    ("six_hour_precipitation", "double"),
]
MEASURE_NAMES = [m for m, _ in MEASURES]

OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("observation_id", T.StringType(), False),
        T.StructField("station_id", T.StringType(), False),
        T.StructField("year", T.IntegerType(), False),
        T.StructField("month", T.IntegerType(), False),
        T.StructField("day", T.IntegerType(), False),
        T.StructField("hour", T.IntegerType(), False),
        T.StructField("air_temperature", T.DoubleType(), True),
        T.StructField("dew_point_temperature", T.DoubleType(), True),
        T.StructField("sea_level_pressure", T.DoubleType(), True),
        T.StructField("wind_direction", T.IntegerType(), True),
        T.StructField("wind_speed", T.DoubleType(), True),
        T.StructField("wind_speed_x10", T.IntegerType(), True),
        T.StructField("total_cloud_cover", T.IntegerType(), True),
        T.StructField("one_hour_precipitation", T.DoubleType(), True),
        T.StructField("six_hour_precipitation", T.DoubleType(), True),
    ]
)
OBSERVATION_COLUMNS = OBSERVATION_SCHEMA.fieldNames()

# Raw CSV fields of the station catalogue, in file order. All read as text and
# decoded by expressions so that empty / malformed handling is explicit.
STATION_CSV_FIELDS = [
    "usaf",
    "wban",
    "station_name",
    "country",
    "state",
    "icao",
    "latitude",
    "longitude",
    "elevation",
    "begin",
    "end",
]
STATION_CSV_SCHEMA = T.StructType([T.StructField(f, T.StringType(), True) for f in STATION_CSV_FIELDS])

STATION_SCHEMA = T.StructType(
    [
        T.StructField("station_id", T.StringType(), False),
        T.StructField("usaf", T.StringType(), False),
        T.StructField("wban", T.StringType(), False),
        T.StructField("station_name", T.StringType(), True),
        T.StructField("country", T.StringType(), True),
        T.StructField("state", T.StringType(), True),
        T.StructField("icao", T.StringType(), True),
        T.StructField("latitude", T.DoubleType(), True),
        T.StructField("longitude", T.DoubleType(), True),
        T.StructField("elevation", T.DoubleType(), True),
        T.StructField("begin", T.DateType(), False),
        T.StructField("end", T.DateType(), False),
    ]
)
STATION_COLUMNS = STATION_SCHEMA.fieldNames()

# Report columns in snake case, for DataFrame results (the CSV sink renames to
# REPORT_COLUMNS).
REPORT_FIELDS = [
    "year",
    "month",
    "day",
    "hour",
    "wind_speed_x10",
    "station_id",
    "station_name",
    "country",
    "state",
    "latitude",
    "longitude",
    "elevation",
]
# The field that holds the tested measure.
VALUE_FIELD = "wind_speed_x10"


def measure_header(name: str) -> str:
    """Report header of a measure: tenths for scaled ones, as stored for integers."""
    if name == "wind_speed":
        return REPORT_COLUMNS[REPORT_FIELDS.index(VALUE_FIELD)]
    words = name.replace("_", " ").upper()
    return words if dict(MEASURES).get(name) == "int" else words + "*10"


# Sort keys of the report: time, then the observation (file) identifier.
REPORT_SORT_KEYS = ["year", "month", "day", "hour", "observation_id"]
