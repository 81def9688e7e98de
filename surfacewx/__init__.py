"""surfacewx: extreme-reading detection over hourly weather-station data on Spark.

Everything is a DataFrame -> DataFrame or Column -> Column builder; the caller
owns the SparkSession.
"""

from surfacewx.plans.detect import detect, detect_files, outlier_report
from surfacewx.schema import (
    DEFAULT_DELTA,
    DEFAULT_ELEVATION,
    DEFAULT_LATITUDE,
    DEFAULT_LONGITUDE,
    DEFAULT_RADIUS_M,
    OBSERVATION_SCHEMA,
    REPORT_COLUMNS,
    STATION_SCHEMA,
)
from surfacewx.sources.observations import read_observations
from surfacewx.sources.stations import read_stations

__all__ = [
    "detect",
    "detect_files",
    "outlier_report",
    "read_observations",
    "read_stations",
    "OBSERVATION_SCHEMA",
    "STATION_SCHEMA",
    "REPORT_COLUMNS",
    "DEFAULT_LATITUDE",
    "DEFAULT_LONGITUDE",
    "DEFAULT_ELEVATION",
    "DEFAULT_RADIUS_M",
    "DEFAULT_DELTA",
]
