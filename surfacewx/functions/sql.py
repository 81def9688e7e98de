"""The public functions for use from SQL text.

They are SQL functions of the session: the optimizer inlines their bodies, so
they run as built-in expressions, without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from surfacewx.schema import EARTH_RADIUS_KM

_BASE = "substring_index(path, '/', -1)"
SQL_FUNCTIONS = {
    "weather_distance_m(lat1 DOUBLE, lon1 DOUBLE, elev1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, elev2 DOUBLE) RETURNS DOUBLE": f"""
        sqrt(pow({float(EARTH_RADIUS_KM)}D * (2 * atan2(
               sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)),
               sqrt(1 - (pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))) * 1000, 2)
             + pow(elev1 - elev2, 2))""",
    "observation_key(path STRING) RETURNS STRING": f"""
        CASE WHEN contains({_BASE}, '.')
             THEN left({_BASE}, length({_BASE}) - length(substring_index({_BASE}, '.', -1)) - 1) ELSE {_BASE} END""",
    "station_key(name STRING) RETURNS STRING": """
        CASE WHEN contains(name, '-') THEN left(name, length(name) - length(substring_index(name, '-', -1)) - 1) END""",
    "round_half_up_x10(value DOUBLE) RETURNS BIGINT": "floor(value * 10.0D + 0.5D)",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Define ``weather_distance_m``, ``observation_key``, ``station_key`` and
    ``round_half_up_x10`` in the session; returns their names. A null argument
    gives null; calling it again changes nothing."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in SQL_FUNCTIONS]
