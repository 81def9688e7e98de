"""Station selection by distance from a centre point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfacewx.functions._col import as_double
from surfacewx.functions.geo import distance_m, latitude_band, longitude_band


def with_distance(
    stations: DataFrame,
    latitude: float,
    longitude: float,
    elevation: float,
    lat_col: str = "latitude",
    lon_col: str = "longitude",
    elev_col: str = "elevation",
    out_col: str = "distance_m",
) -> DataFrame:
    """Add the distance in metres from the centre (NULL when a coordinate is missing)."""
    return stations.withColumn(
        out_col, distance_m(latitude, longitude, elevation, F.col(lat_col), F.col(lon_col), F.col(elev_col))
    )


def within_radius(
    stations: DataFrame,
    latitude: float,
    longitude: float,
    elevation: float,
    radius_m: float,
    lat_col: str = "latitude",
    lon_col: str = "longitude",
    elev_col: str = "elevation",
    keep_distance: bool = True,
) -> DataFrame:
    """Stations with all three coordinates present and distance <= radius_m.

    The latitude band, and away from the poles a longitude band, are cheap,
    pushable pre-filters (row groups of a large Parquet catalogue are
    skipped). They are necessary conditions for coordinates in the usual
    ranges; a station stored beyond them (longitude 264 for -96, say) passes
    straight to the exact inclusive test, which follows for all. Around a
    centre beyond the ranges no band is used.
    """
    present = F.col(lat_col).isNotNull() & F.col(lon_col).isNotNull() & F.col(elev_col).isNotNull()
    near = stations.filter(present)
    if abs(latitude) <= 90 and abs(longitude) <= 180:
        lat, lon = as_double(F.col(lat_col)), as_double(F.col(lon_col))
        bands = latitude_band(lat, latitude, radius_m)
        lon_band = longitude_band(lon, latitude, longitude, radius_m)
        if lon_band is not None:
            bands = bands & lon_band
        unusual = (lat < -90.0) | (lat > 90.0) | (lon < -180.0) | (lon > 180.0)
        near = stations.filter(present & (bands | unusual))
    near = with_distance(near, latitude, longitude, elevation, lat_col, lon_col, elev_col)
    near = near.filter(F.col("distance_m") <= F.lit(float(radius_m)))
    return near if keep_distance else near.drop("distance_m")


def selected_ids(stations: DataFrame, latitude: float, longitude: float, elevation: float, radius_m: float, id_col: str = "station_id") -> DataFrame:
    """Distinct ids of the stations within the radius."""
    return within_radius(stations, latitude, longitude, elevation, radius_m).select(id_col).distinct()
