"""Great-circle + elevation distance as a Column expression.

The centre is normally a literal, so Catalyst folds its trigonometry to
constants and only the station side is computed per row.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from surfacewx.functions._col import as_double
from surfacewx.schema import EARTH_RADIUS_KM


def distance_m(lat1, lon1, elev1, lat2, lon2, elev2) -> Column:
    """Distance in metres between two (latitude, longitude, elevation) points.

    Haversine on a sphere of EARTH_RADIUS_KM, then combined with the elevation
    difference by Pythagoras. Arguments are column names, Columns or numbers.
    A NULL input gives NULL; rounding that pushes ``a`` above 1 gives NaN.
    """
    lat1, lon1, elev1 = as_double(lat1), as_double(lon1), as_double(elev1)
    lat2, lon2, elev2 = as_double(lat2), as_double(lon2), as_double(elev2)
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    central_angle = 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
    surface = F.lit(float(EARTH_RADIUS_KM)) * central_angle * 1000
    height = elev1 - elev2
    return F.sqrt(F.pow(surface, 2) + F.pow(height, 2))


def latitude_band(lat, lat0: float, radius_m: float) -> Column:
    """Necessary condition for ``distance <= radius_m``: a latitude band, for
    stored latitudes within [-90, 90].

    The great-circle distance is at least R * |dlat| (radians) and the
    elevation term only adds, so stations outside the band can be skipped
    before any trigonometry. It is a plain range on the stored latitude, so it
    reaches the Parquet scan as a pushed filter. A tiny relative margin keeps
    boundary stations (the exact test is applied afterwards anyway).
    """
    half_width = math.degrees(radius_m / (EARTH_RADIUS_KM * 1000.0)) * (1 + 1e-9) + 1e-9
    c = as_double(lat)
    return (c >= F.lit(lat0 - half_width)) & (c <= F.lit(lat0 + half_width))


def longitude_band(lon, lat0: float, lon0: float, radius_m: float) -> Column | None:
    """Necessary condition for ``distance <= radius_m`` on the longitude, or
    None when no useful bound exists (the band would reach a pole, or cover
    every longitude), for stored coordinates within the usual ranges.

    From the haversine identity hav(c) = hav(dlat) + cos(lat0) cos(lat) hav(dlon)
    >= cos(lat0) cos(lat) hav(dlon), and cos(lat) >= cos(|lat0| + w) inside
    the latitude band of half-width w = radius / R: hav(dlon) <= hav(w) /
    (cos(lat0) cos(|lat0| + w)). Across the antimeridian the band is two
    ranges. A plain range on the stored longitude, so it is pushed to the scan.
    """
    w = radius_m / (EARTH_RADIUS_KM * 1000.0)
    far = abs(math.radians(lat0)) + w
    if w >= math.pi or far >= math.pi / 2:
        return None
    s = math.sin(w / 2) ** 2 / (math.cos(math.radians(lat0)) * math.cos(far))
    if s >= 1:
        return None
    half = math.degrees(2 * math.asin(math.sqrt(s))) * (1 + 1e-9) + 1e-9
    if half >= 180:
        return None
    lo, hi = lon0 - half, lon0 + half
    c = as_double(lon)
    band = (c >= F.lit(max(lo, -180.0))) & (c <= F.lit(min(hi, 180.0)))
    if lo < -180:
        band = band | (c >= F.lit(lo + 360.0))
    if hi > 180:
        band = band | (c <= F.lit(hi - 360.0))
    return band
