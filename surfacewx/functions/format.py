"""Text rendering used by the report and the station label."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from surfacewx.functions._col import as_col


def signed_fixed(value, pattern: str) -> Column:
    """``format_string(pattern, value)`` with NULL -> ``''``.

    The guard is needed: format_string renders a NULL argument as text.
    """
    c = as_col(value)
    return F.when(c.isNull(), F.lit("")).otherwise(F.format_string(pattern, c))


def or_empty(value) -> Column:
    """Text of a value, NULL -> ``''``."""
    return F.coalesce(as_col(value).cast("string"), F.lit(""))


def station_label(
    station_id="station_id",
    station_name="station_name",
    country="country",
    state="state",
    icao="icao",
    latitude="latitude",
    longitude="longitude",
    elevation="elevation",
    begin="begin",
    end="end",
) -> Column:
    """One-line description of a station.

    ``<id>: <name>,<country>,<state>,<icao>, (<lat>,<lon>,<elev>), [<begin>-<end>]``
    with absent parts left empty and dates as ``yyyyMMdd``.
    """
    return F.concat(
        as_col(station_id),
        F.lit(": "),
        or_empty(station_name),
        F.lit(","),
        or_empty(country),
        F.lit(","),
        or_empty(state),
        F.lit(","),
        or_empty(icao),
        F.lit(", ("),
        or_empty(latitude),
        F.lit(","),
        or_empty(longitude),
        F.lit(","),
        or_empty(elevation),
        F.lit("), ["),
        F.date_format(as_col(begin), "yyyyMMdd"),
        F.lit("-"),
        F.date_format(as_col(end), "yyyyMMdd"),
        F.lit("]"),
    )
