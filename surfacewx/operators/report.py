"""The 12-column text report of outliers and its order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfacewx.functions.decode import round_half_up_x10
from surfacewx.functions.format import or_empty, signed_fixed
from surfacewx.schema import ELEVATION_FORMAT, LATITUDE_FORMAT, LONGITUDE_FORMAT, MEASURES, REPORT_FIELDS, REPORT_SORT_KEYS


def report_columns(value_col: str = "wind_speed", x10_col: str | None = "wind_speed_x10"):
    """Column expressions of the report, in REPORT_FIELDS order."""
    if x10_col is not None:
        x10 = F.coalesce(F.col(x10_col).cast("long"), round_half_up_x10(F.col(value_col)).cast("long"))
    else:
        whole = dict(MEASURES).get(value_col) == "int"  # integer measures are printed as they are
        x10 = F.col(value_col).cast("long") if whole else round_half_up_x10(F.col(value_col)).cast("long")
    exprs = [
        F.col("year").cast("string"),
        F.col("month").cast("string"),
        F.col("day").cast("string"),
        F.col("hour").cast("string"),
        or_empty(x10),
        or_empty("station_id"),
        or_empty("station_name"),
        or_empty("country"),
        or_empty("state"),
        signed_fixed("latitude", LATITUDE_FORMAT),
        signed_fixed("longitude", LONGITUDE_FORMAT),
        signed_fixed("elevation", ELEVATION_FORMAT),
    ]
    return [e.alias(n) for e, n in zip(exprs, REPORT_FIELDS)]


def format_report(df: DataFrame, value_col: str = "wind_speed", x10_col: str | None = None, keep: list[str] | tuple = ()) -> DataFrame:
    """Project enriched outlier rows to the 12 report text columns.

    ``x10_col`` names a raw tenths column printed as it is (avoids a float
    round trip); otherwise ``round(10 * value)`` with ties up is printed, and
    integer measures as they are. The value stands in the field
    ``wind_speed_x10`` whatever the measure; the sinks name it in the header.
    """
    if x10_col is None and value_col == "wind_speed" and "wind_speed_x10" in df.columns:
        x10_col = "wind_speed_x10"
    return df.select(*report_columns(value_col, x10_col), *[F.col(k) for k in keep])


def sort_report(df: DataFrame, tiebreak: list[str] | tuple = ()) -> DataFrame:
    """Order by year, month, day, hour, observation id (then ``tiebreak``).

    A range-partitioned global sort: the output is many ordered partitions,
    never one task holding everything.
    """
    return df.orderBy(*REPORT_SORT_KEYS, *tiebreak)
