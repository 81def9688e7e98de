"""Identifiers derived from file names and catalogue fields.

Plain string functions (``substring_index``, ``substr``), no regular
expressions: the keys are evaluated on every observation line.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from surfacewx.functions._col import as_col


def _before_last(c: Column, sep: str) -> Column:
    """Text before the last ``sep`` (callers check that ``sep`` occurs)."""
    tail = F.substring_index(c, sep, -1)
    return c.substr(F.lit(1), F.length(c) - F.length(tail) - 1)


def file_base_name(path) -> Column:
    """Last path component (no directories)."""
    return F.substring_index(as_col(path), "/", -1)


def observation_key(path) -> Column:
    """Observation identifier of a file: base name without its last extension.

    ``/d/722430-12960-2008.gz`` -> ``722430-12960-2008``; ``a.txt.gz`` -> ``a.txt``.
    """
    base = file_base_name(path)
    return F.when(base.contains("."), _before_last(base, ".")).otherwise(base)


def station_key(name) -> Column:
    """Station identifier of a file name or observation id: all before the last ``-``.

    A name without ``-`` has no station: NULL, so it never matches a station.
    """
    c = as_col(name)
    return F.when(c.contains("-"), _before_last(c, "-"))


def station_id_of(usaf, wban) -> Column:
    """Catalogue key ``USAF-WBAN``."""
    return F.concat_ws("-", as_col(usaf), as_col(wban))
