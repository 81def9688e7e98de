"""Decoding of observation-line tokens and the inverse encoding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from surfacewx.functions._col import as_col
from surfacewx.schema import MISSING_VALUE, SCALE


def tokens(line) -> Column:
    """Whitespace-separated tokens of a line (a blank line gives ``[]``).

    One regex split; the empty strings it leaves for leading or trailing
    whitespace are removed (cheaper than stripping with a second regex).
    """
    return F.array_remove(F.split(as_col(line), r"\s+"), "")


def parse_int_token(tok) -> Column:
    """Integer value of a token, NULL when it is not a 32-bit integer."""
    return as_col(tok).try_cast("int")


def parse_int_tokens(toks) -> Column:
    """Element-wise ``parse_int_token`` of a token array (NULL per bad token)."""
    return as_col(toks).try_cast("array<int>")


def sentinel_or_null(raw) -> Column:
    """Integer measure: the sentinel becomes NULL, any other value is kept."""
    return F.nullif(as_col(raw), F.lit(MISSING_VALUE))


def scaled_or_null(raw) -> Column:
    """Tenths measure: the sentinel becomes NULL, any other value is divided by 10."""
    return sentinel_or_null(raw) / F.lit(SCALE)


def round_half_up_x10(value) -> Column:
    """``round(10 * value)`` with ties towards +infinity, as a BIGINT."""
    return F.floor(as_col(value) * F.lit(SCALE) + F.lit(0.5))


def to_sentinel_x10(value) -> Column:
    """Inverse of scaled_or_null: tenths as an integer, NULL -> sentinel."""
    return F.coalesce(round_half_up_x10(value).cast("int"), F.lit(MISSING_VALUE))
