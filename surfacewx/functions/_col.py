from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    """A column name, a Column, or a Python literal -> Column."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def as_double(x) -> Column:
    """Like as_col, but a Python number becomes a DOUBLE literal."""
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return F.lit(float(x))
    return as_col(x)
