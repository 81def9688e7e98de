"""Outliers: values strictly above mean + delta * sample stddev."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfacewx.operators.stats import pooled_stats


def threshold(df: DataFrame, value_col: str = "wind_speed", delta: float = 3.0) -> Column:
    """``mean + delta * stddev`` of ``value_col`` as a scalar-subquery Column.

    Used in a filter it is evaluated once, reused, and pushed to a Parquet scan
    as ``value > scalar-subquery``; no join with a one-row table is planned.
    """
    s = pooled_stats(df, value_col)
    return s.select((F.col("mean") + F.lit(float(delta)) * F.col("stddev")).alias("threshold")).scalar()


def threshold_table(df: DataFrame, value_col: str = "wind_speed", deltas: Iterable[float] = (1.0, 2.0, 3.0)) -> DataFrame:
    """One row per delta: ``delta, n, mean, stddev, threshold`` (one aggregate pass)."""
    s = pooled_stats(df, value_col)
    rows = F.array(
        *[
            F.struct(F.lit(float(d)).alias("delta"), (F.col("mean") + F.lit(float(d)) * F.col("stddev")).alias("threshold"))
            for d in deltas
        ]
    )
    return s.select("n", "mean", "stddev", F.inline(rows)).select("delta", "n", "mean", "stddev", "threshold")


def find_outliers(df: DataFrame, value_col: str = "wind_speed", delta: float = 3.0, stats_of: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` whose ``value_col`` is strictly above the threshold.

    The statistics are pooled over ``stats_of`` (default: ``df`` itself). A
    NULL value, or a NULL threshold (fewer than two values), keeps nothing.
    """
    thr = threshold(stats_of if stats_of is not None else df, value_col, delta)
    return df.filter(F.col(value_col) > thr)
