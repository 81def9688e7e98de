"""Pooled statistics of one measure: count, mean and sample standard deviation.

All are built-in declarative aggregates, so Spark runs a partial aggregate in
every task and merges one row per task: nothing but a handful of numbers ever
crosses the single-row exchange, however large or skewed the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pooled_stats(df: DataFrame, value_col: str = "wind_speed") -> DataFrame:
    """One row: ``n`` (non-NULL values), ``mean``, ``stddev`` (sample, n-1).

    NULL values are skipped. With no values mean is NULL; with one value the
    standard deviation is NULL; any comparison with NULL keeps nothing.
    """
    v = F.col(value_col).cast("double")
    return df.agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("stddev"),
    )


def pooled_stats_many(df: DataFrame, value_cols: list[str]) -> DataFrame:
    """``pooled_stats`` of several measures in one pass: one row per measure
    (``measure, n, mean, stddev``).

    A single global aggregate with three partial aggregates per measure (a
    one-row exchange); the result row is then stacked, rather than unpivoting
    the data and grouping by measure.
    """
    aggs = []
    for m in value_cols:
        v = F.col(m).cast("double")
        aggs += [F.count(v).alias(f"{m}__n"), F.avg(v).alias(f"{m}__mean"), F.stddev_samp(v).alias(f"{m}__sd")]
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"),
                F.col(f"{m}__n").alias("n"),
                F.col(f"{m}__mean").alias("mean"),
                F.col(f"{m}__sd").alias("stddev"),
            )
            for m in value_cols
        ]
    )
    return df.agg(*aggs).select(F.inline(rows))


def partial_stats(df: DataFrame, value_col: str = "wind_speed", by: str | list[str] = "station_id") -> DataFrame:
    """Mergeable per-group partials: ``n``, ``mean`` and ``m2`` (sum of squared
    deviations) for every group, skipping groups without values."""
    keys = [by] if isinstance(by, str) else list(by)
    v = F.col(value_col).cast("double")
    return (
        df.groupBy(*keys)
        .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))
        .filter(F.col("n") > 0)
    )


def merge_partials(partials: DataFrame, materialize: bool = True) -> DataFrame:
    """Roll partials up into pooled statistics (same columns as pooled_stats).

    n = sum n_i, mean = sum n_i m_i / n, M2 = sum M2_i + sum n_i (m_i - mean)^2
    (the two-step form: no cancellation between large sums). The grand mean
    is a scalar subquery, so the partial table is read twice; with
    ``materialize`` it is checkpointed first (it has one row per group), so
    the data it was grouped from is scanned once.
    """
    if materialize:
        from surfacewx.session import materialize as checkpointed

        partials = checkpointed(partials)
    n = F.col("n").cast("double")
    grand_mean = partials.agg((F.sum(n * F.col("mean")) / F.sum(n)).alias("gm")).scalar()
    m2 = F.sum(F.col("m2") + n * F.pow(F.col("mean") - grand_mean, 2))
    total = F.sum("n")
    return partials.agg(
        F.coalesce(total, F.lit(0)).cast("long").alias("n"),
        (F.sum(n * F.col("mean")) / F.sum(n)).alias("mean"),
        F.when(total > 1, F.sqrt(m2 / (total - 1))).alias("stddev"),
    )
