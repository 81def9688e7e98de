"""Distributed row positions of a total order (no single-partition window)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ROW_BITS = 33  # monotonically_increasing_id = partition id << 33 | row index


def with_position(
    df: DataFrame, keys: list[str], out_col: str = "position", partitions: int | None = None, materialize: bool = True
) -> DataFrame:
    """Add the 1-based position of every row in the order of ``keys``.

    ``keys`` must be unique per row (add a tie-breaker) so that the order,
    and thus the positions, are the same on every recomputation.

    Plan: range-partition on the keys, sort inside each partition, take the
    row index inside the partition from the monotonically increasing id, count
    rows per partition (one row per partition: a bounded, broadcast table),
    turn counts into offsets, add. Data moves once, by the range exchange.

    The tagged rows (partition id, row index) are checkpointed once, and the
    count and the numbering both read that checkpoint. They must see the same
    range partitioning: two separate range exchanges would each sample their
    input with a seed tied to their own RDD and can choose different bounds.
    With ``materialize`` the input is checkpointed as well, so the sampling
    job and the exchange do not compute the input plan twice (pass False when
    the input is already materialized).
    """
    from surfacewx.session import materialize as checkpointed

    spark = df.sparkSession
    if materialize:
        df = checkpointed(df)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return number_rows(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys), out_col)


def number_rows(df: DataFrame, out_col: str = "position") -> DataFrame:
    """Add the 1-based position of every row in the order ``df`` has (that of
    its partitions, and of the rows in them), such as after a global sort."""
    from surfacewx.session import materialize as checkpointed

    ranged = checkpointed(
        df.withColumn("_pid", F.spark_partition_id())
        .withColumn("_idx", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a window without partitioning is fine here.
    offsets = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off")
    )
    out = ranged.join(F.broadcast(offsets), "_pid", "left")
    pos = (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_idx") + 1).cast("long")
    return out.withColumn(out_col, pos).drop("_pid", "_idx", "_off")
