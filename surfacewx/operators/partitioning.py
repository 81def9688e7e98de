"""Parallelism of coarse inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Round-robin ``df`` over ``partitions`` partitions; None leaves it as it is.

    For unsplittable inputs (gzip text, a Parquet file with one row group) in
    front of CPU-heavy work per row. It moves every row, and after it rows of
    one file are no longer together, so it is only done where asked for.
    """
    return df if partitions is None else df.repartition(partitions)
