"""One-time ingest of raw observation text into a Parquet table.

Parsing text is the expensive part of every run, and the statistics and the
outlier filter each read the observations once. Ingesting once makes both
reads columnar: the statistics scan reads two columns, and the outlier scan
gets ``wind_speed > threshold`` pushed into the Parquet reader.

Layout: partitioned by ``batch`` (what was written together) and ``year``
(year filters prune directories), range-clustered by year and station across
files and sorted inside them, so a filter on stations skips files and row
groups by their min/max: text splits are packed from files in any order, so
without the one shuffle of the ingest every file would span all stations.
Not partitioned by station: one directory per station and year would make
far too many small files.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacewx.sources.observations import read_observations

SORT_KEYS = ["year", "station_id", "month", "day", "hour"]


def write_observation_table(
    obs: DataFrame, path: str, mode: str = "overwrite", max_records_per_file: int = 5_000_000, batch: str = "all", partitions: int | None = None
) -> None:
    """Write typed observations as a Parquet table clustered by year and station.

    ``mode`` "overwrite" replaces the table, "replace_batch" only what the
    table holds of ``batch`` (for a batch that is written again), "append" adds.
    """
    keys = ["year", "station_id"]
    ranged = obs.repartitionByRange(partitions, *keys) if partitions else obs.repartitionByRange(*keys)
    replace = mode == "replace_batch"
    (
        ranged.withColumn("batch", F.lit(batch))
        .sortWithinPartitions(*SORT_KEYS)
        .write.mode("overwrite" if replace else mode)
        .option("partitionOverwriteMode", "dynamic" if replace else "static")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("batch", "year")
        .parquet(path)
    )


def ingest_to_parquet(
    spark: SparkSession,
    text_path: str | list[str],
    table_path: str,
    station_ids: Iterable[str] | None = None,
    mode: str = "FAILFAST",
) -> None:
    """Parse every observation file under ``text_path`` once into ``table_path``."""
    write_observation_table(read_observations(spark, text_path, station_ids, mode=mode), table_path)


def read_observation_table(spark: SparkSession, path: str) -> DataFrame:
    """The ingested table, with the OBSERVATION_SCHEMA column order."""
    from surfacewx.schema import OBSERVATION_COLUMNS

    return spark.read.parquet(path).select(*OBSERVATION_COLUMNS)
