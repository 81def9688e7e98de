"""Streaming form of the observation scan.

New station-year files land in a directory over time. The same line decoder
as the batch reader runs on a file-source stream, and the typed rows are
added to the Parquet table that ``detect`` reads, next to what a batch ingest
wrote there. The file source remembers which files it has processed (in the
checkpoint), and each micro-batch replaces its own ``batch`` partition, so a
restarted or retried query neither skips nor repeats a file and the table
stays plain Parquet.

The detection itself stays a batch job: its threshold is pooled over all
observations, which a running aggregate would only approximate.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from surfacewx.functions.keys import observation_key, station_key
from surfacewx.plans.ingest import write_observation_table
from surfacewx.schema import OBSERVATION_COLUMNS
from surfacewx.sources.observations import parse_observations


def observation_stream(spark: SparkSession, directory: str, mode: str = "FAILFAST", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of typed observations from files arriving in ``directory``.

    As in the batch reader a malformed line stops the query (FAILFAST), unless
    the caller chooses to drop such lines or to keep them (PERMISSIVE).
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(directory)
    lines = lines.select(
        "value", observation_key(F.col("_metadata.file_name")).alias("observation_id")
    ).withColumn("station_id", station_key(F.col("observation_id")))
    lines = lines.filter(F.col("station_id").isNotNull())
    return parse_observations(lines, mode=mode)


def start_ingest(
    spark: SparkSession,
    directory: str,
    table_path: str,
    checkpoint: str,
    available_now: bool = True,
    mode: str = "FAILFAST",
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Append newly arrived files to the Parquet table at ``table_path``.

    ``available_now`` processes everything present and stops (a scheduled
    incremental job); otherwise the query keeps polling the directory.
    """
    obs = observation_stream(spark, directory, mode, max_files_per_trigger)
    stream = f"{zlib.crc32(checkpoint.encode()):08x}"  # batches of another stream into the table have other names

    def write(batch: DataFrame, number: int) -> None:
        write_observation_table(batch.select(*OBSERVATION_COLUMNS), table_path, "replace_batch", batch=f"stream-{stream}-{number}")

    w = obs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
