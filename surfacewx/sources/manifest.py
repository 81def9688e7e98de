"""A manifest of observation files, and a scan that reads by it.

Millions of small (often gzip) files are dear twice: every scan lists their
directories, and its tasks get either one file each or very uneven shares. A
manifest is a Parquet table with one row per file: ``path``,
``observation_id``, ``station_id``, ``year``, ``size`` and ``modified``,
ordered by station, so that a station filter skips row groups. It is made
once. A scan then takes rows of it, as many as are selected by any filter or
join, packs them by size into tasks and opens just these files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surfacewx.functions.keys import observation_key, station_key
from surfacewx.session import materialize
from surfacewx.sources.files import place

#: Bytes of files, as stored, that one task reads.
TASK_BYTES = 128 << 20
#: Bytes that a task holds of a file at a time.
BLOCK_BYTES = 4 << 20


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per observation file in ``path`` (one directory, a glob, or a
    list of them). Names without a ``-`` and empty files are skipped, directories
    below are not entered, as in the directory scan. Only names and sizes are read."""
    found = spark.read.format("binaryFile").load([path] if isinstance(path, str) else list(path))
    found = found.select("path", observation_key(F.col("path")).alias("observation_id"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    found = found.withColumn("station_id", station_key(F.col("observation_id"))).filter(F.col("station_id").isNotNull())
    year = F.substring_index("observation_id", "-", -1).try_cast("int")
    return found.select("path", "observation_id", "station_id", year.alias("year"), "size", "modified")


def write_manifest(spark: SparkSession, path: str | list[str], manifest: str) -> DataFrame:
    """List ``path`` once and write the manifest, which is returned. A
    manifest that stands there is replaced."""
    list_files(spark, path).orderBy("station_id", "path").write.mode("overwrite").parquet(manifest)
    return read_manifest(spark, manifest)


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    return spark.read.parquet(manifest)


def packed(files: DataFrame, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, int]:
    """``files`` with the number of the ``task`` (int) that reads each, and the number of tasks.

    Files are laid end to end in the order of their paths, and the line is
    cut into equal pieces of at most ``task_bytes``; a file belongs to the
    piece that its middle is in. So a task's bytes differ from the mean by no
    more than the largest file, and tasks from one another by less than twice
    where no file is above a third of the mean. The sums are distributed: inside
    range partitions, with one row per partition for what lies before it.
    """
    spark = files.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(files.repartitionByRange(n, "path").withColumn("_part", F.spark_partition_id()))
    # One row per partition: a window without partitioning is fine here.
    sums = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"))
    before = sums.select("_part", F.sum("_bytes").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    total = ranged.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // task_bytes))
    upto = F.sum("size").over(Window.partitionBy("_part").orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.coalesce("_before", F.lit(0)) + F.col("_upto") - F.col("size") / 2
    task = F.least(F.lit(tasks - 1), F.floor(middle * (tasks / max(total, 1)))).cast("int")
    out = ranged.withColumn("_upto", upto).join(F.broadcast(before), "_part", "left").withColumn("task", task)
    return out.drop("_part", "_upto", "_before"), tasks


def read_manifest_lines(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Raw lines of the given manifest rows: ``value``, ``observation_id`` and ``station_id``, as ``read_observation_lines`` has them.

    No directory is listed. Each task opens its files one after another
    (through ``pyarrow.fs``: local, HDFS, S3, GCS) and streams them in blocks;
    ``.gz``, ``.bz2``, ``.zst`` and ``.lz4`` are decompressed. A line ends at ``\\n``,
    ``\\r\\n`` or ``\\r``; what is not UTF-8 becomes U+FFFD. A file that is gone or
    has another size than in the manifest ends the query with its name, so a stale
    manifest gives no wrong rows. No files give no lines.
    """
    names = ["value", "observation_id", "station_id"]
    rows, tasks = packed(files, task_bytes)
    rows = rows.select("path", "observation_id", "station_id", "size", "task").repartitionById(tasks, F.col("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(lines: list[bytes], observation: str, station: str) -> pa.RecordBatch:
            text = [x.rstrip(b"\r\n").decode("utf-8", "replace") for x in lines]
            return pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array([observation] * len(text), pa.string()), pa.array([station] * len(text), pa.string())], names=names)

        for b in batches:
            for path, observation, station, size, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, inside = place(path)
                if store.get_file_info(inside).size != size:
                    raise OSError(f"{path} is not as the manifest has it")
                rest = b""
                with store.open_input_stream(inside) as file:
                    while block := file.read(BLOCK_BYTES):
                        *lines, rest = (rest + block).splitlines(keepends=True)
                        if lines:
                            yield batch(lines, observation, station)
                if rest:
                    yield batch([rest], observation, station)

    return rows.mapInArrow(run, "value string, observation_id string, station_id string")
