"""The ingested table with its books: kept statistics, line counts, bad lines.

One Parquet table under ``path`` (see :mod:`surfacewx.plans.ingest`) and three
small ones inside it, in folders whose names begin with an underscore, so that
a reader of the table does not see them:

- ``_statistics``: per batch, station, year and measure the number of values,
  mean, sum of squared deviations and maximum, and per station and year the
  rows. A batch's statistics are replaced with the batch, so the table's are
  always the merge of what it holds, and a threshold needs no observation.
- ``_ingests``: per batch the lines read and the bad ones among them, counted
  in the pass that parses.
- ``_quarantine``: the bad lines themselves, as text, with their file's name.

A batch is parsed once, into a staging folder; the table, its statistics and
the quarantine are made from that. A batch that is ingested again replaces its
own rows in all four. The staging folder goes at the end; one that a lost
driver leaves behind is not part of the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from surfacewx.operators.joins import semi_join
from surfacewx.plans.ingest import write_observation_table
from surfacewx.schema import MEASURE_NAMES, OBSERVATION_COLUMNS
from surfacewx.sources.observations import CORRUPT_COLUMN, parse_observations, read_observation_lines

STATISTICS, INGESTS, QUARANTINE = "_statistics", "_ingests", "_quarantine"
STATISTICS_SCHEMA = "station_id string, year int, rows long, measure string, n long, mean double, m2 double, high double, batch string"
INGESTS_SCHEMA = "lines long, bad long, batch string"
QUARANTINE_SCHEMA = "observation_id string, station_id string, line string, batch string"


def _replace(df: DataFrame, path: str, batch: str) -> None:
    """Write ``df`` as the partition ``batch`` of the Parquet table at ``path``, in the place of what it had."""
    out = df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("batch").parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _empty_batch(spark: SparkSession, path: str, batch: str) -> None:
    """A batch without rows leaves no partition to overwrite: what it had before goes."""
    _delete(spark, f"{path}/batch={batch}")


def measure_partials(obs: DataFrame) -> DataFrame:
    """``(station_id, year, rows, measure, n, mean, m2, high)``: mergeable
    statistics of every measure per station and year, in one aggregation; a
    measure without values has ``n`` 0."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for m in MEASURE_NAMES:
        v = F.col(m).cast("double")
        aggs += [F.count(v).alias(f"{m}__n"), F.avg(v).alias(f"{m}__mean"), (F.var_pop(v) * F.count(v)).alias(f"{m}__m2"), F.max(v).alias(f"{m}__high")]
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), *[F.col(f"{m}__{k}").alias(k) for k in ("n", "mean", "m2", "high")]) for m in MEASURE_NAMES])
    return obs.groupBy("station_id", "year").agg(*aggs).select("station_id", "year", "rows", F.inline(rows))


def ingest_lines(lines: DataFrame, path: str, batch: str = "all", mode: str = "FAILFAST", partitions: int | None = None) -> dict[str, int]:
    """Parse ``lines(value, observation_id, station_id)`` into the table at
    ``path`` as its batch ``batch``; returns the lines and the bad ones.

    FAILFAST raises on a bad line and changes nothing. With DROPMALFORMED and
    PERMISSIVE the good lines become rows; both count the bad ones, and
    PERMISSIVE also keeps their text in the quarantine. A batch without good
    lines leaves the table without rows of that batch.
    """
    spark, mode = lines.sparkSession, mode.upper()
    stage = f"{path}/_staging-{uuid.uuid4().hex}"
    parsed = parse_observations(lines, mode="FAILFAST" if mode == "FAILFAST" else "PERMISSIVE", keep=["value"])
    if mode == "FAILFAST":
        parsed = parsed.withColumn(CORRUPT_COLUMN, F.lit(None).cast("string"))
    seen = Observation("ingest")
    bad = F.col(CORRUPT_COLUMN).isNotNull()
    parsed = parsed.drop("value").observe(seen, F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad"))
    schema = parsed.schema
    try:
        parsed.withColumn("is_bad", bad).write.partitionBy("is_bad").parquet(stage)
        counts = {k: int(seen.get[k]) for k in ("lines", "bad")}
        staged = spark.read.schema(schema.add("is_bad", "boolean")).parquet(stage)
        if counts["lines"] > counts["bad"]:
            good = staged.filter("NOT is_bad").select(*OBSERVATION_COLUMNS)
            write_observation_table(good, path, "replace_batch", batch=batch, partitions=partitions)
            rows = spark.read.parquet(path).filter(F.col("batch") == batch)
            _replace(measure_partials(rows).sort("measure", "station_id"), f"{path}/{STATISTICS}", batch)
        else:
            _empty_batch(spark, path, batch)
            _empty_batch(spark, f"{path}/{STATISTICS}", batch)
        if mode == "PERMISSIVE" and counts["bad"]:
            _replace(staged.filter("is_bad").select("observation_id", "station_id", F.col(CORRUPT_COLUMN).alias("line")), f"{path}/{QUARANTINE}", batch)
        else:
            _empty_batch(spark, f"{path}/{QUARANTINE}", batch)
        _replace(spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()]), f"{path}/{INGESTS}", batch)
    finally:
        _delete(spark, stage)
    return counts


def ingest_files(spark: SparkSession, text_path: str | list[str], path: str, batch: str = "all", mode: str = "FAILFAST") -> dict[str, int]:
    """:func:`ingest_lines` over the observation files under ``text_path``."""
    return ingest_lines(read_observation_lines(spark, text_path), path, batch, mode)


def _book(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    folder = f"{path}/{name}"
    return spark.read.schema(schema).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], schema)


def table_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The kept partials (``STATISTICS_SCHEMA``) of the table at ``path``."""
    return _book(spark, path, STATISTICS, STATISTICS_SCHEMA)


def table_ingests(spark: SparkSession, path: str) -> DataFrame:
    """``(lines, bad, batch)`` of every batch of the table."""
    return _book(spark, path, INGESTS, INGESTS_SCHEMA)


def table_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """``(observation_id, station_id, line, batch)``: the bad lines that were kept."""
    return _book(spark, path, QUARANTINE, QUARANTINE_SCHEMA)


def statistics_match(spark: SparkSession, path: str) -> bool:
    """Whether the kept statistics count exactly the rows of each batch of the
    table. False after a writer that does not keep them, or one that was lost
    between the two writes. Reads no observation column."""
    held = spark.read.parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("held"))
    kept = table_statistics(spark, path).filter(F.col("measure") == MEASURE_NAMES[0]).groupBy("batch").agg(F.sum("rows").alias("kept"))
    return not held.join(kept, "batch", "full").filter(~F.col("held").eqNullSafe(F.col("kept"))).limit(1).count()


def merged_statistics(partials: DataFrame, measure: str, stations: DataFrame | None = None) -> DataFrame:
    """``n, mean, stddev, high`` of ``measure`` from kept partials, pooled over
    the stations of ``stations(station_id)`` if given.

    The two-step merge: the grand mean first, as a scalar subquery, then the
    squared deviations from it, so nothing is lost to cancellation. Without
    values mean and stddev are null, with one value stddev is.
    """
    some = partials.filter((F.col("measure") == measure) & (F.col("n") > 0))
    if stations is not None:
        some = semi_join(some, stations, "station_id")
    n = F.col("n").cast("double")
    grand = some.agg((F.sum(n * F.col("mean")) / F.sum(n)).alias("mean")).scalar()
    m2 = F.sum(F.col("m2") + n * F.pow(F.col("mean") - grand, 2))
    total = F.sum("n")
    return some.agg(
        F.coalesce(total, F.lit(0)).cast("long").alias("n"), (F.sum(n * F.col("mean")) / F.sum(n)).alias("mean"),
        F.when(total > 1, F.sqrt(m2 / (total - 1))).alias("stddev"), F.max("high").alias("high"),
    )
