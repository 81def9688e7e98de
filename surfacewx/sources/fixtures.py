"""Stations and observations derived from the driver's test tables.

``supplier`` plays the station catalogue and ``events`` the hourly
observations (``user_id`` modulo the number of suppliers picks the station).
Every formula here has a line-for-line twin in the DuckDB oracle
(``surfacewx.plans.oracle``); NULL patterns are there on purpose so that the
sentinel, empty-field and missing-coordinate paths are all exercised.

The formulas are SQL expressions (``selectExpr``): each column is parsed on
the JVM in one call.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfacewx.functions.decode import scaled_or_null, sentinel_or_null
from surfacewx.schema import MEASURES
from surfacewx.sources.files import place

_USAF = "format_string('%06d', 720000 + s_suppkey)"
_WBAN = "format_string('%05d', s_nationkey)"

STATION_EXPRS = [
    f"concat_ws('-', {_USAF}, {_WBAN}) AS station_id",
    f"{_USAF} AS usaf",
    f"{_WBAN} AS wban",
    "s_name AS station_name",
    "CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE 'US' END AS country",
    "CASE WHEN s_suppkey % 7 = 6 THEN NULL ELSE 'TX' END AS state",
    "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE format_string('K%03d', s_suppkey % 1000) END AS icao",
    "CASE WHEN s_suppkey % 17 = 16 THEN NULL ELSE CAST(25000 + (s_suppkey * 7919) % 10000 AS DOUBLE) / 1000 END AS latitude",
    "CAST(-100000 + (s_suppkey * 6113) % 10000 AS DOUBLE) / 1000 AS longitude",
    "CASE WHEN s_suppkey % 11 = 10 THEN NULL ELSE CAST((s_suppkey * 131) % 5000 AS DOUBLE) / 10 END AS elevation",
    "make_date(CAST(1970 + s_suppkey % 40 AS INT), CAST(1 + s_suppkey % 12 AS INT), CAST(1 + s_suppkey % 28 AS INT)) AS begin",
    "DATE'2018-05-01' AS end",
    "s_suppkey",
]

# Raw (line-token) values of the 8 measures, -9999 where absent.
RAW_MEASURE_EXPRS = [
    "CASE WHEN event_id % 17 = 3 THEN -9999 ELSE CAST((user_id * 7 + event_id) % 400 - 100 AS INT) END AS air_temperature_raw",
    "CASE WHEN event_id % 19 = 5 THEN -9999 ELSE CAST((event_id * 3) % 300 - 50 AS INT) END AS dew_point_temperature_raw",
    "CASE WHEN event_id % 23 = 7 THEN -9999 ELSE CAST((event_id * 11) % 600 + 9800 AS INT) END AS sea_level_pressure_raw",
    "CASE WHEN event_id % 29 = 11 THEN -9999 ELSE CAST((event_id * 37) % 360 AS INT) END AS wind_direction_raw",
    "CASE WHEN event_id % 13 = 0 THEN -9999 ELSE CAST(floor(value * 10) AS INT) END AS wind_speed_raw",
    "CASE WHEN event_id % 31 = 13 THEN -9999 ELSE CAST(event_id % 20 AS INT) END AS total_cloud_cover_raw",
    "CASE WHEN event_id % 7 = 1 THEN -1 WHEN event_id % 3 = 0 THEN -9999 "
    "ELSE CAST((event_id * 5) % 120 AS INT) END AS one_hour_precipitation_raw",
    "CASE WHEN event_id % 11 = 2 THEN -1 WHEN event_id % 4 = 0 THEN -9999 "
    "ELSE CAST((event_id * 13) % 400 AS INT) END AS six_hour_precipitation_raw",
]


def stations_from_supplier(supplier: DataFrame) -> DataFrame:
    """STATION_SCHEMA rows (plus ``s_suppkey``), one per supplier."""
    return supplier.selectExpr(*STATION_EXPRS)


def station_count(supplier: DataFrame) -> Column:
    """Number of stations as a scalar subquery (stays inside the plan)."""
    return supplier.agg(F.count(F.lit(1))).scalar()


def observation_raw_from_events(events: DataFrame, n_stations: Column) -> DataFrame:
    """Undecoded observations: event_id, k (station key), time, 8 raw ints."""
    return events.select(
        "event_id",
        (F.col("user_id") % n_stations).alias("k"),
        F.expr("CAST(year(ts) AS INT) AS year"),
        F.expr("CAST(month(ts) AS INT) AS month"),
        F.expr("CAST(day(ts) AS INT) AS day"),
        F.expr("CAST(hour(ts) AS INT) AS hour"),
        *[F.expr(e) for e in RAW_MEASURE_EXPRS],
    )


def observations_from_events(events: DataFrame, n_stations: Column) -> DataFrame:
    """Decoded observations keyed by ``k`` (= ``s_suppkey`` of a station).

    Columns: event_id, k, year, month, day, hour, the 8 measures and
    wind_speed_x10. The station and observation ids come from the station
    side once the two are joined.
    """
    raw = observation_raw_from_events(events, n_stations)
    cols = [F.col(c) for c in ("event_id", "k", "year", "month", "day", "hour")]
    for name, kind in MEASURES:
        r = F.col(name + "_raw")
        cols.append((scaled_or_null(r) if kind == "double" else sentinel_or_null(r)).alias(name))
        if name == "wind_speed":
            cols.append(sentinel_or_null(r).alias("wind_speed_x10"))
    return raw.select(*cols)


def write_station_csv(text: DataFrame, path: str, order: list[str]) -> None:
    """Rows of ``station_text`` as catalogue files with a header, every field
    in quotes, lines in the ``order`` columns' order over all files."""
    rows = text.orderBy(*order).drop(*order)
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_observation_files(lines: DataFrame, folder: str) -> None:
    """``lines(file_name, value)`` as one text file per name (gzip where it
    ends in ``.gz``) in ``folder``, a place that all executors share.

    A file's lines are dealt to one task, which streams them, all that a batch
    has of a file at once. It appears under its name when complete, so a task
    that runs again finds or replaces it. Until then it is in a folder of the
    task's own: tasks that create files in one folder wait for one another.
    The number of tasks is the session's number of shuffle partitions: by
    their bytes adaptive execution would leave too few for the cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = place(folder)
        own = f"{base}/_{uuid.uuid4().hex}"  # Spark does not read names with an underscore in front
        files.create_dir(own, recursive=True)
        name = out = None

        def close() -> None:
            if out is not None:
                out.close()
                if files.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
                    files.move(f"{own}/{name}", f"{base}/{name}")

        for b in batches:
            if not b.num_rows:
                continue
            runs = pc.run_end_encode(b.column(0))
            text = pc.binary_join_element_wise(pc.fill_null(b.column(1), "None"), "", "\n")  # each line with its end
            ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)
            data, start = memoryview(text.buffers()[2]), 0
            for next_name, last in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if next_name != name:
                    close()
                    name = next_name
                    out = files.open_output_stream(f"{own}/{name}")
                end = int(ends[last - 1])
                out.write(data[start:end])
                start = end
        close()
        files.delete_dir(own)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["file_name"])

    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.select("file_name", "value").repartition(tasks, "file_name").sortWithinPartitions("file_name")
    rows.mapInArrow(run, "file_name string").write.format("noop").mode("overwrite").save()
