"""The user-level job: stations near a point -> pooled threshold -> outlier report.

The selected stations (checkpointed once) are joined, size-checked broadcast,
to the observations, which are filtered by the selection's key range first;
the pooled statistics are a scalar subquery; the outliers are filtered
against it, sorted by a range exchange and formatted. Nothing runs over the
observations until the report is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacewx.operators.joins import dimension_join, enrich, semi_join
from surfacewx.operators.outliers import find_outliers
from surfacewx.operators.radius import selected_ids, within_radius
from surfacewx.operators.report import format_report, sort_report
from surfacewx.operators.stats import pooled_stats
from surfacewx.plans.table import _delete, merged_statistics
from surfacewx.schema import (
    DEFAULT_DELTA,
    DEFAULT_ELEVATION,
    DEFAULT_LATITUDE,
    DEFAULT_LONGITUDE,
    DEFAULT_RADIUS_M,
    REPORT_SORT_KEYS,
)
from surfacewx.session import ensure_checkpoint_dir
from surfacewx.sources.manifest import read_manifest, read_manifest_lines
from surfacewx.sources.observations import parse_observations, read_observation_lines
from surfacewx.sources.stations import read_stations

# Up to this many selected stations their ids are also given to the scan as
# literals. Only a hint: the joins with the selection filter in any case.
MAX_PRUNING_IDS = 10_000


def pruned(obs: DataFrame, selection: DataFrame, obs_key: str, station_key: str) -> DataFrame:
    """``obs`` within the selection's key range, and with few stations among
    its ids: literal filters that a scan can skip files and row groups by.
    They are implied by the join with the selection, which stays."""
    n, low, high = selection.agg(F.count(F.lit(1)), F.min(station_key), F.max(station_key)).first()
    if low is None:
        return obs.limit(0)
    obs = obs.filter(F.col(obs_key).between(F.lit(low), F.lit(high)))
    if n <= MAX_PRUNING_IDS:
        obs = obs.filter(F.col(obs_key).isin(sorted({r[0] for r in selection.select(station_key).collect() if r[0] is not None})))
    return obs


def selected_observations(
    obs: DataFrame,
    stations: DataFrame,
    latitude: float = DEFAULT_LATITUDE,
    longitude: float = DEFAULT_LONGITUDE,
    elevation: float = DEFAULT_ELEVATION,
    radius_m: float = DEFAULT_RADIUS_M,
    obs_key: str = "station_id",
    station_key: str = "station_id",
    station_columns: list[str] | None = None,
    materialize_selection: bool = True,
    prune: bool | None = None,
) -> DataFrame:
    """Observations of the stations within the radius, with station metadata.

    The selection is small and read three times (size check, the statistics
    join, the report join), so by default it is checkpointed once. That also
    keeps the optimizer from copying the radius predicate onto the
    observation side when station coordinates are functions of the join key
    (it would then compute a distance per observation).

    With ``prune`` the selection's key range, and few ids, are also literal
    filters on the observations, which costs two small jobs and pays where a
    scan can skip by a stored key. By default that is taken to be so for the
    key ``station_id`` (the ingested table's), not for others, which may be
    computed.

    ``observation_id`` is derived as ``station_id-year`` when the input has
    none (observations that do not come from files).
    """
    sel = within_radius(stations, latitude, longitude, elevation, radius_m)
    if station_columns is not None:
        sel = sel.select(*dict.fromkeys([station_key, *station_columns]))
    if materialize_selection:
        from surfacewx.session import materialize

        sel = materialize(sel)
    narrow = [c for c in ("month", "day", "hour", "event_id") if c in obs.columns]
    if prune if prune is not None else obs_key == "station_id":
        obs = pruned(obs, sel, obs_key, station_key)
    joined = dimension_join(obs, sel, obs_key, station_key, "inner", salt_cols=narrow or None)
    if "observation_id" not in joined.columns:
        joined = joined.withColumn(
            "observation_id", F.concat_ws("-", F.col("station_id"), F.col("year").cast("string"))
        )
    return joined


def detect(
    obs: DataFrame,
    stations: DataFrame,
    latitude: float = DEFAULT_LATITUDE,
    longitude: float = DEFAULT_LONGITUDE,
    elevation: float = DEFAULT_ELEVATION,
    radius_m: float = DEFAULT_RADIUS_M,
    delta: float = DEFAULT_DELTA,
    value_col: str = "wind_speed",
    obs_key: str = "station_id",
    station_key: str = "station_id",
    tiebreak: list[str] | tuple = (),
    keep: list[str] | tuple = (),
    formatted: bool = True,
    sort: bool = True,
    materialize: bool = False,
    statistics: DataFrame | None = None,
    prune: bool | None = None,
) -> DataFrame:
    """Report of the observations strictly above mean + delta * stddev.

    Statistics are pooled over every observation of the stations within
    ``radius_m`` metres of the centre (inclusive). The result is sorted by
    year, month, day, hour, observation id, then ``tiebreak`` (unless
    ``sort`` is off); with ``formatted`` it has the 12 report text columns
    (plus ``keep``), otherwise the joined rows.

    The observations are read for the statistics, by the sort's sampling job
    and for the rows. On an ingested table the last two are scans with the
    threshold pushed down. With ``materialize`` the outlier rows are
    checkpointed before the sort (see ``materialize_outliers``), which spares
    the sampling job's read: worth it on raw text.

    ``statistics``: the partials kept with an ingested table
    (``surfacewx.plans.table.table_statistics``). The threshold is then merged
    from those of the selected stations, a row per station and year, and the
    observations are not read for it.
    """
    cols = ["station_id", "station_name", "country", "state", "latitude", "longitude", "elevation"]
    joined = selected_observations(
        obs, stations, latitude, longitude, elevation, radius_m, obs_key, station_key, station_columns=cols, prune=prune
    )
    if statistics is None:
        out = find_outliers(joined, value_col, delta)
    else:
        sel = selected_ids(stations, latitude, longitude, elevation, radius_m)
        pooled = merged_statistics(statistics, value_col, sel)
        out = joined.filter(F.col(value_col) > pooled.select(F.col("mean") + F.lit(float(delta)) * F.col("stddev")).scalar())
    return _finish(out, value_col, tiebreak, keep, formatted, sort, materialize)


def materialize_outliers(out: DataFrame) -> DataFrame:
    """Checkpoint outlier rows (to the session's checkpoint directory).

    A global sort samples its input in a separate job before shuffling it,
    and that job re-runs the whole upstream plan: a full extra scan of the
    observations. Writing the outliers spares it and fixes the rows for any
    task that is retried later. It pays where reading is dear (raw text) and
    outliers are few, as they are for a delta of 1 or more (at most
    1 / (1 + delta^2) of the rows); for a low or negative delta it would
    write most of the input.
    """
    from surfacewx.session import materialize

    return materialize(out)


def _finish(out: DataFrame, value_col: str, tiebreak, keep, formatted: bool, sort: bool, materialize: bool) -> DataFrame:
    if materialize:
        out = materialize_outliers(out)
    if sort:
        out = sort_report(out, tiebreak)
    return format_report(out, value_col, keep=list(keep)) if formatted else out


def outlier_report(
    obs: DataFrame,
    stations: DataFrame,
    delta: float = DEFAULT_DELTA,
    value_col: str = "wind_speed",
    obs_key: str = "station_id",
    station_key: str = "station_id",
    tiebreak: list[str] | tuple = (),
    keep: list[str] | tuple = (),
    formatted: bool = True,
    sort: bool = True,
    materialize: bool = False,
) -> DataFrame:
    """Report of the observations of ``obs`` above mean + delta * stddev,
    pooled over all of ``obs`` (no radius: the caller chose the inputs).

    Station metadata is looked up for the outliers only (left join: a reading
    whose station is unknown is kept, its metadata blank). Sorted, formatted
    and materialized like ``detect``.
    """
    meta = ["station_id", "station_name", "country", "state", "latitude", "longitude", "elevation"]
    own = "station_id" in obs.columns  # the record's own id, known whether the station is or not
    st = stations.select(*dict.fromkeys([station_key, *(c for c in meta if not (own and c == "station_id" != station_key))]))
    out = enrich(find_outliers(obs, value_col, delta), st, obs_key, station_key)
    if not own:
        out = out.withColumn("station_id", F.coalesce(F.col("station_id"), F.col(obs_key).cast("string")))
    if "observation_id" not in out.columns:
        out = out.withColumn("observation_id", F.concat_ws("-", F.col("station_id"), F.col("year").cast("string")))
    return _finish(out, value_col, tiebreak, keep, formatted, sort, materialize)


def detect_stats(
    obs: DataFrame,
    stations: DataFrame,
    latitude: float = DEFAULT_LATITUDE,
    longitude: float = DEFAULT_LONGITUDE,
    elevation: float = DEFAULT_ELEVATION,
    radius_m: float = DEFAULT_RADIUS_M,
    value_col: str = "wind_speed",
    obs_key: str = "station_id",
    station_key: str = "station_id",
) -> DataFrame:
    """The pooled statistics ``detect`` thresholds on (one row)."""
    joined = selected_observations(
        obs, stations, latitude, longitude, elevation, radius_m, obs_key, station_key, station_columns=["station_id"]
    )
    return pooled_stats(joined, value_col)


@contextmanager
def parsed_once(obs: DataFrame) -> Iterator[DataFrame]:
    """``obs`` as Parquet in the checkpoint directory, for the time of the
    block: what computes it runs once, however often the block reads it.

    A scan of many small files has a task for every 32 of them or so. They are
    put together, without a shuffle, so that the parts are fewer than the files.
    """
    spark = obs.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = f"{ensure_checkpoint_dir(spark)}/parsed-{uuid.uuid4().hex}"
    try:
        obs.coalesce(tasks).write.parquet(path)
        yield spark.read.schema(obs.schema).parquet(path)
    finally:
        _delete(spark, path)


def detect_files(
    spark: SparkSession,
    observations_path: str | list[str],
    stations_path: str | list[str],
    output: str | None = None,
    latitude: float = DEFAULT_LATITUDE,
    longitude: float = DEFAULT_LONGITUDE,
    elevation: float = DEFAULT_ELEVATION,
    radius_m: float = DEFAULT_RADIUS_M,
    delta: float = DEFAULT_DELTA,
    value_col: str = "wind_speed",
    mode: str = "FAILFAST",
    single_file: bool = True,
    persist: bool = False,
    partitions: int | None = None,
    manifest: str | None = None,
) -> DataFrame:
    """``detect`` on raw observation files and a station CSV; writes the CSV
    report to ``output`` when given and returns the report DataFrame.

    Lines are joined with the selection by their file's name before they are
    parsed, so a bad line matters only in a selected station's file, however
    many are selected. With few, their ids are also literals, and the scan
    opens no other file.

    With ``manifest``, the path of a table that ``write_manifest`` made, the
    files are those of its rows, packed into tasks by size, and
    ``observations_path`` is not read or listed.

    The statistics and the outlier filter each read the observations. The
    text is opened and parsed once all the same: the columns that the report
    needs are written as Parquet to the checkpoint directory, read from there
    and deleted when the outliers are found. ``persist`` keeps the parsed
    observations instead (memory, spilling to disk; recomputed from the files
    if an executor is lost). It is released after writing when ``output`` is
    given. For repeated runs, ingest to Parquet instead.
    """
    stations = read_stations(spark, stations_path, mode=mode)
    ids = materialize_outliers(selected_ids(stations, latitude, longitude, elevation, radius_m))
    if manifest is not None:
        files = pruned(read_manifest(spark, manifest), ids, "station_id", "station_id")
        lines = read_manifest_lines(semi_join(files, ids, "station_id"))
    else:
        lines = read_observation_lines(spark, observations_path, partitions=partitions)
        lines = semi_join(pruned(lines, ids, "station_id", "station_id"), ids, "station_id")
    obs = parse_observations(lines, mode=mode)

    def report_of(parsed: DataFrame) -> DataFrame:
        return detect(parsed, stations, latitude, longitude, elevation, radius_m, delta, value_col, materialize=True, prune=False)

    if persist:
        from pyspark import StorageLevel

        obs = obs.persist(StorageLevel.MEMORY_AND_DISK)
        report = report_of(obs)
    else:
        with parsed_once(obs.select(*dict.fromkeys([*REPORT_SORT_KEYS, "station_id", value_col, "wind_speed_x10"]))) as parsed:
            report = report_of(parsed)
    if output is not None:
        from surfacewx.sinks.csv import write_report_csv

        write_report_csv(report, output, single_file=single_file, value_col=value_col)
        if persist:
            obs.unpersist()
    return report


__all__ = ["detect", "detect_stats", "detect_files", "materialize_outliers", "outlier_report", "selected_observations"]
