"""Registered queries: one per operator, each over the whole test tables.

Stations are derived from ``supplier`` and observations from ``events``
(``surfacewx.sources.fixtures``); text inputs (observation lines, catalogue
lines, file names) are rendered from those tables by Spark, so every query's
work grows with the tables. ``surfacewx.plans.oracle`` holds the DuckDB twin
of each query, with the same column names and types.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacewx.functions.format import station_label
from surfacewx.functions.keys import observation_key, station_key
from surfacewx.operators.joins import dimension_join, enrich, semi_join
from surfacewx.operators.partitioning import spread
from surfacewx.operators.outliers import find_outliers, threshold_table
from surfacewx.operators.radius import selected_ids, with_distance, within_radius
from surfacewx.operators.report import format_report, sort_report
from surfacewx.operators.sort import number_rows
from surfacewx.operators.stats import merge_partials, partial_stats, pooled_stats, pooled_stats_many
from surfacewx.operators.union import union_observations
from surfacewx.functions.sql import register_sql_functions
from surfacewx.plans.detect import detect, detect_files, detect_stats, outlier_report, pruned
from surfacewx.plans.ingest import read_observation_table
from surfacewx.plans.table import ingest_lines, merged_statistics, table_ingests, table_quarantine, table_statistics
from surfacewx.session import ensure_checkpoint_dir, materialize
from surfacewx.sinks.file import write_report_file
from surfacewx.schema import (
    DEFAULT_DELTA,
    DEFAULT_ELEVATION,
    DEFAULT_LATITUDE,
    DEFAULT_LONGITUDE,
    DEFAULT_RADIUS_M,
    MEASURE_NAMES,
    REPORT_FIELDS,
    STATION_COLUMNS,
)
from surfacewx.sources.fixtures import observations_from_events, station_count, stations_from_supplier, write_observation_files, write_station_csv
from surfacewx.sources.manifest import read_manifest_lines, write_manifest
from surfacewx.sources.observations import parse_observations, read_observation_lines, render_observation_lines
from surfacewx.sources.stations import dedupe_last, lookup_stations, parse_station_lines, read_stations, render_station_lines, station_text

Query = Callable[[SparkSession, str], DataFrame]

CENTRE = (DEFAULT_LATITUDE, DEFAULT_LONGITUDE, DEFAULT_ELEVATION)
UNKNOWN_ID = "999999-99999"
# Added to the station key of every 41st event: a station that the catalogue lacks.
UNKNOWN_STATION = 10_000_000


_TABLES: dict[tuple[str, str], DataFrame] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table's DataFrame, defined once per session (like a catalog
    table): file listing and footer reads happen once, not per query."""
    path = f"{d.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def _stations(spark: SparkSession, d: str) -> DataFrame:
    return stations_from_supplier(_table(spark, d, "supplier"))


def _obs(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    ev = events if events is not None else _table(spark, d, "events")
    return observations_from_events(ev, station_count(_table(spark, d, "supplier")))


def _obs_some_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Observations of which every 41st is of a station that the catalogue
    lacks, all with the station id that their own file would name."""
    k = F.when(F.col("event_id") % 41 == 5, F.col("k") + UNKNOWN_STATION).otherwise(F.col("k"))
    obs = _obs(spark, d).withColumn("k", k)
    return obs.withColumn("record_id", F.concat(F.format_string("%06d", F.lit(720000) + F.col("k")), F.lit("-00000")))


def _cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def _r(c: str | Column, digits: int) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits)


# ---------------------------------------------------------------- composite
def flagship_outliers(spark: SparkSession, d: str) -> DataFrame:
    """The whole job with the default centre, radius and delta."""
    return detect(
        _obs(spark, d), _stations(spark, d), *CENTRE, DEFAULT_RADIUS_M, DEFAULT_DELTA,
        obs_key="k", station_key="s_suppkey", tiebreak=["event_id"],
    )


# A second centre (Dallas), radius and delta for the whole job.
DALLAS = (32.776664, -96.796988, 139.0)
DALLAS_RADIUS_M = 300_000.0
DALLAS_DELTA = 2.0


def detect_dallas(spark: SparkSession, d: str) -> DataFrame:
    """C1 with other parameters: 300 km around Dallas, delta 2."""
    return detect(
        _obs(spark, d), _stations(spark, d), *DALLAS, DALLAS_RADIUS_M, DALLAS_DELTA,
        obs_key="k", station_key="s_suppkey", tiebreak=["event_id"], keep=["event_id"],
    )


def selected_stats(spark: SparkSession, d: str) -> DataFrame:
    """A1 over the selection used by C1."""
    s = detect_stats(_obs(spark, d), _stations(spark, d), *CENTRE, DEFAULT_RADIUS_M, obs_key="k", station_key="s_suppkey")
    return s.select("n", _r("mean", 6).alias("mean"), _r("stddev", 6).alias("stddev"))


def sorted_report(spark: SparkSession, d: str) -> DataFrame:
    """O1: the C1 report with each row's position in the order it comes in."""
    rows = detect(
        _obs(spark, d), _stations(spark, d), *CENTRE, DEFAULT_RADIUS_M, DEFAULT_DELTA,
        obs_key="k", station_key="s_suppkey", formatted=False, sort=False,
    )
    return format_report(number_rows(sort_report(rows, ["event_id"])), keep=["event_id", "position"])


# ---------------------------------------------------------------- scans
def _event_observation_id(k: Column, year: Column) -> Column:
    return F.concat(F.format_string("%06d", F.lit(720000) + k), F.lit("-99999-"), year.cast("string"))


def _rendered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Observation lines rendered from every event, with valid variations:
    blanks and tabs around the line, and an extra integer token."""
    events = spread(_table(spark, d, "events"), _cores(spark))  # text work is CPU-heavy: use every core
    obs = _obs(spark, d, events).withColumn("observation_id", _event_observation_id(F.col("k"), F.col("year")))
    obs = obs.withColumn("station_id", F.lit(None).cast("string"))
    lines = render_observation_lines(obs, keep=["event_id"])
    e = F.col("event_id")
    v = F.col("value")
    v = F.when(e % 5 == 1, F.concat(F.lit("  "), v, F.lit("\t "))).otherwise(v)
    v = F.when(e % 9 == 4, F.concat(v, F.lit(" 17"))).otherwise(v)
    return lines.withColumn("value", v).drop("station_id")


def _damaged_lines(spark: SparkSession, d: str) -> DataFrame:
    """As _rendered_lines, with every 7th event's line damaged: the last
    two tokens removed (even ids; an added extra token cannot mend it) or a
    non-integer token appended (odd ids)."""
    lines = _rendered_lines(spark, d)
    e = F.col("event_id")
    v = F.col("value")
    damaged = F.when(e % 2 == 0, F.regexp_replace(v, r"\s+\S+\s+\S+\s*$", "")).otherwise(F.concat(v, F.lit(" x")))
    return lines.withColumn("value", F.when(e % 7 == 0, damaged).otherwise(v))


_PARSED = ["event_id", "observation_id", "station_id", "year", "month", "day", "hour", *MEASURE_NAMES, "wind_speed_x10"]


def parse_observations_q(spark: SparkSession, d: str) -> DataFrame:
    """Rendered lines parsed back (FAILFAST)."""
    return parse_observations(_rendered_lines(spark, d), station_id_col=None, keep=["event_id"]).select(*_PARSED)


def parse_malformed_dropped(spark: SparkSession, d: str) -> DataFrame:
    """S2 DROPMALFORMED: damaged lines disappear."""
    return parse_observations(_damaged_lines(spark, d), station_id_col=None, mode="DROPMALFORMED", keep=["event_id"]).select(*_PARSED)


def parse_malformed_permissive(spark: SparkSession, d: str) -> DataFrame:
    """S2 PERMISSIVE: damaged lines kept with NULL fields and the raw text."""
    out = parse_observations(_damaged_lines(spark, d), station_id_col=None, mode="PERMISSIVE", keep=["event_id"])
    return out.select(*_PARSED, "_corrupt_record")


def parse_stations(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue rendered to quoted CSV lines, parsed back.
    Some names end in a backslash, some lines have a field too many."""
    k = F.col("s_suppkey")
    name = F.when(k % 6 == 2, F.concat("station_name", F.lit("\\"))).otherwise(F.col("station_name"))
    lines = render_station_lines(_stations(spark, d).withColumn("station_name", name), keep=["s_suppkey"])
    lines = lines.withColumn("value", F.when(k % 8 == 3, F.concat("value", F.lit(',"EXTRA"'))).otherwise(F.col("value")))
    return parse_station_lines(lines).select(*STATION_COLUMNS)


def _shared_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _station_files(spark: SparkSession, d: str) -> str:
    """The catalogue as CSV files; every third station also has an earlier line with another name."""
    s = _stations(spark, d).withColumn("line", F.lit(1))
    old = s.filter(F.col("s_suppkey") % 3 == 0).withColumns({"line": F.lit(0), "station_name": F.concat("station_name", F.lit(", \\"))})
    path = _shared_folder(spark)
    write_station_csv(station_text(s.unionByName(old), ["s_suppkey", "line"]), path, ["s_suppkey", "line"])
    return path


def _observation_files(spark: SparkSession, d: str) -> str:
    """Every event's line in the file of its station and year, a third of the
    files compressed. Beyond the default radius every 7th line is damaged."""
    st = _stations(spark, d)
    near = within_radius(st, *CENTRE, DEFAULT_RADIUS_M).select("s_suppkey", F.lit(True).alias("near"))
    names = dimension_join(st.select("s_suppkey", "station_id"), near, "s_suppkey", "s_suppkey", "left")
    obs = dimension_join(_obs(spark, d), materialize(names), "k", "s_suppkey")
    obs = obs.withColumn("observation_id", F.concat_ws("-", "station_id", F.col("year").cast("string")))
    lines = render_observation_lines(obs, keep=["event_id", "k", "near"])
    value = F.when(F.col("near").isNull() & (F.col("event_id") % 7 == 0), F.concat("value", F.lit(" x"))).otherwise(F.col("value"))
    path = _shared_folder(spark)
    write_observation_files(lines.select(F.concat("observation_id", F.when(F.col("k") % 3 == 0, ".gz").otherwise("")).alias("file_name"), value.alias("value")), path)
    return path


def station_scan(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue files read back, the later line winning."""
    return read_stations(spark, _station_files(spark, d)).select(*STATION_COLUMNS)


def observation_scan(spark: SparkSession, d: str) -> DataFrame:
    """Observation files read back, those of the selected stations
    only (FAILFAST: the others hold bad lines)."""
    ids = materialize(selected_ids(_stations(spark, d), *CENTRE, DEFAULT_RADIUS_M))
    lines = read_observation_lines(spark, _observation_files(spark, d))
    lines = semi_join(pruned(lines, ids, "station_id", "station_id"), ids, "station_id")
    return parse_observations(lines).select(*[c for c in _PARSED if c != "event_id"])


def detect_files_q(spark: SparkSession, d: str) -> DataFrame:
    """C1 over files: the whole job from observation files and catalogue files."""
    return detect_files(spark, _observation_files(spark, d), _station_files(spark, d))


def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    """As ``observation_scan``, the selected stations' files read by a manifest."""
    ids = materialize(selected_ids(_stations(spark, d), *CENTRE, DEFAULT_RADIUS_M))
    files = write_manifest(spark, _observation_files(spark, d), _shared_folder(spark))
    lines = read_manifest_lines(semi_join(pruned(files, ids, "station_id", "station_id"), ids, "station_id"))
    return parse_observations(lines).select(*[c for c in _PARSED if c != "event_id"])


def detect_manifest(spark: SparkSession, d: str) -> DataFrame:
    """C1 over files that a manifest names."""
    manifest, folder = _shared_folder(spark), _observation_files(spark, d)
    write_manifest(spark, folder, manifest)
    return detect_files(spark, folder, _station_files(spark, d), manifest=manifest)


def _file_names(spark: SparkSession, d: str) -> DataFrame:
    """One synthetic observation-file path per event: plain, .gz, .txt.gz,
    and a non-observation name."""
    obs = _obs(spark, d, spread(_table(spark, d, "events"), _cores(spark)))  # text work: use every core
    e = F.col("event_id")
    base = F.concat(F.format_string("%06d", F.lit(720000) + F.col("k")), F.lit("-99999-"), F.col("year").cast("string"))
    suffix = F.when(e % 3 == 0, F.lit(".gz")).when(e % 3 == 1, F.lit("")).otherwise(F.lit(".txt.gz"))
    name = F.when(e % 10 == 9, F.lit("README")).otherwise(F.concat(base, suffix))
    path = F.concat(F.lit("/data/isd-lite/"), F.col("year").cast("string"), F.lit("/"), name)
    return obs.select("event_id", path.alias("path"))


def observation_key_q(spark: SparkSession, d: str) -> DataFrame:
    """File path -> observation id."""
    return _file_names(spark, d).select("event_id", "path", observation_key("path").alias("observation_id"))


def station_key_q(spark: SparkSession, d: str) -> DataFrame:
    """Observation id -> station id (NULL without a '-')."""
    f = _file_names(spark, d).select("event_id", observation_key("path").alias("observation_id"))
    return f.select("event_id", "observation_id", station_key("observation_id").alias("station_id"))


def stations_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """A3: duplicate catalogue lines, the later line wins."""
    s = _stations(spark, d).select("station_id", "station_name", "s_suppkey")
    k = F.col("s_suppkey")
    first = s.select("station_id", "station_name", (k * 2).alias("line_no"))
    dup = s.filter(k % 3 != 2).select(
        "station_id",
        F.concat(F.col("station_name"), F.lit(" (moved)")).alias("station_name"),
        F.when(k % 3 == 0, k * 2 + 1).otherwise(k * 2 - 1).alias("line_no"),
    )
    return dedupe_last(first.unionByName(dup), "station_id", "line_no")


def station_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Point lookup of the first three stations' ids and of an unknown one."""
    first = _stations(spark, d).orderBy("s_suppkey").limit(3).select("station_id").collect()
    return lookup_stations(_stations(spark, d), [r.station_id for r in first] + [UNKNOWN_ID]).select(*STATION_COLUMNS)


def station_label_q(spark: SparkSession, d: str) -> DataFrame:
    """One-line text of each station."""
    return _stations(spark, d).select("station_id", station_label().alias("label"))


# ---------------------------------------------------------------- geo
def distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of every station from the centre, in metres."""
    s = with_distance(_stations(spark, d), *CENTRE)
    return s.select("station_id", _r("distance_m", 3).alias("distance_m"))


def within_radius_q(spark: SparkSession, d: str) -> DataFrame:
    """F1 F2: the stations within the default radius."""
    s = within_radius(_stations(spark, d), *CENTRE, DEFAULT_RADIUS_M)
    return s.select("station_id", _r("distance_m", 3).alias("distance_m"))


def _any_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Stations of which a quarter each are stored a full turn east or over the pole: the same places."""
    k, lat, lon = F.col("s_suppkey"), F.col("latitude"), F.col("longitude")
    return _stations(spark, d).withColumns({
        "latitude": F.when(k % 4 == 2, F.lit(180.0) - lat).otherwise(lat),
        "longitude": F.when(k % 4 == 1, lon + 360.0).when(k % 4 == 2, lon + 180.0).otherwise(lon),
    })


def within_radius_any_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """F2 over stored coordinates beyond [-90, 90] and [-180, 180]."""
    s = within_radius(_any_coordinates(spark, d), *CENTRE, DEFAULT_RADIUS_M)
    return s.select("station_id", "latitude", "longitude", _r("distance_m", 3).alias("distance_m"))


def selected_ids_q(spark: SparkSession, d: str) -> DataFrame:
    """A4: distinct ids of the stations within the radius, from a catalogue with repeated lines."""
    s = _stations(spark, d)
    return selected_ids(s.unionByName(s.filter(F.col("s_suppkey") % 3 == 0)), *CENTRE, DEFAULT_RADIUS_M)


def semi_join_stations(spark: SparkSession, d: str) -> DataFrame:
    """Observations of the selected stations."""
    sel = materialize(within_radius(_stations(spark, d), *CENTRE, DEFAULT_RADIUS_M).select("s_suppkey"))
    return semi_join(_obs(spark, d), sel, "k", "s_suppkey").select("event_id", "k", "wind_speed")


def semi_join_prefiltered(spark: SparkSession, d: str) -> DataFrame:
    """The same above the broadcast bound: observations pass a Bloom filter
    of the selection, then join it by shuffle."""
    sel = materialize(within_radius(_stations(spark, d), *CENTRE, DEFAULT_RADIUS_M).select("s_suppkey"))
    return semi_join(_obs(spark, d), sel, "k", "s_suppkey", max_bytes=0, prefiltered=True).select("event_id", "k", "wind_speed")


# ---------------------------------------------------------------- stats
def pooled_stats_q(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean, sample stddev of wind speed over all observations."""
    s = pooled_stats(_obs(spark, d), "wind_speed")
    return s.select("n", _r("mean", 6).alias("mean"), _r("stddev", 6).alias("stddev"))


def measure_stats(spark: SparkSession, d: str) -> DataFrame:
    """The same statistics for each of the 8 measures (one pass)."""
    s = pooled_stats_many(_obs(spark, d), MEASURE_NAMES)
    return s.select("measure", "n", _r("mean", 6).alias("mean"), _r("stddev", 6).alias("stddev"))


def partial_stats_q(spark: SparkSession, d: str) -> DataFrame:
    """A2: mergeable partials per station key and year."""
    p = partial_stats(_obs(spark, d), "wind_speed", ["k", "year"])
    return p.select("k", "year", "n", _r("mean", 6).alias("mean"), _r("m2", 4).alias("m2"))


def partial_stats_merged(spark: SparkSession, d: str) -> DataFrame:
    """A2: partials per station key and year, rolled up = pooled statistics."""
    m = merge_partials(partial_stats(_obs(spark, d), "wind_speed", ["k", "year"]))
    return m.select("n", _r("mean", 6).alias("mean"), _r("stddev", 6).alias("stddev"))


def threshold_q(spark: SparkSession, d: str) -> DataFrame:
    """A5: threshold for delta 1, 2 and 3."""
    t = threshold_table(_obs(spark, d), "wind_speed", (1.0, 2.0, 3.0))
    return t.select("delta", _r("threshold", 6).alias("threshold"))


def find_outliers_q(spark: SparkSession, d: str) -> DataFrame:
    """Observations above mean + 3 stddev of all observations."""
    return find_outliers(_obs(spark, d), "wind_speed", 3.0).select("event_id", "k", "wind_speed")


def find_outliers_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """F5 J3 on another table and measure: line items above mean + 1 stddev of price."""
    li = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return find_outliers(li, "l_extendedprice", 1.0)


# ---------------------------------------------------------------- union / join / report
def union_observations_q(spark: SparkSession, d: str) -> DataFrame:
    """Bag union, from the empty relation, of inputs that are stored
    apart (readings from ``events`` and from ``orders``), one of them given
    twice, so that its rows count twice."""
    events = _obs(spark, d).select(F.col("event_id").alias("id"), "year", "month", "day", "hour", "wind_speed")
    at = F.col("o_orderdate")
    orders = _table(spark, d, "orders").select(
        F.col("o_orderkey").cast("long").alias("id"), F.year(at).alias("year"), F.month(at).alias("month"), F.dayofmonth(at).alias("day"),
        F.lit(0).alias("hour"), F.col("o_totalprice").cast("double").alias("wind_speed"),
    )
    return union_observations(events, orders, orders)


def enrich_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Outliers of all observations, left-joined with the selected stations
    (outliers of other stations, and of stations that the catalogue lacks,
    keep their own id and NULL metadata)."""
    sel = materialize(
        within_radius(_stations(spark, d), *CENTRE, DEFAULT_RADIUS_M).select(
            "s_suppkey", "station_id", "station_name", "latitude", "longitude", "elevation"
        )
    )
    out = find_outliers(_obs_some_unknown(spark, d), "wind_speed", 3.0).select("event_id", "k", "record_id", "wind_speed")
    return enrich(out, sel, "k", "s_suppkey").select(
        "event_id", "k", "record_id", "wind_speed", "station_id", "station_name", "latitude", "longitude", "elevation"
    )


def format_report_q(spark: SparkSession, d: str) -> DataFrame:
    """Outliers of all observations with their station, as report text."""
    obs = _obs(spark, d)
    out = find_outliers(obs, "wind_speed", 3.0)
    st = _stations(spark, d).select("s_suppkey", "station_id", "station_name", "country", "state", "latitude", "longitude", "elevation")
    rows = dimension_join(out, st, "k", "s_suppkey", "left")
    return format_report(rows, keep=["event_id"]).select(*REPORT_FIELDS, "event_id")


def outlier_report_q(spark: SparkSession, d: str) -> DataFrame:
    """K3 body: outliers of all given observations (no radius), sorted, with
    a left lookup of their stations, as report text. A record keeps its own
    id, also where the catalogue lacks the station."""
    return outlier_report(
        _obs_some_unknown(spark, d).withColumnRenamed("record_id", "station_id"), _stations(spark, d), DEFAULT_DELTA, obs_key="k", station_key="s_suppkey",
        tiebreak=["event_id"], keep=["event_id"],
    )


# ---------------------------------------------------------------- ingested table, report file, SQL functions
def _ingested(spark: SparkSession, d: str) -> str:
    """A table of two batches of observation lines; the second is first
    ingested with half of its lines only, then replaced."""
    names = materialize(_stations(spark, d).select("s_suppkey", "station_id"))
    obs = dimension_join(_obs(spark, d, spread(_table(spark, d, "events"), _cores(spark))), names, "k", "s_suppkey")
    obs = obs.withColumn("observation_id", F.concat_ws("-", "station_id", F.col("year").cast("string")))
    lines = materialize(render_observation_lines(obs, keep=["event_id"]))
    path = _shared_folder(spark)
    ingest_lines(lines.filter("event_id % 2 = 0"), path, "even")
    ingest_lines(lines.filter("event_id % 4 = 1"), path, "odd")
    ingest_lines(lines.filter("event_id % 2 = 1"), path, "odd")
    return path


def ingested_stats(spark: SparkSession, d: str) -> DataFrame:
    """A1 A2 over the selection, from the statistics kept with the table."""
    sel = selected_ids(_stations(spark, d), *CENTRE, DEFAULT_RADIUS_M)
    s = merged_statistics(table_statistics(spark, _ingested(spark, d)), "wind_speed", sel)
    return s.select("n", _r("mean", 6).alias("mean"), _r("stddev", 6).alias("stddev"), "high")


def ingested_detect(spark: SparkSession, d: str) -> DataFrame:
    """C1 over the ingested table, its threshold from the kept statistics."""
    path = _ingested(spark, d)
    return detect(read_observation_table(spark, path), _stations(spark, d), *CENTRE, DEFAULT_RADIUS_M, DEFAULT_DELTA, statistics=table_statistics(spark, path))


def _accounted(spark: SparkSession, d: str) -> str:
    """A table of damaged lines: a batch whose bad lines are kept, one whose bad lines are dropped."""
    lines = _damaged_lines(spark, d).withColumn("station_id", station_key("observation_id"))
    path = _shared_folder(spark)
    ingest_lines(lines.filter("event_id % 2 = 0"), path, "kept", "PERMISSIVE")
    ingest_lines(lines.filter("event_id % 2 = 1"), path, "dropped", "DROPMALFORMED")
    return path


def ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines read and bad lines of each batch, with the rows the table has of it."""
    path = _accounted(spark, d)
    rows = spark.read.parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"))
    return table_ingests(spark, path).join(rows, "batch", "left").select("batch", "lines", "bad", "n_rows")


def ingest_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """S2 PERMISSIVE: the bad lines of the batch that keeps them, as text."""
    return table_quarantine(spark, _accounted(spark, d)).select("batch", "observation_id", "station_id", "line")


def report_file(spark: SparkSession, d: str) -> DataFrame:
    """K1: the C1 report written as one file at an exact path and read back."""
    path = f"{_shared_folder(spark)}/results.txt"
    write_report_file(flagship_outliers(spark, d), path)
    read = spark.read.option("header", True).csv(path).toDF(*REPORT_FIELDS)
    return read.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in REPORT_FIELDS])


def sql_distance(spark: SparkSession, d: str) -> DataFrame:
    """X1 X2 from SQL text alone."""
    register_sql_functions(spark)
    lat, lon, elev = CENTRE
    stations = _stations(spark, d)
    return spark.sql(
        f"SELECT station_id, round(weather_distance_m({lat}D, {lon}D, {elev}D, latitude, longitude, elevation), 3) AS distance_m FROM {{stations}}",
        stations=stations,
    )


def sql_keys(spark: SparkSession, d: str) -> DataFrame:
    """X5 X12 X13 from SQL text alone: the keys of file names."""
    register_sql_functions(spark)
    return spark.sql(
        "SELECT event_id, observation_key(path) AS observation_id, station_key(observation_key(path)) AS station_id, round_half_up_x10(event_id / 16.0D) AS tenths FROM {files}",
        files=_file_names(spark, d),
    )


QUERIES: dict[str, Query] = {
    "flagship_outliers": flagship_outliers,
    "detect_dallas": detect_dallas,
    "selected_stats": selected_stats,
    "sorted_report": sorted_report,
    "parse_observations": parse_observations_q,
    "parse_malformed_dropped": parse_malformed_dropped,
    "parse_malformed_permissive": parse_malformed_permissive,
    "parse_stations": parse_stations,
    "station_scan": station_scan,
    "observation_scan": observation_scan,
    "detect_files": detect_files_q,
    "manifest_scan": manifest_scan,
    "detect_manifest": detect_manifest,
    "observation_key": observation_key_q,
    "station_key": station_key_q,
    "stations_last_wins": stations_last_wins,
    "station_lookup": station_lookup,
    "station_label": station_label_q,
    "distance": distance,
    "within_radius": within_radius_q,
    "within_radius_any_coordinates": within_radius_any_coordinates,
    "selected_ids": selected_ids_q,
    "semi_join_stations": semi_join_stations,
    "semi_join_prefiltered": semi_join_prefiltered,
    "pooled_stats": pooled_stats_q,
    "measure_stats": measure_stats,
    "partial_stats": partial_stats_q,
    "partial_stats_merged": partial_stats_merged,
    "threshold": threshold_q,
    "find_outliers": find_outliers_q,
    "find_outliers_lineitem": find_outliers_lineitem,
    "union_observations": union_observations_q,
    "enrich_outliers": enrich_outliers,
    "format_report": format_report_q,
    "outlier_report": outlier_report_q,
    "ingested_stats": ingested_stats,
    "ingested_detect": ingested_detect,
    "ingest_counts": ingest_counts,
    "ingest_quarantine": ingest_quarantine,
    "report_file": report_file,
    "sql_distance": sql_distance,
    "sql_keys": sql_keys,
}

