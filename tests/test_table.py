"""The ingested table with its books, the report file and the SQL functions."""

from __future__ import annotations

import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from surfacewx.functions.geo import distance_m
from surfacewx.functions.keys import observation_key, station_key
from surfacewx.functions.sql import register_sql_functions
from surfacewx.plans import table as books
from surfacewx.plans.detect import detect
from surfacewx.plans.ingest import read_observation_table
from surfacewx.plans.registry import flagship_outliers
from surfacewx.schema import REPORT_COLUMNS, REPORT_FIELDS
from surfacewx.sinks.file import write_report_file

LINE = "value string, observation_id string, station_id string"


def _line(station: int, hour: int, wind: int) -> tuple[str, str, str]:
    sid = f"{station:06d}-00001"
    return f"2008 01 01 {hour:02d} 1 2 3 4 {wind} 5 6 7", f"{sid}-2008", sid


def _lines(seed: int, n: int, bad: int = 0) -> list[tuple[str, str, str]]:
    rnd = random.Random(seed)
    out = [_line(rnd.randrange(20), k % 24, rnd.choice([-9999, rnd.randrange(0, 300)])) for k in range(n)]
    return out + [(f"torn {k}", "000001-00001-2008", "000001-00001") for k in range(bad)]


def _winds(lines):
    return [int(v.split()[8]) / 10 for v, _, _ in lines if not v.startswith("torn") and v.split()[8] != "-9999"]


def _check(spark, path, lines):
    got = books.merged_statistics(books.table_statistics(spark, path), "wind_speed").first()
    winds = _winds(lines)
    assert got.n == len(winds) and got.high == max(winds)
    assert math.isclose(got["mean"], statistics.fmean(winds), rel_tol=1e-12) and math.isclose(got["stddev"], statistics.stdev(winds), rel_tol=1e-12)
    assert books.statistics_match(spark, path)
    assert spark.read.parquet(path).count() == sum(not v.startswith("torn") for v, _, _ in lines)


def test_a_replaced_batch_replaces_its_statistics_counts_and_bad_lines(spark, tmp_path):
    path = str(tmp_path / "table")
    first, wrong, second = _lines(1, 300), _lines(2, 90, bad=4), _lines(3, 200, bad=7)
    frame = lambda rows: spark.createDataFrame(rows, LINE)
    assert books.ingest_lines(frame(first), path, "a") == {"lines": 300, "bad": 0}
    assert books.ingest_lines(frame(wrong), path, "b", "PERMISSIVE") == {"lines": 94, "bad": 4}
    _check(spark, path, first + wrong)
    assert books.ingest_lines(frame(second), path, "b", "PERMISSIVE") == {"lines": 207, "bad": 7}
    _check(spark, path, first + second)
    assert {(r.batch, r["lines"], r.bad) for r in books.table_ingests(spark, path).collect()} == {("a", 300, 0), ("b", 207, 7)}
    assert sorted(r.line for r in books.table_quarantine(spark, path).collect()) == sorted(f"torn {k}" for k in range(7))
    assert not [x for x in os.listdir(path) if x.startswith("_staging")]
    # Dropped instead of kept: counted all the same, and the quarantine no longer has them.
    books.ingest_lines(frame(second), path, "b", "DROPMALFORMED")
    assert books.table_quarantine(spark, path).count() == 0
    # A batch of bad lines only, then one without lines: no rows, no statistics of it.
    assert books.ingest_lines(frame([("torn", "000001-00001-2008", "000001-00001")]), path, "b", "PERMISSIVE") == {"lines": 1, "bad": 1}
    _check(spark, path, first)
    assert books.ingest_lines(frame([]), path, "b") == {"lines": 0, "bad": 0}
    _check(spark, path, first)


def test_failfast_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    good = _lines(4, 50)
    books.ingest_lines(spark.createDataFrame(good, LINE), path, "a")
    with pytest.raises(Exception, match="Malformed observation line"):
        books.ingest_lines(spark.createDataFrame(_lines(5, 50, bad=1), LINE), path, "a")
    _check(spark, path, good)
    assert not [x for x in os.listdir(path) if x.startswith("_staging")]


def test_statistics_that_do_not_belong_to_the_rows_are_noticed(spark, tmp_path):
    from surfacewx.plans.ingest import write_observation_table

    path = str(tmp_path / "table")
    books.ingest_lines(spark.createDataFrame(_lines(6, 60), LINE), path, "a")
    write_observation_table(read_observation_table(spark, path), path, "append", batch="other")
    assert not books.statistics_match(spark, path)


def test_the_threshold_reads_no_observation(spark, tmp_path):
    path = str(tmp_path / "table")
    books.ingest_lines(spark.createDataFrame(_lines(7, 2000), LINE), path, "a")
    stations = spark.range(20).select(F.format_string("%06d-00001", "id").alias("station_id"), F.lit("N").alias("station_name"), F.lit("US").alias("country"), F.lit("TX").alias("state"), (30 + F.col("id") / 10).alias("latitude"), F.lit(-95.0).alias("longitude"), F.lit(1.0).alias("elevation"))
    obs = read_observation_table(spark, path)
    args = (obs, stations, 30.0, -95.0, 1.0, 100_000.0, 1.0)
    kept = detect(*args, statistics=books.table_statistics(spark, path))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, detect(*args).collect())) != []
    # One scan of the table (with its sort's sampling it is the same plan node) and two of the statistics; without them, two of the table.
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
    scans = [x for x in plan.split("\n\n") if "Scan parquet" in x.split("\n")[0]]
    assert scans and all(("measure" in x) != ("observation_id" in x) for x in scans)


def test_report_file_at_the_exact_path(spark, sf_small, tmp_path):
    report = flagship_outliers(spark, sf_small)
    path = tmp_path / "deep" / "results.txt"
    for _ in range(2):  # the second replaces the first
        write_report_file(report.repartitionByRange(5, "year", "month", "day", "hour").sortWithinPartitions("year", "month", "day", "hour"), str(path))
        lines = path.read_text().splitlines()
        assert lines[0] == ",".join(REPORT_COLUMNS) and len(lines) == 12
    write_report_file(report, str(path))
    rows = [",".join(r) for r in report.select(*REPORT_FIELDS).collect()]
    assert path.read_text().splitlines()[1:] == rows
    assert [x for x in os.listdir(path.parent) if not x.endswith(".crc")] == ["results.txt"]
    write_report_file(report.limit(0), str(path))
    assert path.read_text() == ",".join(REPORT_COLUMNS) + "\n"


def test_a_failed_write_leaves_the_old_report(spark, sf_small, tmp_path):
    path = tmp_path / "results.txt"
    path.write_text("old")
    report = flagship_outliers(spark, sf_small)
    broken = report.withColumn("state", F.when(F.col("state") == "TX", F.raise_error(F.lit("no"))).otherwise(F.col("state")).cast("string"))
    with pytest.raises(Exception, match="no"):
        write_report_file(broken, str(path))
    assert path.read_text() == "old" and os.listdir(tmp_path) == ["results.txt"]
    (tmp_path / "folder").mkdir()
    with pytest.raises(IsADirectoryError):
        write_report_file(report, str(tmp_path / "folder"))


def test_sql_functions_equal_the_column_functions(spark):
    register_sql_functions(spark)
    assert "weather_distance_m" in register_sql_functions(spark)
    rows = spark.createDataFrame(
        [(29.7, -95.3, 12.0, "/a/722430-12960-2008.gz"), (-90.0, 180.0, None, "plain"), (0.0, 0.0, 0.0, "/x/a.txt.gz"), (None, 1.0, 1.0, None), (45.5, 170.25, -3.5, "")],
        "lat double, lon double, elev double, path string",
    )
    want = rows.select(distance_m(30.0, -95.0, 1.0, "lat", "lon", "elev").alias("d"), observation_key("path").alias("o"), station_key(observation_key("path")).alias("s"))
    got = spark.sql("SELECT weather_distance_m(30.0D, -95.0D, 1.0D, lat, lon, elev) AS d, observation_key(path) AS o, station_key(observation_key(path)) AS s FROM {rows}", rows=rows)
    for a, b in zip(got.collect(), want.collect(), strict=True):
        assert (a.o, a.s) == (b.o, b.s) and (a.d == b.d or math.isclose(a.d, b.d, rel_tol=1e-12))
    halves = [r[0] for r in spark.sql("SELECT round_half_up_x10(x) FROM VALUES (2.25D), (-2.25D), (0.05D), (CAST(NULL AS DOUBLE)) AS t(x)").collect()]
    assert halves == [23, -22, 1, None]
