"""End to end on real files rendered from the sf0.001 test tables."""

import csv
import gzip
import io
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from surfacewx.plans.cli import main as cli_main
from surfacewx.plans.detect import detect, detect_files
from surfacewx.plans.ingest import ingest_to_parquet, read_observation_table, write_observation_table
from surfacewx.plans.registry import flagship_outliers
from surfacewx.schema import MEASURES, OBSERVATION_COLUMNS, REPORT_COLUMNS, REPORT_FIELDS
from surfacewx.sinks import show_report, write_report_csv
from surfacewx.sources.fixtures import observations_from_events, station_count, stations_from_supplier
from surfacewx.sources.observations import read_observation_lines, read_observations, render_observation_lines
from surfacewx.sources.stations import read_stations, render_station_lines
from surfacewx.streaming import start_ingest

HEADER = '"USAF","WBAN","STATION NAME","CTRY","STATE","ICAO","LAT","LON","ELEV(M)","BEGIN","END"'


@pytest.fixture(scope="module")
def files(spark, sf_small, tmp_path_factory):
    root = tmp_path_factory.mktemp("isd")
    sup = spark.read.parquet(f"{sf_small}/supplier.parquet")
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    stations = stations_from_supplier(sup)
    cat = root / "isd-history.csv"
    lines = [r.value for r in render_station_lines(stations).collect()]
    cat.write_text("\n".join([HEADER, *lines]) + "\n")
    obs = observations_from_events(ev, station_count(sup)).join(
        stations.select("s_suppkey", "station_id"), F.col("k") == F.col("s_suppkey")
    )
    obs = obs.withColumn("observation_id", F.concat_ws("-", "station_id", F.col("year").cast("string")))
    rendered = render_observation_lines(obs, keep=["event_id"]).orderBy("observation_id", "event_id").collect()
    by_file = defaultdict(list)
    for r in rendered:
        by_file[r.observation_id].append(r.value)
    d = root / "2024"
    d.mkdir()
    for i, (name, ls) in enumerate(sorted(by_file.items())):
        data = ("\n".join(ls) + "\n").encode()
        if i % 2 == 0:
            with gzip.open(d / f"{name}.gz", "wb") as f:
                f.write(data)
        else:
            (d / name).write_bytes(data)
    (d / "README").write_text("not data\n")
    return {"root": root, "dir": str(d), "catalogue": str(cat)}


def _bag(df):
    return sorted(tuple(r) for r in df.select(*REPORT_FIELDS).collect())


def test_detect_files_matches_registry(spark, sf_small, files):
    expected = _bag(flagship_outliers(spark, sf_small))
    assert len(expected) == 11
    got = detect_files(spark, files["dir"], files["catalogue"])
    assert _bag(got) == expected


def test_csv_sink_one_sorted_file_with_header(spark, files):
    out = str(files["root"] / "report")
    report = detect_files(spark, files["dir"], files["catalogue"], output=out)
    parts = [p for p in os.listdir(out) if p.startswith("part-")]
    assert len(parts) == 1
    with open(os.path.join(out, parts[0])) as f:
        rows = list(csv.reader(f))
    assert rows[0] == REPORT_COLUMNS
    body = rows[1:]
    assert len(body) == 11
    keys = [(int(r[0]), int(r[1]), int(r[2]), int(r[3])) for r in body]
    assert keys == sorted(keys)
    assert sorted(tuple(r) for r in body) == _bag(report)


def test_csv_sink_header_only_when_empty(spark, files):
    out = str(files["root"] / "empty")
    report = detect_files(spark, files["dir"], files["catalogue"], latitude=-60.0, longitude=0.0, radius_m=1000.0)
    assert report.count() == 0
    write_report_csv(report, out)
    parts = [p for p in os.listdir(out) if p.startswith("part-")]
    text = "".join(open(os.path.join(out, p)).read() for p in parts)
    assert text.strip() == ",".join(REPORT_COLUMNS)


def test_show_report(spark, files):
    buf = io.StringIO()
    n = show_report(detect_files(spark, files["dir"], files["catalogue"]), buf)
    lines = buf.getvalue().splitlines()
    assert n == 11 and len(lines) == 12 and lines[0] == ",".join(REPORT_COLUMNS)


def test_ingest_then_detect(spark, files):
    table = str(files["root"] / "table")
    ingest_to_parquet(spark, files["dir"], table)
    assert "year=2024" in os.listdir(os.path.join(table, "batch=all"))
    obs = read_observation_table(spark, table)
    stations = read_stations(spark, files["catalogue"])
    report = detect(obs, stations)
    assert _bag(report) == _bag(detect_files(spark, files["dir"], files["catalogue"]))
    # the threshold reaches the Parquet reader as a pushed filter
    lazy = detect(obs, stations)
    jvm = spark.sparkContext._jvm
    plan = jvm.PythonSQLUtils.explainString(lazy._jdf.queryExecution(), "formatted")
    assert "GreaterThan(wind_speed,ScalarSubquery" in plan


def test_streaming_ingest_next_to_a_batch_ingest(spark, files, tmp_path):
    """Stream-appended rows stand beside batch-ingested ones, each once, also after a restart."""
    import shutil

    names = sorted(n for n in os.listdir(files["dir"]) if n != "README")
    first, late = tmp_path / "first", tmp_path / "late"
    first.mkdir(), late.mkdir()
    for i, n in enumerate(names):
        shutil.copy(os.path.join(files["dir"], n), first / n if i < len(names) // 2 else late / n)
    table, ckpt = str(tmp_path / "table"), str(tmp_path / "ckpt")
    ingest_to_parquet(spark, str(first), table)
    for _ in range(2):  # the second run finds nothing new
        start_ingest(spark, str(late), table, ckpt).awaitTermination(120)
        both = read_observation_table(spark, table)
        assert both.count() == spark.read.text([str(first), str(late)]).count()
    assert sorted(map(str, both.collect())) == sorted(map(str, read_observations(spark, files["dir"]).collect()))
    shutil.copy(os.path.join(files["dir"], names[0]), late / ("999999-00001-2023" + (".gz" if names[0].endswith(".gz") else "")))
    start_ingest(spark, str(late), table, ckpt).awaitTermination(120)
    assert read_observation_table(spark, table).count() > both.count()
    assert not os.path.exists(os.path.join(table, "_spark_metadata"))


def test_cli_show(spark, files, capsys):
    assert cli_main([files["dir"], "unused", "--stations", files["catalogue"], "--show"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == ",".join(REPORT_COLUMNS) and len(out) == 12


def test_detect_files_persist_same_result(spark, files):
    out = str(files["root"] / "persisted")
    plain = _bag(detect_files(spark, files["dir"], files["catalogue"]))
    report = detect_files(spark, files["dir"], files["catalogue"], output=out, persist=True)
    assert _bag(report) == plain


def test_detect_files_opens_the_text_once(spark, files, monkeypatch):
    import surfacewx.plans.detect as detect_module

    def lines_in(folder):
        return sum((gzip.open if f.endswith(".gz") else open)(os.path.join(folder, f)).read().count(b"\n" if f.endswith(".gz") else "\n") for f in os.listdir(folder) if "-" in f)

    seen = spark.sparkContext.accumulator(0)

    def counted(*args, **kwargs):
        lines = read_observation_lines(*args, **kwargs)

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return lines.mapInArrow(run, lines.schema)

    expected = _bag(detect_files(spark, files["dir"], files["catalogue"]))
    monkeypatch.setattr(detect_module, "read_observation_lines", counted)
    assert _bag(detect_files(spark, files["dir"], files["catalogue"])) == expected
    assert seen.value == lines_in(files["dir"])
    # what was parsed is gone afterwards
    left = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [f for f in os.listdir(left) if f.startswith("parsed-")]


def test_parsed_once_leaves_nothing_after_a_failure(spark, files, tmp_path):
    (tmp_path / "722430-12960-2024").write_text("a bad line\n")
    from surfacewx.plans.detect import parsed_once

    with pytest.raises(Exception, match="Malformed observation line"):
        with parsed_once(read_observations(spark, str(tmp_path))):
            pass
    left = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [f for f in os.listdir(left) if f.startswith("parsed-")]
    good = read_observations(spark, files["dir"])
    with parsed_once(good) as parsed:
        assert parsed.schema.simpleString() == good.schema.simpleString()
        assert sorted(map(str, parsed.collect())) == sorted(map(str, good.collect()))


def test_cli_writes_report_and_reads_parquet(spark, files):
    out = str(files["root"] / "cli_out.txt")
    assert cli_main([files["dir"], out, "--stations", files["catalogue"]]) == 0
    with open(out) as f:
        rows = list(csv.reader(f))
    assert rows[0] == REPORT_COLUMNS and len(rows) == 12
    table = str(files["root"] / "cli_table")
    ingest_to_parquet(spark, files["dir"], table)
    out2 = str(files["root"] / "cli_out2")
    assert cli_main([table, out2, "--parquet", "--parts", "--stations", files["catalogue"]]) == 0
    parts2 = sorted(p for p in os.listdir(out2) if p.startswith("part-"))
    read = [list(csv.reader(open(os.path.join(out2, p)))) for p in parts2]
    assert [read[0][0], *[r for part in read for r in part[1:]]] == rows


def test_csv_sink_ordered_parts_where_asked(spark, files):
    out = str(files["root"] / "parts")
    report = detect_files(spark, files["dir"], files["catalogue"])
    write_report_csv(report, out, single_file=False)
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    body = []
    for p in parts:
        with open(os.path.join(out, p)) as f:
            rows = list(csv.reader(f))
        if rows:
            assert rows[0] == REPORT_COLUMNS
            body += rows[1:]
    keys = [(int(r[0]), int(r[1]), int(r[2]), int(r[3])) for r in body]
    assert len(body) == 11 and keys == sorted(keys)


def test_detect_files_without_literal_pruning(spark, files, monkeypatch):
    import surfacewx.plans.detect as detect_module

    pruned = _bag(detect_files(spark, files["dir"], files["catalogue"]))
    monkeypatch.setattr(detect_module, "MAX_PRUNING_IDS", 1)  # more stations than literals allowed
    unpruned = _bag(detect_module.detect_files(spark, files["dir"], files["catalogue"]))
    assert unpruned == pruned and len(pruned) == 11


@pytest.mark.parametrize("literals", [10_000, 1])
def test_a_bad_line_matters_only_in_a_selected_file(spark, files, tmp_path, monkeypatch, literals):
    import shutil

    import surfacewx.plans.detect as detect_module

    monkeypatch.setattr(detect_module, "MAX_PRUNING_IDS", literals)
    selected = {r.station_id for r in read_stations(spark, files["catalogue"]).collect()} & {r.station_id for r in detect_files(spark, files["dir"], files["catalogue"]).collect()}
    d = tmp_path / "2024"
    shutil.copytree(files["dir"], d)
    (d / "000001-00001-2024").write_text("a bad line\n")
    assert _bag(detect_files(spark, str(d), files["catalogue"])) == _bag(detect_files(spark, files["dir"], files["catalogue"]))
    (d / f"{sorted(selected)[0]}-2023").write_text("a bad line\n")
    with pytest.raises(Exception, match="Malformed observation line"):
        detect_files(spark, str(d), files["catalogue"]).collect()


@pytest.mark.parametrize("n", [3, 9, 40])
def test_lines_are_not_shuffled_before_parsing(spark, tmp_path, n):
    for k in range(n):
        with gzip.open(tmp_path / f"{k:06d}-00001-2024.gz", "wb") as f:
            f.write(b"2024 01 01 00 1 2 3 4 5 6 7 8\n")
    lines = read_observation_lines(spark, str(tmp_path))
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString() and lines.count() == n
    assert read_observation_lines(spark, str(tmp_path), partitions=5).rdd.getNumPartitions() == 5


def _files_read(df):
    """Files that the scans of a collected DataFrame opened, largest first, and what they pushed."""
    plan, out = df._jdf.queryExecution().executedPlan(), []
    stack = [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            out.append(node.metrics().apply("numOutputRows").value())
        for kids in (node.children(), node.subqueries()):
            stack += [kids.apply(i) for i in range(kids.size())]
        for method in ("plan", "child", "executedPlan"):
            if name.endswith("QueryStageExec") or name in ("AdaptiveSparkPlanExec", "SubqueryExec", "ReusedSubqueryExec"):
                try:
                    stack.append(getattr(node, method)())
                except Exception:
                    pass
    return out


def test_ingested_table_is_pruned_by_station(spark, tmp_path):
    """Both passes over a clustered table read only files of the selected stations."""
    n = 120
    stations = spark.createDataFrame(
        [(f"{k:06d}-00001", f"N{k}", "US", "TX", 10.0 + k * 0.5, -95.0, 1.0) for k in range(n)],
        "station_id string, station_name string, country string, state string, latitude double, longitude double, elevation double",
    )
    obs = spark.range(n * 200).select(
        F.format_string("%06d-00001-2024", F.col("id") % n).alias("observation_id"), F.format_string("%06d-00001", F.col("id") % n).alias("station_id"),
        F.lit(2024).alias("year"), F.lit(1).alias("month"), (F.col("id") % 28 + 1).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour"),
        (F.hash("id") % 100 / 10.0).alias("wind_speed"), (F.hash("id") % 100).cast("int").alias("wind_speed_x10"),
        *[F.lit(None).cast(k).alias(m) for m, k in MEASURES if m != "wind_speed"],
    ).select(*OBSERVATION_COLUMNS)
    table = str(tmp_path / "table")
    write_observation_table(obs, table, partitions=12)
    read = read_observation_table(spark, table)
    # Three stations lie in one or two of about 12 files (the cuts are sampled); the sort runs
    # its input twice (sampling, rows), which the metric adds up: all rows would count 2.0.
    for radius, most in ((60_000.0, 0.5), (20_000_000.0, 2.0)):
        report = detect(read, stations, 30.0, -95.0, 1.0, radius, 1.0)
        rows = report.collect()
        want = detect(obs, stations, 30.0, -95.0, 1.0, radius, 1.0)
        assert _bag(report) == _bag(want) and rows
        scans = [x for x in _files_read(report) if x]
        assert scans and max(scans) <= most * n * 200
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(detect(read, stations, 30.0, -95.0, 1.0, 60_000.0, 1.0)._jdf.queryExecution(), "formatted")
    pushed = [x for x in plan.splitlines() if x.startswith("PushedFilters") and "wind_speed" in x]
    assert pushed and all("GreaterThanOrEqual(station_id" in x and "LessThanOrEqual(station_id" in x for x in pushed)


def test_station_file_as_it_is(spark, tmp_path):
    """A backslash before a quote is text, fields beyond the last are ignored, a bad date still raises."""
    good = '"{}","00001","{}","US","TX","","+29.000","-095.000","+0010.0","20000101","20200101"'
    path = tmp_path / "stations.csv"
    path.write_text("\n".join([HEADER, good.format("000001", "A\\"), good.format("000002", "B") + ',"MORE"', good.format("000003", "C")]) + "\n")
    rows = {r.station_id: (r.station_name, r.country, r.latitude) for r in read_stations(spark, str(path)).collect()}
    assert rows == {"000001-00001": ("A\\", "US", 29.0), "000002-00001": ("B", "US", 29.0), "000003-00001": ("C", "US", 29.0)}
    path.write_text("\n".join([HEADER, good.format("000001", "A").replace("20000101", "never")]) + "\n")
    with pytest.raises(Exception, match="Bad station begin date"):
        read_stations(spark, str(path)).collect()


def test_streaming_ingest_many_batches(spark, files):
    table = str(files["root"] / "stream_table_small_batches")
    ckpt = str(files["root"] / "stream_ckpt_small_batches")
    q = start_ingest(spark, files["dir"], table, ckpt, max_files_per_trigger=2)
    q.awaitTermination(300)
    batches = [p for p in q.recentProgress if p["numInputRows"] > 0]
    total = spark.read.text(files["dir"]).filter(~F.col("_metadata.file_name").startswith("README")).count()
    assert len(batches) > 1
    assert read_observation_table(spark, table).count() == total


def test_csv_sink_quotes_commas(spark, tmp_path):
    from surfacewx.schema import REPORT_FIELDS

    row = ("2008", "9", "13", "9", "278", "722430-12960", "AIRPORT, ONE", "US", "", "+29.980", "-095.360", "+0029.0")
    report = spark.createDataFrame([row], ", ".join(f"`{f}` string" for f in REPORT_FIELDS))
    out = str(tmp_path / "quoted")
    write_report_csv(report, out)
    part = [p for p in os.listdir(out) if p.startswith("part-")][0]
    with open(os.path.join(out, part)) as f:
        text = f.read()
        f.seek(0)
        rows = list(csv.reader(f))
    assert '"AIRPORT, ONE"' in text
    assert rows[1] == list(row)


def test_cli_other_measure(spark, files, capsys):
    expected = detect_files(spark, files["dir"], files["catalogue"], value_col="air_temperature", delta=1.0)
    n = expected.count()
    assert n > 0
    args = [files["dir"], "unused", "29.761993", "-95.366302", "12", "600000", "1", "--stations", files["catalogue"]]
    assert cli_main([*args, "--measure", "air_temperature", "--show"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert len(out) == n + 1
    # the fifth column is 10 x the tested measure, under its own name
    assert out[0].split(",")[4] == "AIR TEMPERATURE*10"
    body = list(csv.reader(out[1:]))
    assert sorted(r[4] for r in body) == sorted(r.wind_speed_x10 for r in expected.collect())


def test_integer_measure_is_printed_as_it_is(spark, files):
    rows = detect_files(spark, files["dir"], files["catalogue"], value_col="wind_direction", delta=1.0).collect()
    assert rows and all(0 <= int(r.wind_speed_x10) < 360 for r in rows)


def test_ingest_files_sorted_by_station(spark, files):
    import glob

    import pyarrow.parquet as pq

    table = str(files["root"] / "sorted_table")
    ingest_to_parquet(spark, files["dir"], table)
    parts = glob.glob(os.path.join(table, "batch=*", "year=*", "*.parquet"))
    assert parts
    for p in parts:
        t = pq.read_table(p, columns=["station_id", "month", "day", "hour"]).to_pylist()
        keys = [(r["station_id"], r["month"], r["day"], r["hour"]) for r in t]
        assert keys == sorted(keys), p
