import gzip
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from surfacewx.schema import OBSERVATION_COLUMNS, STATION_COLUMNS
from surfacewx.sources import (
    empty_observations,
    parse_observations,
    parse_station_lines,
    read_observation_lines,
    read_observations,
    read_stations,
    render_observation_lines,
)
from surfacewx.sources.fixtures import write_observation_files

GOOD = "2008 09 13 09   256   230  9856   340   278     8    -1 -9999"


def _lines(spark, *lines):
    return spark.createDataFrame([("722430-12960-2008", l) for l in lines], "observation_id string, value string")


def test_parse_sample_line(spark):
    r = parse_observations(_lines(spark, GOOD)).first()
    assert (r.year, r.month, r.day, r.hour) == (2008, 9, 13, 9)
    assert (r.air_temperature, r.dew_point_temperature, r.sea_level_pressure) == (25.6, 23.0, 985.6)
    assert (r.wind_direction, r.wind_speed, r.wind_speed_x10, r.total_cloud_cover) == (340, 27.8, 278, 8)
    assert (r.one_hour_precipitation, r.six_hour_precipitation) == (-0.1, None)
    assert r.station_id == "722430-12960" and r.observation_id == "722430-12960-2008"


def test_parse_schema(spark):
    df = parse_observations(_lines(spark, GOOD))
    assert df.columns == OBSERVATION_COLUMNS
    types = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    assert types["year"] == "int" and types["wind_direction"] == "int" and types["wind_speed"] == "double"
    assert types["wind_speed_x10"] == "int"


def test_parse_valid_variants(spark):
    variants = [
        "  " + GOOD + "  ",          # leading and trailing blanks
        GOOD.replace(" ", "\t"),     # tabs
        GOOD + " 5 6",                # extra integer tokens are ignored
        "2008 +09 13 09 256 230 9856 340 278 8 -1 -9999",  # explicit plus sign
    ]
    rows = parse_observations(_lines(spark, *variants)).collect()
    assert len(rows) == 4
    assert {(r.month, r.wind_speed) for r in rows} == {(9, 27.8)}


def test_parse_all_missing(spark):
    r = parse_observations(_lines(spark, "2008 01 01 00" + " -9999" * 8)).first()
    assert all(getattr(r, c) is None for c in OBSERVATION_COLUMNS[6:])


BAD = ["", "2008 09 13 09 256 230 9856 340 278 8 -1", GOOD + " x", GOOD.replace("278", "27.8"), "   "]


def test_failfast_raises(spark):
    for bad in BAD:
        with pytest.raises(PySparkException):
            parse_observations(_lines(spark, GOOD, bad)).collect()


def test_dropmalformed(spark):
    rows = parse_observations(_lines(spark, GOOD, *BAD), mode="DROPMALFORMED").collect()
    assert len(rows) == 1 and rows[0].wind_speed == 27.8


def test_permissive(spark):
    df = parse_observations(_lines(spark, GOOD, *BAD), mode="PERMISSIVE")
    rows = df.collect()
    assert len(rows) == 1 + len(BAD)
    bad_rows = [r for r in rows if r._corrupt_record is not None]
    assert sorted(r._corrupt_record for r in bad_rows) == sorted(BAD)
    assert all(r.year is None and r.wind_speed is None for r in bad_rows)


def test_render_then_parse_is_identity(spark):
    obs = parse_observations(_lines(spark, GOOD, "2008 01 01 00" + " -9999" * 8, "1999 12 31 23 -400 -123 10500 0 0 19 0 1234"))
    back = parse_observations(render_observation_lines(obs))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, obs.collect()))


def test_empty_observations(spark):
    e = empty_observations(spark)
    assert e.count() == 0 and e.columns == OBSERVATION_COLUMNS


def _write(path, lines, gz=False):
    data = ("\n".join(lines) + "\n").encode()
    if gz:
        with gzip.open(path, "wb") as f:
            f.write(data)
    else:
        with open(path, "wb") as f:
            f.write(data)


def _scan_files(df):
    """Number of files the scan opened (from the executed plan's metrics)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    jvm_nodes = [plan]
    found = []
    while jvm_nodes:
        n = jvm_nodes.pop()
        if n.nodeName().startswith("Scan") or "FileSourceScan" in n.getClass().getSimpleName():
            found.append(int(n.metrics().apply("numFiles").value()))
        cls = n.getClass().getSimpleName()
        if cls == "AdaptiveSparkPlanExec":
            jvm_nodes.append(n.executedPlan())
        elif cls.endswith("QueryStageExec"):
            jvm_nodes.append(n.plan())
        it = n.children().iterator()
        while it.hasNext():
            jvm_nodes.append(it.next())
    assert found, text
    return sum(found)


def test_read_files_gz_plain_and_pruning(spark, tmp_path):
    d = tmp_path / "obs"
    d.mkdir()
    _write(d / "722430-12960-2008.gz", [GOOD, GOOD.replace("278", "100")], gz=True)
    _write(d / "722430-12960-2009", [GOOD.replace("2008", "2009", 1)])
    _write(d / "A12345-99999-2008.txt.gz", [GOOD], gz=True)
    _write(d / "README", ["not an observation file"])
    all_obs = read_observations(spark, str(d))
    rows = all_obs.collect()
    assert len(rows) == 4
    assert {r.observation_id for r in rows} == {"722430-12960-2008", "722430-12960-2009", "A12345-99999-2008.txt"}
    assert {r.station_id for r in rows} == {"722430-12960", "A12345-99999"}
    one = read_observation_lines(spark, str(d), station_ids=["A12345-99999"])
    assert _scan_files(one) == 1
    two = read_observation_lines(spark, str(d), station_ids=["722430-12960"])
    assert _scan_files(two) == 2


def test_same_base_name_read_once_each(spark, tmp_path):
    d = tmp_path / "obs"
    d.mkdir()
    _write(d / "722430-12960-2008", [GOOD])
    _write(d / "722430-12960-2008.gz", [GOOD], gz=True)
    rows = read_observations(spark, str(d)).collect()
    assert len(rows) == 2 and {r.observation_id for r in rows} == {"722430-12960-2008"}


HEADER = '"USAF","WBAN","STATION NAME","CTRY","STATE","ICAO","LAT","LON","ELEV(M)","BEGIN","END"'


def test_read_stations(spark, tmp_path):
    p = tmp_path / "isd-history.csv"
    lines = [
        HEADER,
        '"722430","12960","AIRPORT ONE","US","TX","KAAA","+29.980","-095.360","+0029.0","19700101","20180501"',
        '"A00001","99999","COMMA, NAME","US","","","+30.000","-095.000","","19900101","20180501"',
        '"722430","12960","AIRPORT ONE MOVED","US","TX","KAAA","+29.990","-095.360","+0030.0","19700101","20180501"',
        '"010010","99999","JAN MAYEN","NO","","ENJA","+70.933","-008.667","+0009.0","19310101","20180501"',
    ]
    _write(p, lines)
    st = read_stations(spark, str(p))
    assert st.columns == STATION_COLUMNS
    rows = {r.station_id: r for r in st.collect()}
    assert set(rows) == {"722430-12960", "A00001-99999", "010010-99999"}
    assert rows["722430-12960"].station_name == "AIRPORT ONE MOVED"  # last line wins
    assert rows["722430-12960"].latitude == 29.99
    a = rows["A00001-99999"]
    assert a.station_name == "COMMA, NAME" and a.state is None and a.icao is None and a.elevation is None
    assert rows["010010-99999"].longitude == -8.667 and rows["010010-99999"].usaf == "010010"
    assert str(rows["010010-99999"].begin) == "1931-01-01"


def test_station_last_wins_across_splits(spark, tmp_path):
    p = tmp_path / "big.csv"
    body = [f'"{i % 500:06d}","99999","N{i}","US","TX","","+29.000","-095.000","+0001.0","19700101","20180501"' for i in range(20000)]
    _write(p, [HEADER, *body])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        raw_splits = spark.read.option("header", True).csv(str(p)).rdd.getNumPartitions()
        st = read_stations(spark, str(p))
        rows = {r.station_id: r.station_name for r in st.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert raw_splits > 20
    assert len(rows) == 500
    assert all(rows[f"{k:06d}-99999"] == f"N{19500 + k}" for k in range(500))


def test_station_empty_begin_date_fails(spark, tmp_path):
    p = tmp_path / "bad.csv"
    _write(p, [HEADER, '"722430","12960","X","US","TX","","+29.980","-095.360","+0029.0","","20180501"'])
    with pytest.raises(PySparkException):
        read_stations(spark, str(p)).collect()


def test_parse_station_lines(spark):
    lines = spark.createDataFrame(
        [('"722430","12960","AIRPORT, ONE","US","","KAAA","+29.980","-095.360","+0029.0","19700101","20180501"',)], "value string"
    )
    r = parse_station_lines(lines).first()
    assert r.station_id == "722430-12960" and r.station_name == "AIRPORT, ONE" and r.state is None
    assert (r.latitude, r.longitude, r.elevation) == (29.98, -95.36, 29.0)
    assert str(r.begin) == "1970-01-01" and str(r.end) == "2018-05-01"


def test_lines_filtered_by_name(spark, tmp_path):
    d = tmp_path / "o"
    d.mkdir()
    _write(d / "X-Y-2010", [GOOD])
    df = read_observation_lines(spark, str(d))
    assert df.select(F.col("station_id")).first().station_id == "X-Y"
    assert os.path.exists(d / "X-Y-2010")


def test_station_junk_coordinate(spark, tmp_path):
    p = tmp_path / "junk.csv"
    _write(p, [HEADER, '"722430","12960","X","US","TX","","north","-095.360","+0029.0","19700101","20180501"'])
    with pytest.raises(PySparkException):
        read_stations(spark, str(p)).collect()
    r = read_stations(spark, str(p), mode="PERMISSIVE").first()
    assert r.latitude is None and r.longitude == -95.36


def test_failfast_checked_by_bare_count(spark):
    with pytest.raises(PySparkException):
        parse_observations(_lines(spark, GOOD, "2008 01 01")).count()
    assert parse_observations(_lines(spark, GOOD, GOOD)).count() == 2
    assert parse_observations(_lines(spark, GOOD, "2008 01 01"), mode="DROPMALFORMED").count() == 1


def test_subdirectories_not_descended(spark, tmp_path):
    d = tmp_path / "obs"
    (d / "sub").mkdir(parents=True)
    _write(d / "722430-12960-2008", [GOOD])
    _write(d / "sub" / "722430-12960-2009", [GOOD.replace("2008", "2009", 1)])
    assert [r.year for r in read_observations(spark, str(d)).collect()] == [2008]
    # a glob reaches nested layouts explicitly
    assert sorted(r.year for r in read_observations(spark, [str(d), str(d / "sub")]).collect()) == [2008, 2009]


def test_read_stations_dropmalformed(spark, tmp_path):
    p = tmp_path / "mixed.csv"
    _write(
        p,
        [
            HEADER,
            '"722430","12960","GOOD","US","TX","","+29.980","-095.360","+0029.0","19700101","20180501"',
            '"722431","12960","BAD LAT","US","TX","","north","-095.360","+0029.0","19700101","20180501"',
            '"722432","12960","NO BEGIN","US","TX","","+29.980","-095.360","+0029.0","","20180501"',
            '"722433","12960","NO ELEV","US","TX","","+29.980","-095.360","","19700101","20180501"',
            '"722434","12960","SHORT"',
        ],
    )
    names = sorted(r.station_name for r in read_stations(spark, str(p), mode="DROPMALFORMED").collect())
    assert names == ["GOOD", "NO ELEV"]


def test_observation_files_by_name_written_again_stay_single(spark, tmp_path):
    folder = (tmp_path / "files").as_uri()
    rows = [(f"72000{k}-00001-2008{'.gz' if k % 2 else ''}", GOOD) for k in range(5) for _ in range(k + 1)]
    lines = spark.createDataFrame(rows, "file_name string, value string")
    for _ in range(2):
        write_observation_files(lines, folder)
    got = read_observations(spark, folder).groupBy("station_id").count().collect()
    assert {r.station_id: r["count"] for r in got} == {f"72000{k}-00001": k + 1 for k in range(5)}
    assert not [f for f in (tmp_path / "files").iterdir() if f.name.startswith("_")]


def test_observation_files_are_made_in_folders_of_their_tasks(spark, tmp_path, monkeypatch):
    import surfacewx.sources.fixtures as module

    class Files:
        """The local files; creating one in the shared folder itself is an error."""

        def __init__(self, files, base):
            self.files, self.base = files, base

        def open_output_stream(self, path):
            assert path.rpartition("/")[0] != self.base, path
            return self.files.open_output_stream(path)

        def __getattr__(self, name):
            return getattr(self.files, name)

    folder = str(tmp_path / "files")
    lines = {f"72000{k}-00001-2008{'.gz' if k % 3 == 0 else ''}": [f"{k} é {i} " * (i % 4) for i in range(1 + 5 * k)] for k in range(9)}
    rows = [(name, value) for i in range(50) for name, own in lines.items() for value in own[i : i + 1]] + [("720009-00001-2008", None)]
    place = module.place

    def checked(path):
        files, base = place(path)
        return Files(files, base), base

    monkeypatch.setattr(module, "place", checked)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # files go on over several batches
    try:
        module.write_observation_files(spark.createDataFrame(rows, "file_name string, value string").repartition(3), folder)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.file: sorted(r.lines) for r in spark.read.text(folder).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.collect_list("value").alias("lines")).collect()}
    assert got == {name: sorted(own) for name, own in lines.items()} | {"720009-00001-2008": ["None"]}
    assert sorted(f.name for f in (tmp_path / "files").iterdir() if not f.name.startswith(".")) == sorted(got)
