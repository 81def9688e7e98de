"""Files read by a manifest: the same lines as the directory scan, even shares, no listing."""

import gzip
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from surfacewx.sources import list_files, packed, read_manifest, read_manifest_lines, read_observation_lines, write_manifest
from surfacewx.sources import manifest as module
from surfacewx.sources.files import place, storage_uri


def fill(folder, names):
    folder.mkdir(exist_ok=True)
    for k, name in enumerate(names):
        data = "".join(f"{name} line {i}\n" for i in range(3 + 7 * k % 40)).encode()
        (folder / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)


def bag(lines):
    return sorted(tuple(r) for r in lines.select("value", "observation_id", "station_id").collect())


def test_the_manifest_reads_what_the_directory_has(spark, tmp_path):
    folder = tmp_path / "files of 2008"
    fill(folder, [f"72{k:04d}-9999{k % 3}-2008{'.gz' if k % 2 else ''}" for k in range(40)] + ["README", "a%20b-1-2009", "x-y", "empty-0-2010"])
    (folder / "empty-0-2010").write_bytes(b"")
    (folder / "ends-0-2008").write_bytes(b"a\r\nb\rc\n\nd")
    fill(folder / "below", ["below-1-2008"])
    table = write_manifest(spark, str(folder), str(tmp_path / "manifest"))
    assert table.count() == 43 and {r.year for r in table.select("year").distinct().collect()} == {2008, 2009, 2010, None} - {2010}
    want = bag(read_observation_lines(spark, str(folder)))
    got = bag(read_manifest_lines(table, 300))
    # Spark escapes a file's name in its metadata; the manifest has the name itself.
    assert got == sorted((r[0], r[1].replace("%25", "%"), r[2].replace("%25", "%")) for r in want)
    assert sorted(r[0] for r in got if r[2] == "ends-0") == ["", "a", "b", "c", "d"]
    some = table.filter(F.col("station_id").startswith("72000"))
    assert bag(read_manifest_lines(some)) == [r for r in want if r[2].startswith("72000")]
    assert read_manifest_lines(table.limit(0)).count() == 0


def test_lines_across_blocks(spark, tmp_path, monkeypatch):
    fill(tmp_path / "in", ["1-2-2008", "3-4-2008.gz"])
    (tmp_path / "in" / "5-6-2008").write_bytes("é\r\nlonger than a block, ü\rx".encode())
    table = write_manifest(spark, str(tmp_path / "in"), str(tmp_path / "manifest"))
    monkeypatch.setattr(module, "BLOCK_BYTES", 5)
    whole = bag(read_manifest_lines(table))
    assert len([r for r in whole if r[2] == "5-6"]) == 3 and ("longer than a block, ü", "5-6-2008", "5-6") in whole
    assert whole == bag(read_observation_lines(spark, str(tmp_path / "in")))


def test_tasks_have_even_shares(spark):
    sizes = [(f"file:/d/{k:05d}-0-2008", (k * 7919) % 1000 + 1) for k in range(5000)] + [(f"file:/e/{k}-0-2008", 0) for k in range(50)]
    files = spark.createDataFrame(sizes, "path string, size long")
    rows, tasks = packed(files, 20_000)
    total = sum(s for _, s in sizes)
    assert tasks == -(-total // 20_000) and rows.count() == len(sizes)
    got = {r.task: r.n for r in rows.groupBy("task").agg(F.sum("size").alias("n")).collect()}
    assert sorted(got) == list(range(tasks))
    assert max(got.values()) <= 2 * min(got.values()) and max(abs(n - total / tasks) for n in got.values()) <= 1000
    # The rows of a task are read together, and by it alone.
    where = rows.repartitionById(tasks, F.col("task")).select(F.spark_partition_id().alias("p"), "task").distinct().collect()
    assert all(r.p == r.task for r in where)


def test_no_directory_is_listed_and_stale_rows_are_noticed(spark, tmp_path):
    fill(tmp_path / "in", ["1-2-2008", "3-4-2008"])
    table = write_manifest(spark, str(tmp_path / "in"), str(tmp_path / "manifest"))
    before = len(bag(read_manifest_lines(table)))
    fill(tmp_path / "in", ["1-2-2008", "3-4-2008", "5-6-2008"])
    assert len(bag(read_manifest_lines(read_manifest(spark, str(tmp_path / "manifest"))))) == before
    with open(tmp_path / "in" / "3-4-2008", "a") as f:
        f.write("more\n")
    with pytest.raises(PySparkException, match="3-4-2008 is not as the manifest has it"):
        read_manifest_lines(table).collect()
    assert list_files(spark, str(tmp_path / "in")).count() == 3
    renewed = write_manifest(spark, str(tmp_path / "in"), str(tmp_path / "manifest"))
    assert bag(read_manifest_lines(renewed)) == bag(read_observation_lines(spark, str(tmp_path / "in")))


def test_places_as_hadoop_writes_them(tmp_path):
    assert storage_uri("s3a://bucket/a b%/c-1-2008.gz") == "s3://bucket/a%20b%25/c-1-2008.gz"
    assert storage_uri("s3n://bucket/x") == "s3://bucket/x"
    assert storage_uri("hdfs://host:8020/x") == "hdfs://host:8020/x"
    assert storage_uri("file:/tmp/x") == storage_uri("file:///tmp/x") == "file:///tmp/x"
    assert storage_uri("/tmp/a b") == "/tmp/a b"
    (tmp_path / "a %41#?b").write_bytes(b"x")
    store, inside = place(f"file:{tmp_path}/a %41#?b")
    assert os.path.samefile(inside, tmp_path / "a %41#?b") and store.get_file_info(inside).size == 1
