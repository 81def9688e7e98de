import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surfacewx.operators import (
    checked_broadcast,
    enrich,
    find_outliers,
    merge_partials,
    partial_stats,
    pooled_stats,
    salted_join,
    semi_join,
    threshold_table,
    union_observations,
    with_position,
    within_radius,
)
from surfacewx.operators.joins import dimension_join, measured


def _vals(spark, values, key=None):
    rows = [(i, (key[i] if key else f"s{i % 3}"), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, station_id string, v double")


def test_stats_no_rows(spark):
    r = pooled_stats(_vals(spark, []), "v").first()
    assert (r.n, r.mean, r.stddev) == (0, None, None)


def test_stats_one_row_and_all_null(spark):
    r = pooled_stats(_vals(spark, [4.0]), "v").first()
    assert (r.n, r.mean, r.stddev) == (1, 4.0, None)
    r = pooled_stats(_vals(spark, [None, None]), "v").first()
    assert (r.n, r.mean, r.stddev) == (0, None, None)


def test_stats_sample_stddev(spark):
    r = pooled_stats(_vals(spark, [1.0, 2.0, 3.0, 4.0, None]), "v").first()
    assert r.n == 4 and r.mean == 2.5 and r.stddev == pytest.approx((5.0 / 3.0) ** 0.5, rel=1e-15)


def test_outliers_constant_values_keep_nothing(spark):
    assert find_outliers(_vals(spark, [5.0] * 10), "v", 0.0).count() == 0


def test_outliers_strict_and_null(spark):
    # mean 2, sample stddev 1 for [1, 2, 3]; delta 1 -> threshold 3: 3 is not kept
    df = _vals(spark, [1.0, 2.0, 3.0, None, 3.5])
    # with 3.5: mean 2.375
    rows = find_outliers(_vals(spark, [1.0, 2.0, 3.0, None]), "v", 1.0).collect()
    assert rows == []
    kept = find_outliers(_vals(spark, [1.0, 2.0, 3.0, None]), "v", 0.5).collect()
    assert [r.v for r in kept] == [3.0]
    assert df.count() == 5


def test_outliers_one_value_keeps_nothing(spark):
    assert find_outliers(_vals(spark, [7.0]), "v", 0.0).count() == 0


def test_threshold_table(spark):
    t = {r.delta: r.threshold for r in threshold_table(_vals(spark, [1.0, 2.0, 3.0]), "v", (1.0, 2.0)).collect()}
    assert t == {1.0: 3.0, 2.0: 4.0}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.floats(-1e3, 1e3))), min_size=0, max_size=40))
def test_merged_partials_equal_direct(spark, data):
    keys = [f"s{k}" for k, _ in data]
    df = _vals(spark, [v for _, v in data], keys)
    direct = pooled_stats(df, "v").first()
    merged = merge_partials(partial_stats(df, "v", "station_id")).first()
    assert merged.n == direct.n
    for a, b in ((merged.mean, direct.mean), (merged.stddev, direct.stddev)):
        if b is None:
            assert a is None
        else:
            assert a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_raising_delta_never_adds(spark):
    df = _vals(spark, [float(i % 17) for i in range(200)])
    counts = [find_outliers(df, "v", d).count() for d in (0.0, 0.5, 1.0, 1.5, 2.0)]
    assert counts == sorted(counts, reverse=True)


def _stations(spark):
    return spark.createDataFrame(
        [
            ("A", 29.761993, -95.366302, 12.0),
            ("B", 29.761993, -95.366302, 112.0),  # 100 m above
            ("C", None, -95.0, 10.0),
            ("D", 40.0, -95.0, 10.0),
            ("E", 29.761993, -95.366302, None),
        ],
        "station_id string, latitude double, longitude double, elevation double",
    )


def test_within_radius_inclusive_and_missing(spark):
    sel = within_radius(_stations(spark), 29.761993, -95.366302, 12.0, 100.0)
    assert sorted(r.station_id for r in sel.collect()) == ["A", "B"]  # B exactly on the radius
    sel = within_radius(_stations(spark), 29.761993, -95.366302, 12.0, 99.999)
    assert [r.station_id for r in sel.collect()] == ["A"]


def test_shrinking_radius_never_adds_stations(spark):
    st_ = _stations(spark)
    sizes = [within_radius(st_, 29.0, -95.0, 0.0, r).count() for r in (5e6, 1e6, 1e5, 1e4)]
    assert sizes == sorted(sizes, reverse=True)


def test_enrich_keeps_unknown_station(spark):
    recs = spark.createDataFrame([(1, "A"), (2, "Z")], "id long, station_id string")
    out = {r.id: r for r in enrich(recs, _stations(spark), "station_id").collect()}
    assert out[1].latitude == 29.761993 and out[2].latitude is None and out[2].station_id == "Z"


def test_semi_join(spark):
    obs = spark.createDataFrame([(1, "A"), (2, "Z"), (3, "A")], "id long, station_id string")
    assert sorted(r.id for r in semi_join(obs, _stations(spark), "station_id").collect()) == [1, 3]


def test_checked_broadcast_bound(spark):
    df = spark.range(100)
    _, ok = checked_broadcast(df, max_rows=100)
    assert ok
    _, ok = checked_broadcast(df, max_rows=99)
    assert not ok


def test_salted_join_matches_plain_join_on_hot_key(spark):
    # one key holds a third of the fact rows
    fact = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"))
    dim = spark.range(40).select(F.col("id").alias("dk"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = salted_join(fact, dim, "k", "dk", how, buckets=8)
        plain = fact.join(dim, fact.k == dim.dk, how)
        assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect())), how


def test_dimension_join_fallback_equals_broadcast(spark):
    fact = spark.range(500).select(F.col("id"), (F.col("id") % 20).alias("k"))
    dim = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    small = dimension_join(fact, dim, "k", how="left")
    for strategy in ("salt", "aqe"):
        spark.conf.set("surfacewx.join.skew", strategy)
        try:
            big = dimension_join(fact, dim, "k", how="left", max_bytes=1)  # forces the fallback
            assert sorted(map(tuple, big.collect())) == sorted(map(tuple, small.collect()))
            assert big.columns == small.columns
        finally:
            spark.conf.unset("surfacewx.join.skew")


@pytest.mark.parametrize("materialize", [True, False])
def test_with_position(spark, materialize):
    # Input partitions larger than the range sampler's per-partition sample,
    # so the bounds come from a random sample: the count and the numbering
    # must still agree.
    n = 200000
    df = spark.range(0, n, numPartitions=16).select(((F.col("id") * 7919) % n).alias("a"), F.col("id"))
    out = with_position(df, ["a", "id"], partitions=7, materialize=materialize).select("a", "position").collect()
    by_pos = sorted(out, key=lambda r: r.position)
    assert [r.position for r in by_pos] == list(range(1, n + 1))
    assert [r.a for r in by_pos] == sorted(r.a for r in out)


def test_union_keeps_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,)], "x long")
    b = spark.createDataFrame([(1,), (2,)], "x long")
    assert sorted(r.x for r in union_observations(a, b).collect()) == [1, 1, 1, 2]
    assert union_observations(a.limit(0)).count() == 0


def test_spread_only_when_asked(spark):
    from surfacewx.operators.partitioning import spread

    one = spark.range(0, 100, numPartitions=1)
    assert spread(one, 4).rdd.getNumPartitions() == 4
    assert spread(one, None) is one


def test_long_strings_are_not_broadcast(spark):
    fact = spark.range(50).select(F.col("id").alias("k"))
    dim = spark.range(2000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 100_000).alias("t"), F.array(F.repeat(F.lit("y"), 10)).alias("a"))
    assert checked_broadcast(dim)[1] is False and checked_broadcast(dim.drop("t"))[1] is True
    assert measured(dim.select("t"))[1] >= 2000 * 100_000
    joined = dimension_join(fact, dim, "k")
    assert "BroadcastHashJoin Inner BuildRight" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 50


def test_salt_from_named_columns_reads_only_them(spark, tmp_path):
    path = str(tmp_path / "fact.parquet")
    spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 24).alias("hour"), F.rand(1).alias("v"), F.lit("wide").alias("w1"), F.lit("wide").alias("w2")).write.parquet(path)
    fact, dim = spark.read.parquet(path), spark.range(10).withColumnRenamed("id", "dk")
    joined = salted_join(fact, dim, "k", "dk", "inner", buckets=4, salt_cols=["hour"]).agg(F.avg("v"))
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(joined._jdf.queryExecution(), "formatted")
    schema = next(x for x in plan.splitlines() if x.startswith("ReadSchema"))
    assert "hour" in schema and "v:" in schema and "w1" not in schema and "w2" not in schema


@pytest.mark.parametrize("longitude", [-95.366302, 264.633698, 180.0])
def test_radius_keeps_unusual_coordinates(spark, longitude):
    stations = spark.createDataFrame([("east", 29.761993, 264.633698, 12.0), ("usual", 29.761993, -95.366302, 12.0), ("over", 150.238007, 84.633698, 12.0), ("far", 99.999, -95.366302, 12.0)], "station_id string, latitude double, longitude double, elevation double")
    near = {r.station_id for r in within_radius(stations, 29.761993, longitude, 12.0, 600_000.0).collect()}
    assert near == (set() if longitude == 180.0 else {"east", "usual", "over"})
    far = {r.station_id for r in within_radius(stations, 29.761993, -95.366302, 12.0, 8_000_000.0).collect()}
    assert far == {"east", "usual", "over", "far"}


def test_detect_hot_station_salted_equals_broadcast(spark):
    """One station holds a third of all readings; the salted shuffle join
    (broadcast disabled by a 1-byte bound) gives the same report."""
    from surfacewx.plans.detect import detect

    n = 30000
    obs = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT-1")).otherwise(F.format_string("S%03d-1", F.col("id") % 97)).alias("station_id"),
        F.lit(2008).alias("year"),
        (F.col("id") % 12 + 1).cast("int").alias("month"),
        (F.col("id") % 28 + 1).cast("int").alias("day"),
        (F.col("id") % 24).cast("int").alias("hour"),
        ((F.col("id") * 7919) % 1000 / 10.0).alias("wind_speed"),
        F.col("id").alias("event_id"),
    ).withColumn("observation_id", F.concat_ws("-", "station_id", F.col("year").cast("string")))
    ids = ["HOT-1"] + [f"S{i:03d}-1" for i in range(97)]
    stations = spark.createDataFrame(
        [(sid, f"N{sid}", "US", "TX", 29.7 + (i % 10) * 0.01, -95.3, 10.0) for i, sid in enumerate(ids)],
        "station_id string, station_name string, country string, state string, latitude double, longitude double, elevation double",
    )
    fast = detect(obs, stations, delta=1.0, tiebreak=["event_id"], keep=["event_id"], materialize=False)
    expected = sorted(map(tuple, fast.collect()))
    spark.conf.set("surfacewx.broadcast.maxBytes", "1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the test's fact side is tiny
    try:
        results = {}
        for strategy in ("salt", "aqe"):
            spark.conf.set("surfacewx.join.skew", strategy)
            df = detect(obs, stations, delta=1.0, tiebreak=["event_id"], keep=["event_id"], materialize=False)
            plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            results[strategy] = (plan, sorted(map(tuple, df.collect())))
    finally:
        spark.conf.unset("surfacewx.broadcast.maxBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("surfacewx.join.skew")
    salt_plan, salt_rows = results["salt"]
    aqe_plan, aqe_rows = results["aqe"]
    assert "_salt" in salt_plan and "BroadcastHashJoin" not in salt_plan
    assert "_salt" not in aqe_plan and "SortMergeJoin" in aqe_plan
    assert salt_rows == expected and aqe_rows == expected and len(expected) > 0


def test_outlier_report_unknown_station_and_order(spark):
    from surfacewx.plans.detect import outlier_report

    rows = [("A-1-2008", "A-1", 2008, 1, 1, h, 1.0, 10, h) for h in range(20)]
    rows += [("Z-9-2008", "Z-9", 2008, 1, 1, 5, 50.0, 500, 100), ("A-1-2008", "A-1", 2008, 1, 1, 3, 40.0, 400, 101)]
    obs = spark.createDataFrame(
        rows,
        "observation_id string, station_id string, year int, month int, day int, hour int, wind_speed double, wind_speed_x10 int, event_id long",
    )
    stations = spark.createDataFrame(
        [("A-1", "ALPHA", "US", "TX", 29.98, -95.36, 29.0)],
        "station_id string, station_name string, country string, state string, latitude double, longitude double, elevation double",
    )
    rep = outlier_report(obs, stations, delta=1.0).collect()
    assert [(r.hour, r.station_id, r.station_name, r.latitude, r.wind_speed_x10) for r in rep] == [
        ("3", "A-1", "ALPHA", "+29.980", "400"),
        ("5", "Z-9", "", "", "500"),
    ]


def test_latitude_band_pushed_to_parquet(spark, tmp_path):
    path = str(tmp_path / "stations.parquet")
    _stations(spark).write.parquet(path)
    sel = within_radius(spark.read.parquet(path), 29.761993, -95.366302, 12.0, 600000.0)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(sel._jdf.queryExecution(), "formatted")
    pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters")]
    assert any("GreaterThanOrEqual(latitude" in p and "LessThanOrEqual(latitude" in p for p in pushed), pushed
    assert any("GreaterThanOrEqual(longitude" in p and "LessThanOrEqual(longitude" in p for p in pushed), pushed
    assert sorted(r.station_id for r in sel.collect()) == ["A", "B"]


def test_aqe_fallback_splits_hot_key(spark):
    """Above the broadcast bound, adaptive execution splits the partition of
    a key holding a third of the fact rows (thresholds lowered to test size)."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "surfacewx.join.skew": "aqe",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        fact = spark.range(0, 60000, numPartitions=8).select(
            "id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("k")
        )
        dim = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        j = dimension_join(fact, dim, "k", how="inner", max_bytes=1)
        assert j.count() == 60000
        j.collect()
        plan = j._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert "SortMergeJoin(skew=true)" in plan


def test_dedupe_last_hot_key(spark):
    from surfacewx.sources.stations import dedupe_last

    n = 60000
    df = spark.range(0, n, numPartitions=12).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.format_string("K%04d", F.col("id") % 997)).alias("station_id"),
        F.col("id").alias("line_no"),
        F.format_string("name-%d", F.col("id")).alias("station_name"),
    )
    out = {r.station_id: r for r in dedupe_last(df, "station_id", "line_no").collect()}
    assert out["HOT"].line_no == n - 3 and out["HOT"].station_name == f"name-{n - 3}"
    expect = {}
    for i in range(n):
        if i % 3:
            expect[f"K{i % 997:04d}"] = i
    assert {k: r.line_no for k, r in out.items() if k != "HOT"} == expect


def test_pooled_stats_many_equals_single(spark):
    from surfacewx.operators.stats import pooled_stats_many

    df = spark.range(0, 500).select(
        (F.col("id") % 17).cast("double").alias("a"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") * 0.5).alias("b"),
        (F.col("id") % 3).cast("int").alias("c"),
    )
    many = {r.measure: r for r in pooled_stats_many(df, ["a", "b", "c"]).collect()}
    for m in ("a", "b", "c"):
        one = pooled_stats(df, m).first()
        assert (many[m].n, many[m].mean) == (one.n, one.mean)
        assert many[m].stddev == pytest.approx(one.stddev, rel=1e-12)
