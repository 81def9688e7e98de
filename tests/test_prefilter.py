"""The Bloom filter before large joins: no row lost, few strangers, before the shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from surfacewx.operators import prefilter as module
from surfacewx.operators.joins import dimension_join, semi_join
from surfacewx.operators.prefilter import can_prefilter, key_words, prefilter, words_for


def _fact(spark, kind="string"):
    """60,000 rows, a third of them of one key (id 7), the others of 20,000 keys."""
    ids = spark.range(0, 60000, numPartitions=8).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 20000).cast("long").alias("n"))
    return ids.select("id", F.col("n").cast(kind).alias("k"))


@pytest.mark.parametrize("kind", ["string", "bigint", "int", "date"])
def test_every_partner_passes_and_few_others(spark, kind):
    if kind == "date":
        fact = _fact(spark, "int").select("id", F.date_add(F.lit("2000-01-01"), F.col("k")).alias("k"))
    else:
        fact = _fact(spark, kind)
    dim = fact.filter("id % 20 = 1").select("k").distinct()
    n = dim.count()
    want = fact.join(dim, "k", "left_semi").select(*fact.columns)
    passed = prefilter(fact, dim, "k", "k", n)
    assert passed.columns == fact.columns and want.exceptAll(passed).count() == 0
    others = fact.count() - want.count()
    assert passed.count() - want.count() < others * 0.05


def test_words_follow_the_number_of_keys(spark, monkeypatch):
    assert [words_for(n) for n in (0, 1, 4, 5, 8, 9, 1000)] == [1, 1, 1, 2, 2, 4, 256]
    assert words_for(1 << 40) == module.MAX_WORDS
    keys = spark.range(100_000).select(F.col("id").cast("string").alias("k"))
    monkeypatch.setattr(module, "MAX_WORDS", 64)
    assert key_words(keys, "k", 100_000).count() == 64
    assert not can_prefilter(keys, keys, "k", "k", 100_000) and can_prefilter(keys, keys, "k", "k", 1024)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left", "left_anti"])
@pytest.mark.parametrize("strategy", ["aqe", "salt"])
def test_large_joins_give_the_rows_of_a_plain_join(spark, how, strategy):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["7", None, str(rnd.randrange(900))])) for i in range(3000)]
    fact = spark.createDataFrame(rows, "id long, k string")
    dim = spark.createDataFrame([(str(k), k) for k in range(0, 900, 9)] + [("7", 7), ("7", 8), (None, 1)], "k string, w long")
    spark.conf.set("surfacewx.join.skew", strategy)
    try:
        got = dimension_join(fact, dim, "k", how=how, max_bytes=0, prefiltered=True)
        want = fact.join(dim.withColumnRenamed("k", "dk"), F.col("k") == F.col("dk"), how)
        want = want.drop("dk") if "dk" in want.columns else want
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    finally:
        spark.conf.unset("surfacewx.join.skew")


def test_empty_sides_and_keys_of_two_types(spark):
    fact = _fact(spark)
    assert semi_join(fact, fact.limit(0), "k", max_bytes=-1, prefiltered=True).count() == 0
    assert semi_join(fact.limit(0), fact, "k", max_bytes=0, prefiltered=True).count() == 0
    numbers = spark.range(5).select(F.col("id").alias("k"))
    ints = fact.select("id", F.col("k").cast("int").alias("k"))
    assert not can_prefilter(ints, numbers, "k", "k", 5)
    assert semi_join(ints, numbers, "k", max_bytes=0, prefiltered=True).count() == ints.filter("k < 5").count()


def test_only_the_selected_share_is_shuffled(spark, tmp_path):
    """Rows that cross the exchange of the join: those that pass the filter."""
    _fact(spark).write.parquet(str(tmp_path / "f"))
    fact = spark.read.parquet(str(tmp_path / "f"))
    dim = spark.createDataFrame([(str(k),) for k in range(0, 20000, 20)], "k string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def shuffled(enabled):
        spark.conf.set("surfacewx.join.prefilter", enabled)
        df = semi_join(fact, dim, "k", max_bytes=0)
        rows = df.count(), df.collect()
        plan, most = df._jdf.queryExecution().executedPlan(), 0
        todo = [plan]
        while todo:
            node = todo.pop()
            name = node.nodeName()
            if name == "AdaptiveSparkPlan":
                todo.append(node.executedPlan())
            elif "QueryStage" in name:
                todo.append(node.plan())
            elif name == "Exchange":
                most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        return rows[0], most

    try:
        n, with_filter = shuffled("true")
        same, without = shuffled("false")
    finally:
        spark.conf.unset("surfacewx.join.prefilter")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert n == same and without == 60000
    assert n <= with_filter < n + 60000 * 0.05


def test_a_hot_selected_key_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "surfacewx.join.skew": "aqe",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        fact = _fact(spark)
        df = semi_join(fact, fact.filter("id < 4000").select("k"), "k", max_bytes=0, prefiltered=True)
        n = len(df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert n > 20000 and "SortMergeJoin(skew=true)" in plan
