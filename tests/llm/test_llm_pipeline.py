"""The pipeline's stages against their operators, and the registered queries against DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from surfacewx.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    if not os.path.exists(SF):
        pytest.skip("test tables not available")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
    want = sorted(map(str, db.execute(f"select {', '.join(columns)} from ({queries.ORACLE[name]})").fetchall()))
    assert got == want


def test_each_stage_keeps_what_its_query_says(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = docs.withColumns({c: F.lit(c) for c in ("score", "tail_prob", "n_hit", "items", "fp", "kept_id", "component_id")})
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    want = {
        0: queries.op10_quality(spark, SF).filter("keep"),
        1: queries.op5_toxicity(spark, SF).filter(F.col("score") < toxicity.THRESHOLD),
        2: queries.op8_simhash(spark, SF).filter("doc_id = component_id"),
        3: queries.op7_decontamination(spark, SF).filter("not contaminated"),
        4: queries.op2_bpe_encoding(spark, SF),
    }
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, told, SF)
        assert ids(out) == ids(want[k]), name
        if k < 4:
            assert out.columns == told.columns and out.filter("score <> 'score' or fp <> 'fp'").count() == 0


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_stages_take_nulls_and_no_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 50_000, None, None, None)], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 0, name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
