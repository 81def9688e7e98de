"""The corpus pipeline: quality, toxicity, near duplicates, benchmark
decontamination, then tokens. Each stage works on all that the one before
kept and returns the columns of ``documents``; the last returns each kept
document's token columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacewx.llm import decontam, simhash, toxicity
from surfacewx.llm.common import fresh, written
from surfacewx.llm.queries import bpe_columns, with_quality

KEEP_QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are of low quality with a probability above one half go."""
    into = fresh(docs, "expected_grade"), fresh(docs, "tail_prob")
    made = with_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), into)
    return made.filter(F.col(into[1]) >= KEEP_QUALITY).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the operator's threshold go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    into = fresh(docs, "score")
    return toxicity.score(docs, model, into=into).filter(F.col(into) < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs, words=3, distance=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    into = tuple(fresh(docs, c) for c in ("n_words", "n_hit", "hits", "items"))
    made = decontam.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10, into=into)
    return made.filter(F.col(into[1]) == 0).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_columns(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", token_stage),
]

#: Trained models and components of a graph are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
