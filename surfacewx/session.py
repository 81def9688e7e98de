"""Session helpers for tests, the bench and the command line.

Library functions never create a session; they use the one their input
DataFrames belong to.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


# Whole-stage code generation fuses a scan, text decoding and projections
# into one Java method; past 8000 bytes of bytecode HotSpot leaves such a
# method interpreted unless told otherwise (3-4x slower text parsing).
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "surfacewx") -> SparkSession:
    """A local session for tests and benchmarks: UI off, AQE on, huge
    generated methods compiled by the JIT."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.extraJavaOptions", JVM_OPTIONS)
        .config("spark.executor.extraJavaOptions", JVM_OPTIONS)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint directory of the session.

    Uses the one already set, else ``spark.checkpoint.dir`` from the
    configuration. Only a local-mode session without either gets a fresh
    scratch folder; on a cluster a shared directory must be configured.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared directory (e.g. on HDFS or object storage)")
    path = tempfile.mkdtemp(prefix="surfacewx-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to the session's checkpoint directory and return the
    checkpointed DataFrame (lineage cut, rows fixed).

    A reliable checkpoint writes the rows in a second job after the one that
    computes them; the rows are persisted for the duration so that job reads
    them instead of recomputing the whole plan, then released.
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()
