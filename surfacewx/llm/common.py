"""Pieces the operators share: written tables, joins with hot keys, connected
components and sub-batches of Arrow data."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import surfacewx
from surfacewx.session import ensure_checkpoint_dir

#: A key with more than 1/MAX_HOT of all rows is hot; there are fewer than MAX_HOT of them.
MAX_HOT = 1024
#: Below so many edges the components' joins need no look at hot nodes.
SPLIT_FROM = 1 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed
    once, lineage cut, and safe when executors are lost. :func:`drop_written`
    removes the files; else they stay as long as the shared folder."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that :func:`written` returned; nothing may read it later."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_unique(rows: DataFrame, lookup: DataFrame, key: str, count_col: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (``how``: inner or left) with ``lookup``, which has one
    row per key and in ``count_col`` the key's number of rows.

    Keys with more than ``total / MAX_HOT`` rows, fewer than ``MAX_HOT`` by
    construction, are joined by broadcast, so their rows stay where they are;
    all others by shuffle, where no key exceeds that share.
    """
    is_hot = F.col(count_col) * MAX_HOT > total
    hot = lookup.filter(is_hot)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(lookup.filter(~is_hot), key, how)
    return near.unionByName(far)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u long, v long)``: ``(node, root)`` for
    every node of an edge, ``root`` the smallest node of its component.

    Alternates two steps until the edge set no longer changes: each node's
    larger neighbours are linked to its smallest neighbour, then each node
    and its smaller neighbours are. At the end every edge leads to a root.
    Edges live in written tables; only a count and a checksum reach the driver.
    A node with a large share of all edges meets its smallest neighbour by
    broadcast (:func:`join_unique`). Up to ``SPLIT_FROM`` edges no node can have
    more than a task holds with ease, and a plain join saves jobs.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    def with_lowest(df: DataFrame, edges_of: DataFrame, least: Column, total: int) -> tuple[DataFrame, DataFrame]:
        """``df`` with ``m``, the smallest neighbour of ``u`` among ``edges_of``, and the table of these."""
        low = edges_of.groupBy("u").agg(least.alias("m"), F.count(F.lit(1)).alias("n"))
        if total <= SPLIT_FROM:
            return df.join(low.drop("n"), "u"), low
        low = written(low, "lowest")
        spent.append(low)
        return join_unique(df, low, "u", "n", total).drop("n"), low

    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        spent: list[DataFrame] = []
        joined, _ = with_lowest(both.filter("v > u"), both, F.least(F.min("u"), F.min("v")), 2 * before[0])
        large = written(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        joined, low = with_lowest(large, large, F.min("v"), before[0])
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        then = written(small, "edges")
        for done in (large, now, *spent):
            drop_written(done)
        now, after = then, state(then)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: their Python
    need not have it on its path. A package that already came as an archive
    (``--py-files``) is left alone."""
    sc, root = spark.sparkContext, Path(surfacewx.__file__).parent
    if hasattr(sc, "_surfacewx_shipped") or not root.is_dir():
        return
    folder = tempfile.TemporaryDirectory()  # the driver's own: Spark serves the file to the executors from there
    archive = f"{folder.name}/surfacewx-{sc.applicationId}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._surfacewx_shipped = folder  # goes with the application


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with the package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and, but for single rows
    above it, ``size`` bytes of strings, so that what Python objects take
    grows neither with Spark's batch size nor with the length of texts."""
    for batch in batches:
        total = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(total), 0
        while start < batch.num_rows:
            upto = (ends[start - 1] if start else 0) + size
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, upto, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as text that Spark reads as that name, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def position(df: DataFrame, name: str) -> int:
    """The place of the column that the session takes ``name`` for; Spark's own error if there is none."""
    df.select(name)
    return df.columns.index(name) if name in df.columns else [c.lower() for c in df.columns].index(name.lower())


def wider(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with further columns (name to type) behind."""
    new = df.sparkSession.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns.items()]).schema
    return T.StructType([*df.schema.fields, *new.fields])


#: Bytes to bytes: A-Z to lower case, every other ASCII byte but 0-9 and a-z to a space.
ASCII_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of digits, a-z (A-Z lower-cased) and non-ASCII characters, as UTF-8; null has none."""
    return text.encode().translate(ASCII_WORDS).split() if text else []
