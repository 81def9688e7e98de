"""Counters and bit maps of a fixed size over a whole table, for broadcast.

Their size is a parameter and does not grow with the data. They only order
or pre-filter: what they let through is counted or verified exactly later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfacewx.llm.common import mapped

#: A sketch travels in so many parts, and each part is summed in one task.
PARTS = 64
_CODEC = "zstd"


class Counts:
    """``2**bits`` counters of one task, fed with arrays of buckets."""

    def __init__(self, bits: int):
        self.counts, self.held, self.size = np.zeros(1 << bits, np.uint32), [], 0

    def add(self, buckets: np.ndarray) -> None:
        self.held.append(buckets)
        self.size += len(buckets)
        if self.size >= 1 << 20:
            self._settle()

    def _settle(self) -> None:
        if self.held:
            at, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.counts[at.astype(np.int64)] += n.astype(np.uint32)
        self.held, self.size = [], 0

    def parts(self) -> list[bytes]:
        """The counters in ``PARTS`` compressed pieces."""
        self._settle()
        return [pa.compress(x.tobytes(), codec=_CODEC, asbytes=True) for x in np.split(self.counts, PARTS)]


def summed(parts: DataFrame, bits: int, finish: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``finish`` of the sums of all tasks' counters, a byte each.

    ``parts(part int, payload binary)`` holds what :meth:`Counts.parts` gave;
    each part is summed in a task of its own, and 2**bits bytes reach the
    driver. Without rows, ``finish`` of zeros."""
    width = (1 << bits) // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = pa.decompress(payload.as_buffer(), decompressed_size=4 * width, codec=_CODEC, asbytes=True)
                sums.setdefault(part, np.zeros(width, np.int64))
                sums[part] += np.frombuffer(raw, np.uint32)
        if sums:
            made = [finish(x).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(made, pa.binary())], names=["part", "payload"])

    out = np.tile(finish(np.zeros(1, np.int64)).astype(np.uint8), 1 << bits)
    for r in mapped(parts.repartition(PARTS, "part"), run, "part int, payload binary").collect():
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(r.payload, np.uint8)
    return out


def bitmap(buckets: DataFrame, bits: int) -> np.ndarray:
    """``2**bits`` bits, packed: 1 where ``buckets(bucket long)`` has a row."""
    width = 1 << max(bits - 8, 3)
    rows = buckets.select(F.expr(f"bucket div {width}").cast("int").alias("part"), (F.col("bucket") % width).cast("int").alias("at")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            part, at = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for p in np.unique(part):
                found.setdefault(int(p), np.zeros(width, bool))[at[part == p]] = True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(x).tobytes() for x in found.values()], pa.binary())], names=["part", "payload"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in mapped(rows.repartition("part"), run, "part int, payload binary").collect():
        out[r.part * width // 8 : (r.part + 1) * width // 8] |= np.frombuffer(r.payload, np.uint8)
    return out


def has(bits: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Which ``buckets`` are set in a packed bit map."""
    at = buckets.astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
