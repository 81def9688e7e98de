"""Placement of rows on shards by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by a permutation of its
own (an offset and a step drawn from its name). The shards take turns; at its
turn a shard claims the first slot of its order that is still free. So slot
counts differ by one at most, and when a shard comes or goes few slots change
hands. A row's key hashes to a slot, and the table gives the shard: one look
into a broadcast table whose size is a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfacewx.llm.common import quoted

SLOTS = 65537


def _draw(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard (position in ``shards``) of every slot. ``slots`` must be a
    prime, at least the number of shards; names must differ."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must differ, and there must be one")
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table's size must be a prime and no less than the number of shards")
    table = [-1] * slots
    at = [_draw(s, "offset") % slots for s in shards]
    step = [_draw(s, "step") % (slots - 1) + 1 for s in shards]
    for turn in range(slots):
        i = turn % len(shards)
        while table[at[i]] >= 0:
            at[i] = (at[i] + step[i]) % slots
        table[at[i]] = i
    return table


def place(df: DataFrame, shards: Sequence[str], key_cols: Sequence[str] = ("doc_id",), slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` (int) and ``shard`` (string).

    The slot is a hash of the key columns modulo the table's size; null is a
    key like any other, and equal keys always go to the same shard. Nothing
    is shuffled: the table, ``slots`` short rows whatever the input, is
    broadcast. Columns that the session takes for ``slot`` or ``shard`` (``Slot``
    too, unless it is case-sensitive) are replaced, but may be keys. An empty
    table gives an empty result.
    """
    spark = df.sparkSession
    table = spark.createDataFrame([(s, shards[i]) for s, i in enumerate(lookup_table(shards, slots))], "slot int, shard string")
    kept = [quoted(c) for c in df.drop("slot", "shard").columns]
    keyed = df.select(*kept, F.pmod(F.xxhash64(*key_cols), F.lit(slots)).cast("int").alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(*kept, "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """Write rows of :func:`place` as Parquet, one folder per shard. Each
    shard is dealt to ``files_per_shard`` tasks by slot, and the rows of a
    slot again by a hash of the whole row, so a frequent key is no single task."""
    salt = F.pmod(F.xxhash64(*[c for c in placed.columns if placed.schema[c].dataType.typeName() != "map"]), F.lit(files_per_shard))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
