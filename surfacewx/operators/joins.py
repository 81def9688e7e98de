"""Joins of observations (fact side) with stations (dimension side).

The dimension is broadcast only after its size has been checked against a
bound. Above the bound the join is a shuffle join that splits hot keys, so a
station holding a large share of all observations is spread over many tasks
instead of landing in one: by adaptive execution's skew-join handling when
the session has it on (it splits only the oversized partitions, from runtime
shuffle statistics, and copies only the matching dimension partition), else
by salting the fact side and replicating the dimension once per salt.
``surfacewx.join.skew`` = ``auto`` (default) | ``aqe`` | ``salt`` chooses.
Before that shuffle, joins that keep only matching rows drop most others, if
asked (``prefiltered`` or ``surfacewx.join.prefilter`` = ``true``), by a
broadcast Bloom filter of the dimension's keys (``operators.prefilter``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surfacewx.operators.prefilter import can_prefilter, prefilter

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
DEFAULT_SALT_BUCKETS = 32


def _max_bytes(df: DataFrame, max_bytes: int | None) -> int:
    if max_bytes is not None:
        return max_bytes
    conf = df.sparkSession.conf.get("surfacewx.broadcast.maxBytes", None)
    return int(conf) if conf else DEFAULT_BROADCAST_BYTES


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of ``df``, in one aggregate: 16 bytes a row and 8 a
    field, and what strings, binaries and nested values really hold."""
    width = F.lit(16 + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            width = width + 8 * F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return int(n), int(size)


def checked_broadcast(df: DataFrame, max_bytes: int | None = None, max_rows: int | None = None) -> tuple[DataFrame, bool]:
    """``(broadcast(df), True)`` when ``df`` fits the bound, else ``(df, False)``.

    Rows and bytes are measured by a plain aggregate (one partial result per
    task crosses the exchange); a ``limit(bound + 1).count()`` would instead
    funnel up to ``bound + 1`` rows from every task into a single one.
    """
    n, size = measured(df)
    if size <= _max_bytes(df, max_bytes) and (max_rows is None or n <= max_rows):
        return F.broadcast(df), True
    return df, False


def salted_join(
    fact: DataFrame,
    dim: DataFrame,
    fact_key: str,
    dim_key: str,
    how: str = "inner",
    buckets: int = DEFAULT_SALT_BUCKETS,
    salt_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Shuffle join with a salted fact side and a replicated dimension side.

    Every fact row gets a deterministic salt (a hash of ``salt_cols``, so a
    retried task reproduces it) in ``[0, buckets)``; without ``salt_cols`` it
    is of the whole row, which keeps every column in the scan; every dimension row is
    repeated once per salt. A hot key is thereby split into ``buckets``
    shuffle partitions. ``how`` is any join type that preserves or filters the
    fact side (inner, left, left_semi, left_anti).
    """
    names = salt_cols or [f.name for f in fact.schema.fields if not isinstance(f.dataType, T.MapType)]
    hashable = [F.col(c) for c in names]
    salt = F.pmod(F.xxhash64(*hashable), F.lit(buckets)).cast("int")
    f = fact.withColumn("_salt", salt)
    d = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    cond = (f[fact_key] == d[dim_key]) & (f["_salt"] == d["_salt"])
    out = f.join(d, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return out.drop("_salt")
    return out.drop(f["_salt"]).drop(d["_salt"])


def dimension_join(
    fact: DataFrame,
    dim: DataFrame,
    fact_key: str,
    dim_key: str | None = None,
    how: str = "inner",
    max_bytes: int | None = None,
    buckets: int = DEFAULT_SALT_BUCKETS,
    salt_cols: Sequence[str] | None = None,
    prefiltered: bool = False,
) -> DataFrame:
    """Join a fact side with a dimension: broadcast when the dimension is
    provably small, otherwise a shuffle join that splits hot keys (adaptive
    skew join, or salting; see the module docstring).

    With equal key names the key appears once in the output.
    """
    dim_key = dim_key or fact_key
    if fact_key == dim_key:
        # Rename so both paths give the fact columns first, then the
        # dimension's, with the key once (the fact side's).
        dim = dim.withColumnRenamed(dim_key, "_dim_key")
        dim_key = "_dim_key"
    n, size = measured(dim)
    if size <= _max_bytes(dim, max_bytes):
        small = F.broadcast(dim)
        out = fact.join(small, F.col(fact_key) == small[dim_key], how)
        return out.drop("_dim_key") if "_dim_key" in out.columns else out
    wanted = prefiltered or (fact.sparkSession.conf.get("surfacewx.join.prefilter", None) or "false").lower() == "true"
    if wanted and how in ("inner", "left_semi") and can_prefilter(fact, dim, fact_key, dim_key, n):
        fact = prefilter(fact, dim, fact_key, dim_key, n)
        if how == "left_semi":
            # Catalyst would push a semi join below the filter's join; an inner join with distinct keys stays above.
            # Dealt by another hash, the keys get an exchange of their own, which adaptive skew handling needs.
            keys = dim.select(dim_key).distinct().repartition(F.xxhash64(dim_key))
            keys = keys.withColumnRenamed(dim_key, "_selected_key")
            return _shuffle_join(fact, keys, fact_key, "_selected_key", "inner", buckets, salt_cols).drop("_selected_key")
    out = _shuffle_join(fact, dim, fact_key, dim_key, how, buckets, salt_cols)
    return out.drop("_dim_key") if "_dim_key" in out.columns else out


def _shuffle_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, how: str, buckets: int, salt_cols: Sequence[str] | None) -> DataFrame:
    """The join above the broadcast bound, by whichever way splits hot keys here."""
    if _skew_strategy(fact) == "aqe":
        return fact.join(dim, F.col(fact_key) == dim[dim_key], how)
    return salted_join(fact, dim, fact_key, dim_key, how, buckets, salt_cols)


def _skew_strategy(df: DataFrame) -> str:
    """``aqe`` when adaptive skew-join handling is on (and not overridden),
    else ``salt``."""
    conf = df.sparkSession.conf
    choice = (conf.get("surfacewx.join.skew", None) or "auto").lower()
    if choice in ("aqe", "salt"):
        return choice
    aqe = conf.get("spark.sql.adaptive.enabled", "true").lower() == "true"
    skew = conf.get("spark.sql.adaptive.skewJoin.enabled", "true").lower() == "true"
    return "aqe" if aqe and skew else "salt"


def semi_join(obs: DataFrame, selected: DataFrame, key: str = "station_id", selected_key: str | None = None, max_bytes: int | None = None, prefiltered: bool = False) -> DataFrame:
    """Observations whose station is among ``selected`` (left semi join).

    Duplicate ids on the selected side change nothing for a semi join, so
    they are not removed (no extra shuffle)."""
    sk = selected_key or key
    return dimension_join(obs, selected.select(sk), key, sk, "left_semi", max_bytes, prefiltered=prefiltered)


def enrich(records: DataFrame, stations: DataFrame, key: str = "station_id", station_key: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Left join of records with station metadata: an unknown station keeps
    its record, with the metadata left NULL."""
    sk = station_key or key
    if columns is not None:
        stations = stations.select(sk, *[c for c in columns if c != sk])
    return dimension_join(records, stations, key, sk, "left")
