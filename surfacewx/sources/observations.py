"""Hourly observation files: one text file per station and year.

A file is named ``<USAF>-<WBAN>-<year>`` with an optional compression
extension (``.gz`` is decompressed by Spark's text source). Each line holds 12
whitespace-separated integers: year, month, day, hour and 8 measures.

The whole directory is one ``spark.read.text`` scan; identifiers come from
``_metadata.file_name``. A literal station-id predicate on that column prunes
files before they are opened.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacewx.functions.decode import parse_int_tokens, scaled_or_null, sentinel_or_null, tokens, to_sentinel_x10
from surfacewx.functions.keys import observation_key, station_key
from surfacewx.operators.partitioning import spread
from surfacewx.schema import (
    MEASURES,
    MISSING_VALUE,
    OBSERVATION_SCHEMA,
    OBSERVATION_TOKENS,
)

MODES = ("FAILFAST", "DROPMALFORMED", "PERMISSIVE")
CORRUPT_COLUMN = "_corrupt_record"


def parse_observations(
    lines: DataFrame,
    line_col: str = "value",
    observation_id_col: str = "observation_id",
    station_id_col: str | None = "station_id",
    mode: str = "FAILFAST",
    keep: Iterable[str] = (),
) -> DataFrame:
    """Decode observation lines into OBSERVATION_SCHEMA columns.

    ``lines`` has one text line per row plus an observation-id column (and
    optionally a station-id column; derived from the observation id when
    ``station_id_col`` is None or absent). ``keep`` names extra input columns
    carried through unchanged.

    A line is malformed when it has fewer than 12 tokens or any token (extras
    included) is not an integer. Modes: FAILFAST raises on a malformed line;
    DROPMALFORMED drops it; PERMISSIVE keeps it with NULL fields and the raw
    line in ``_corrupt_record``. The -9999 sentinel is mapped to NULL only
    after the malformed test, so an absent value is never mistaken for a bad one.

    Each line is split and its tokens converted once, into an int array that
    the output columns index (one projection per step, so Catalyst does not
    inline the split into every field). The conversion is an element-wise
    ``try_cast`` of the whole array and the "any bad token" test looks at the
    first element of the ascending ``sort_array`` (NULLs sort first): no
    lambda functions, so every step stays in whole-stage code generation.
    """
    mode = mode.upper()
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    keep = list(keep)
    has_station = station_id_col is not None and station_id_col in lines.columns
    carried = [observation_id_col, *([station_id_col] if has_station else []), *keep]
    line = F.col(line_col)

    step = lines.select(*[F.col(c) for c in carried], line.alias("_line"), tokens(line).alias("_tok"))
    step = step.select("*", parse_int_tokens(F.col("_tok")).alias("_int"))
    bad = (F.size("_tok") < OBSERVATION_TOKENS) | F.get(F.sort_array(F.col("_int")), 0).isNull()
    # One value array per line; the 12 fields only index it.
    if mode == "FAILFAST":
        message = F.concat(F.lit("Malformed observation line: "), F.col("_line"))
        values = F.when(bad, F.raise_error(message)).otherwise(F.col("_int"))
        # A generator always evaluates its input, so the check runs even when
        # no field is read (e.g. a bare count).
        step = step.select(*carried, F.explode(F.array(values)).alias("_v"))
    elif mode == "DROPMALFORMED":
        # Drop through a generator (zero or one copy of the parsed array):
        # a Filter on the flag would be pushed below the projections and
        # split every line again.
        step = step.select(*carried, F.explode(F.when(~bad, F.array(F.col("_int")))).alias("_v"))
    else:
        step = step.select(*carried, F.when(~bad, F.col("_int")).alias("_v"), F.when(bad, F.col("_line")).alias(CORRUPT_COLUMN))

    def field(i: int) -> Column:
        return F.get(F.col("_v"), i)

    station = F.col(station_id_col) if has_station else station_key(F.col(observation_id_col))
    cols = [
        F.col(observation_id_col).alias("observation_id"),
        station.alias("station_id"),
        field(0).alias("year"),
        field(1).alias("month"),
        field(2).alias("day"),
        field(3).alias("hour"),
    ]
    for i, (name, kind) in enumerate(MEASURES):
        r = field(4 + i)
        decoded = scaled_or_null(r) if kind == "double" else sentinel_or_null(r)
        cols.append(decoded.cast(kind).alias(name))
        if name == "wind_speed":
            cols.append(sentinel_or_null(r).alias("wind_speed_x10"))
    if mode == "PERMISSIVE":
        cols.append(F.col(CORRUPT_COLUMN))
    return step.select(*cols, *[F.col(k) for k in keep])


def read_observation_lines(
    spark: SparkSession,
    path: str | list[str],
    station_ids: Iterable[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Raw lines of every observation file under ``path`` (one directory, a
    glob, or a list of them) with ``observation_id`` and ``station_id``.

    Names without a ``-`` are not observation files and are skipped. With
    ``station_ids`` (literal ids) the scan opens only those stations' files.
    Lines stay in the tasks that read them; gzip files cannot be split, so
    where there are far fewer files than cores ``partitions`` can spread the
    lines before they are parsed.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.format("text").load(paths)
    df = df.select(
        "value",
        observation_key(F.col("_metadata.file_name")).alias("observation_id"),
    ).withColumn("station_id", station_key(F.col("observation_id")))
    df = df.filter(F.col("station_id").isNotNull())
    if station_ids is not None:
        ids = sorted(set(station_ids))
        df = df.filter(F.col("station_id").isin(ids))
    return spread(df, partitions)


def read_observations(
    spark: SparkSession,
    path: str | list[str],
    station_ids: Iterable[str] | None = None,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Typed observations (OBSERVATION_SCHEMA) of every file under ``path``."""
    return parse_observations(read_observation_lines(spark, path, station_ids), mode=mode)


def empty_observations(spark: SparkSession) -> DataFrame:
    """An empty relation with OBSERVATION_SCHEMA (the neutral element of union)."""
    return spark.createDataFrame([], OBSERVATION_SCHEMA)


def _padded(c: Column, width: int, fill: str) -> Column:
    """Integer text right-aligned to ``width`` (never truncated), like ``%Nd``
    (fill ' ') or ``%0Nd`` (fill '0', non-negative values)."""
    t = c.cast("string")
    return F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, fill))


def render_observation_lines(obs: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Inverse of parse_observations: typed rows -> (observation_id, value) text lines.

    Layout: 4-digit year, 2-digit month, day and hour separated by blanks,
    then each measure right-aligned in 6 characters. NULL measures become the
    sentinel; tenths measures are scaled back with round-half-up, integer
    measures are written as they are. Built from ``lpad``/``concat`` (a
    ``format_string`` per row is several times slower).
    """
    parts = [
        _padded(F.col("year"), 4, "0"),
        F.lit(" "),
        _padded(F.col("month"), 2, "0"),
        F.lit(" "),
        _padded(F.col("day"), 2, "0"),
        F.lit(" "),
        _padded(F.col("hour"), 2, "0"),
    ]
    for name, kind in MEASURES:
        c = F.col(name)
        raw = to_sentinel_x10(c) if kind == "double" else F.coalesce(c, F.lit(MISSING_VALUE))
        parts.append(_padded(raw, 6, " "))
    line = F.concat(*parts)
    return obs.select(F.col("observation_id"), F.col("station_id"), line.alias("value"), *[F.col(k) for k in keep])

