"""Station catalogue: a CSV file with a header and every field in quotes.

Fields are read as text and decoded by expressions: empty text means NULL,
coordinates are signed zero-padded decimals, dates are ``yyyyMMdd`` and are
mandatory. When the same ``USAF-WBAN`` appears more than once, the later line
wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacewx.functions.format import signed_fixed
from surfacewx.functions.keys import station_id_of
from surfacewx.schema import (
    ELEVATION_FORMAT,
    LATITUDE_FORMAT,
    LONGITUDE_FORMAT,
    STATION_COLUMNS,
    STATION_CSV_FIELDS,
    STATION_CSV_SCHEMA,
    STATION_DATE_FORMAT,
)

LINE_ORDER = "_line_order"


def _text_or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _mandatory_date(c: Column, name: str, mode: str) -> Column:
    if mode == "PERMISSIVE":
        return F.try_to_date(c, STATION_DATE_FORMAT)
    parsed = F.try_to_date(c, STATION_DATE_FORMAT)
    return F.when(
        parsed.isNull(),
        F.raise_error(F.concat(F.lit(f"Bad station {name} date: "), F.coalesce(c, F.lit("<empty>")))),
    ).otherwise(parsed)


def _double(c: Column, name: str, mode: str) -> Column:
    """Empty -> NULL, else a double (``+29.980``, ``-095.360`` accepted).

    Junk raises in FAILFAST and becomes NULL in PERMISSIVE, whatever the
    session's ANSI setting.
    """
    t = _text_or_null(c)
    v = t.try_cast("double")
    if mode == "PERMISSIVE":
        return v
    return F.when(
        t.isNotNull() & v.isNull(), F.raise_error(F.concat(F.lit(f"Bad station {name}: "), t))
    ).otherwise(v)


def _decodable(f: dict[str, Column]) -> Column:
    """Whether the coordinates (empty or a number) and both dates decode."""
    ok = F.lit(True)
    for name in ("latitude", "longitude", "elevation"):
        t = _text_or_null(f[name])
        ok = ok & (t.isNull() | t.try_cast("double").isNotNull())
    for name in ("begin", "end"):
        ok = ok & F.try_to_date(f[name], STATION_DATE_FORMAT).isNotNull()
    return ok


def decode_station_fields(raw: DataFrame, mode: str = "FAILFAST", keep: Iterable[str] = ()) -> DataFrame:
    """Text fields (STATION_CSV_FIELDS) -> STATION_SCHEMA columns.

    FAILFAST raises on a bad coordinate or date; PERMISSIVE leaves it NULL;
    DROPMALFORMED drops the line.
    """
    mode = mode.upper()
    f = {name: F.col(name) for name in STATION_CSV_FIELDS}
    if mode == "DROPMALFORMED":
        raw = raw.filter(_decodable(f))
        mode = "PERMISSIVE"
    usaf = F.coalesce(f["usaf"], F.lit(""))
    wban = F.coalesce(f["wban"], F.lit(""))
    return raw.select(
        station_id_of(usaf, wban).alias("station_id"),
        usaf.alias("usaf"),
        wban.alias("wban"),
        _text_or_null(f["station_name"]).alias("station_name"),
        _text_or_null(f["country"]).alias("country"),
        _text_or_null(f["state"]).alias("state"),
        _text_or_null(f["icao"]).alias("icao"),
        _double(f["latitude"], "latitude", mode).alias("latitude"),
        _double(f["longitude"], "longitude", mode).alias("longitude"),
        _double(f["elevation"], "elevation", mode).alias("elevation"),
        _mandatory_date(f["begin"], "begin", mode).alias("begin"),
        _mandatory_date(f["end"], "end", mode).alias("end"),
        *[F.col(k) for k in keep],
    )


def dedupe_last(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """Keep, for every key, the row with the greatest ``order`` (the last line).

    An aggregate with ``max_by`` (sort-based, as its buffer is a struct) with
    partial aggregation map-side, so a key repeated on a third of all rows is
    collapsed to one row per task before the shuffle instead of being
    gathered into one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    order_expr = F.struct(*[F.col(o) for o in orders]) if len(orders) > 1 else F.col(orders[0])
    winner = F.max_by(F.struct(*[F.col(c) for c in rest]), order_expr).alias("_w")
    return df.groupBy(*keys).agg(winner).select(*keys, *[F.col("_w." + c).alias(c) for c in rest])


def read_stations(
    spark: SparkSession,
    path: str | list[str],
    mode: str = "FAILFAST",
    dedupe: bool = True,
    materialize: bool = True,
) -> DataFrame:
    """STATION_SCHEMA rows of the catalogue file(s), last line winning per id.

    The line order comes from a per-task row id, which Spark treats as
    nondeterministic; left in the lineage it would keep the optimizer from
    pushing filters that depend on the stations (such as the outlier
    threshold) into the observation scan. With ``materialize`` (default) the
    de-duplicated catalogue is checkpointed to the session's checkpoint
    directory: the CSV is parsed once, and the result is fixed even if a task
    is retried later.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = (
        spark.read.schema(STATION_CSV_SCHEMA)
        .option("header", True)
        .option("enforceSchema", True)
        .option("escape", '"')  # a backslash is text
        .option("mode", "PERMISSIVE")  # fields beyond the last are ignored, missing ones decode as empty
        .csv(paths)
    )
    # Line order: file, split start, then position inside the split (the id
    # increases in read order within a task).
    raw = raw.withColumn(
        LINE_ORDER,
        F.struct(
            F.col("_metadata.file_path").alias("f"),
            F.col("_metadata.file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("i"),
        ),
    )
    stations = decode_station_fields(raw, mode, keep=[LINE_ORDER])
    if not dedupe:
        return stations.select(*STATION_COLUMNS)
    stations = dedupe_last(stations, "station_id", LINE_ORDER).select(*STATION_COLUMNS)
    if materialize:
        from surfacewx.session import materialize as checkpointed

        stations = checkpointed(stations)
    return stations


def parse_station_lines(lines: DataFrame, line_col: str = "value", mode: str = "FAILFAST", keep: Iterable[str] = ()) -> DataFrame:
    """Decode catalogue CSV lines held in a column (no header) into STATION_SCHEMA."""
    ddl = ", ".join(f"`{n}` STRING" for n in STATION_CSV_FIELDS)
    parsed = lines.select(F.from_csv(F.col(line_col), ddl, {"escape": '"'}).alias("_r"), *[F.col(k) for k in keep])
    return decode_station_fields(parsed.select("_r.*", *keep), mode, keep=keep)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))


def station_text(stations: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Inverse of decode_station_fields: STATION_SCHEMA rows -> STATION_CSV_FIELDS as text."""
    rendered = {
        "latitude": F.nullif(signed_fixed("latitude", LATITUDE_FORMAT), F.lit("")),
        "longitude": F.nullif(signed_fixed("longitude", LONGITUDE_FORMAT), F.lit("")),
        "elevation": F.nullif(signed_fixed("elevation", ELEVATION_FORMAT), F.lit("")),
        "begin": F.date_format("begin", STATION_DATE_FORMAT),
        "end": F.date_format("end", STATION_DATE_FORMAT),
    }
    return stations.select(*[rendered.get(n, F.col(n)).alias(n) for n in STATION_CSV_FIELDS], *[F.col(k) for k in keep])


def render_station_lines(stations: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Inverse of parse_station_lines: STATION_SCHEMA rows -> quoted CSV lines."""
    keep = list(keep)
    line = F.concat_ws(",", *[_quoted(F.col(n)) for n in STATION_CSV_FIELDS])
    return station_text(stations, keep).select(line.alias("value"), *[F.col(k) for k in keep])


def lookup_stations(stations: DataFrame, ids: Iterable[str]) -> DataFrame:
    """Point lookup of literal station ids: an IN filter, which a Parquet scan
    gets pushed where ``station_id`` is a stored column."""
    return stations.filter(F.col("station_id").isin(sorted(set(ids))))
