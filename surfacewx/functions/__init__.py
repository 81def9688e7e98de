"""Column -> Column builders (all JVM-side, code-generated; no Python UDFs)."""

from surfacewx.functions.decode import (
    parse_int_token,
    parse_int_tokens,
    round_half_up_x10,
    scaled_or_null,
    sentinel_or_null,
    to_sentinel_x10,
    tokens,
)
from surfacewx.functions.format import or_empty, signed_fixed, station_label
from surfacewx.functions.geo import distance_m, latitude_band, longitude_band
from surfacewx.functions.keys import file_base_name, observation_key, station_id_of, station_key

__all__ = [
    "parse_int_token",
    "parse_int_tokens",
    "round_half_up_x10",
    "scaled_or_null",
    "sentinel_or_null",
    "to_sentinel_x10",
    "tokens",
    "or_empty",
    "signed_fixed",
    "station_label",
    "distance_m",
    "latitude_band",
    "longitude_band",
    "file_base_name",
    "observation_key",
    "station_id_of",
    "station_key",
]
