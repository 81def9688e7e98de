"""Readers that turn raw files or driver tables into typed DataFrames."""

from surfacewx.sources.fixtures import (
    observation_raw_from_events,
    observations_from_events,
    station_count,
    stations_from_supplier,
)
from surfacewx.sources.manifest import list_files, packed, read_manifest, read_manifest_lines, write_manifest
from surfacewx.sources.observations import (
    empty_observations,
    parse_observations,
    read_observation_lines,
    read_observations,
    render_observation_lines,
)
from surfacewx.sources.stations import (
    dedupe_last,
    lookup_stations,
    parse_station_lines,
    read_stations,
    render_station_lines,
)

__all__ = [
    "observations_from_events",
    "observation_raw_from_events",
    "stations_from_supplier",
    "station_count",
    "list_files",
    "packed",
    "read_manifest",
    "read_manifest_lines",
    "write_manifest",
    "empty_observations",
    "parse_observations",
    "read_observation_lines",
    "read_observations",
    "render_observation_lines",
    "dedupe_last",
    "lookup_stations",
    "parse_station_lines",
    "read_stations",
    "render_station_lines",
]
