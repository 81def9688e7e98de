"""Incremental ingest of observation files as they arrive (Structured Streaming)."""

from surfacewx.streaming.ingest import observation_stream, start_ingest

__all__ = ["observation_stream", "start_ingest"]
