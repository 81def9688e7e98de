"""Composed jobs: detection, ingest, command line, and the query registry."""
