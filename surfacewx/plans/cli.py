"""Command line: ``python -m surfacewx DIR OUTPUT LAT LON ELEV RADIUS DELTA --stations CSV``.

Positional arguments are all optional and default to the reference job
(directory ``2008``, report ``./results.txt``, Houston, 12 m, 600 km, 3).
The station catalogue path is required (it is not bundled). Submit with
``spark-submit -m surfacewx`` style wrappers or run directly.
"""

from __future__ import annotations

import argparse
import sys

from surfacewx.schema import DEFAULT_DELTA, DEFAULT_ELEVATION, DEFAULT_LATITUDE, DEFAULT_LONGITUDE, DEFAULT_RADIUS_M


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="surfacewx", description="Report hourly readings above mean + delta * stddev near a point.")
    p.add_argument("directory", nargs="?", default="2008", help="observation files (directory, glob or Parquet table)")
    p.add_argument("output", nargs="?", default="./results.txt", help="report file (with --parts a folder of part files)")
    p.add_argument("latitude", nargs="?", type=float, default=DEFAULT_LATITUDE)
    p.add_argument("longitude", nargs="?", type=float, default=DEFAULT_LONGITUDE)
    p.add_argument("elevation", nargs="?", type=float, default=DEFAULT_ELEVATION)
    p.add_argument("radius", nargs="?", type=float, default=DEFAULT_RADIUS_M, help="metres")
    p.add_argument("delta", nargs="?", type=float, default=DEFAULT_DELTA)
    p.add_argument("--stations", required=True, help="station catalogue CSV")
    p.add_argument("--measure", default="wind_speed", help="observation column to test (default wind_speed)")
    p.add_argument("--mode", default="FAILFAST", choices=["FAILFAST", "DROPMALFORMED", "PERMISSIVE"])
    p.add_argument("--parquet", action="store_true", help="DIRECTORY is an ingested Parquet table")
    p.add_argument("--parts", action="store_true", help="write the report as a folder of ordered part files")
    p.add_argument("--show", action="store_true", help="print the report instead of writing it")
    p.add_argument("--persist", action="store_true", help="parse raw text once (keep parsed rows between the two passes)")
    p.add_argument("--master", default=None, help="Spark master (default: from spark-submit / local[*])")
    return p


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from surfacewx.plans.detect import detect, detect_files
    from surfacewx.plans.ingest import read_observation_table
    from surfacewx.session import ensure_checkpoint_dir
    from surfacewx.plans.table import statistics_match, table_statistics
    from surfacewx.sinks.csv import show_report, write_report_csv
    from surfacewx.sinks.file import write_report_file
    from surfacewx.sources.stations import read_stations

    builder = SparkSession.builder.appName("surfacewx").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if args.master:
        builder = builder.master(args.master)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    centre = (args.latitude, args.longitude, args.elevation, args.radius, args.delta)
    if args.parquet:
        obs = read_observation_table(spark, args.directory)
        kept = table_statistics(spark, args.directory) if statistics_match(spark, args.directory) else None
        report = detect(obs, read_stations(spark, args.stations, mode=args.mode), *centre, value_col=args.measure, statistics=kept)
    else:
        report = detect_files(
            spark, args.directory, args.stations, None, *centre, value_col=args.measure, mode=args.mode, persist=args.persist
        )
    if args.show:
        show_report(report, value_col=args.measure)
    elif args.parts:
        write_report_csv(report, args.output, single_file=False, value_col=args.measure)
    else:
        write_report_file(report, args.output, value_col=args.measure)
    return 0


if __name__ == "__main__":
    sys.exit(main())
