"""Report sinks."""

from __future__ import annotations

import csv
import sys
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfacewx.schema import REPORT_COLUMNS, REPORT_FIELDS, VALUE_FIELD, measure_header

def _header(value_col: str) -> list[str]:
    return [measure_header(value_col) if f == VALUE_FIELD else h for f, h in zip(REPORT_FIELDS, REPORT_COLUMNS)]


def write_report_csv(report: DataFrame, path: str, single_file: bool = True, value_col: str = "wind_speed") -> None:
    """Write a sorted, formatted report as CSV with the report header.

    ``path`` is an output directory (replaced). The rows keep the order of
    ``report``: with ``single_file`` the order-preserving ``coalesce(1)``
    gives one part file, written by one task whatever its size; without it
    the range-sorted partitions become ordered part files, as a very large
    report needs. A header is written even without rows; ``value_col`` names
    its value column.
    """
    out = report.select(*[F.col(f).alias(h) for f, h in zip(REPORT_FIELDS, _header(value_col))])
    if single_file:
        out = out.coalesce(1)
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("emptyValue", "")
        .option("nullValue", "")
        .csv(path)
    )


def write_report_stream(report: DataFrame, stream: TextIO, value_col: str = "wind_speed") -> int:
    """Write the report as CSV lines to a text stream; returns the row count.

    Rows arrive one partition at a time (``toLocalIterator``), so the driver
    holds one partition, never the whole report.
    """
    w = csv.writer(stream, lineterminator="\n")
    w.writerow(_header(value_col))
    n = 0
    for row in report.select(*REPORT_FIELDS).toLocalIterator():
        w.writerow(["" if v is None else v for v in row])
        n += 1
    stream.flush()
    return n


def show_report(report: DataFrame, stream: TextIO | None = None, value_col: str = "wind_speed") -> int:
    """Print the report (header and every row) to the screen."""
    return write_report_stream(report, stream or sys.stdout, value_col)
