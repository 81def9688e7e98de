"""Where a report goes: a CSV file, the screen, or any text stream."""

from surfacewx.sinks.csv import show_report, write_report_csv, write_report_stream

__all__ = ["show_report", "write_report_csv", "write_report_stream"]
