"""The report as one CSV file at the exact path.

The rows are written in parallel as ordered parts beside the target. The parts
are then joined in their order by the Hadoop file system: on HDFS by its
``concat``, which moves no bytes; elsewhere the driver streams them through a
buffer. One rename puts the finished file in its place, so a reader sees the
old file or the new one, and a write that fails leaves the old one as it was.
"""

from __future__ import annotations

import csv
import io
import uuid

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacewx.schema import REPORT_FIELDS
from surfacewx.sinks.csv import _header

_COPY_BUFFER = 4 << 20


def _joined(spark: SparkSession, parts: str, target: str, head: bytes) -> None:
    """Write ``head`` and then the part files of the folder ``parts`` to ``target``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    files = path(target).getFileSystem(conf)
    found = [s for s in files.listStatus(path(parts)) if s.getPath().getName().startswith("part-") and s.getLen() > 0]
    names = sorted(s.getPath().getName() for s in found)
    out = files.create(path(target), True)
    try:
        out.write(head)
    finally:
        out.close()
    if not names:
        return
    sources = spark.sparkContext._gateway.new_array(path, len(names))
    for k, name in enumerate(names):
        sources[k] = path(parts, name)
    try:
        files.concat(path(target), sources)
        return
    except UnsupportedOperationException:  # most file systems but HDFS
        pass
    out = files.create(path(target), True)
    try:
        out.write(head)
        for source in sources:
            part = files.open(source)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, _COPY_BUFFER, False)
            finally:
                part.close()
    finally:
        out.close()


def write_report_file(report: DataFrame, path: str, value_col: str = "wind_speed") -> None:
    """Write a sorted, formatted report as the single CSV file ``path``, with a
    header also where there are no rows.

    The file replaces one of that name; its folder is made if need be. Rows
    keep the order of ``report``. Nothing is written by one task but the
    joining of finished parts.
    """
    spark = report.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop_path = jvm.org.apache.hadoop.fs.Path
    target = hadoop_path(path)
    files = target.getFileSystem(conf)
    target = files.makeQualified(target)
    if files.exists(target) and files.getFileStatus(target).isDirectory():
        raise IsADirectoryError(f"{path} is a folder; write_report_csv writes reports as folders of parts")
    beside = f"{target.getParent()}/_{target.getName()}-{uuid.uuid4().hex}"
    header = io.StringIO()
    csv.writer(header, lineterminator="\n").writerow(_header(value_col))
    try:
        rows = report.select(*[F.col(f) for f in REPORT_FIELDS])
        rows.write.option("header", False).option("emptyValue", "").option("nullValue", "").csv(f"{beside}/parts")
        _joined(spark, f"{beside}/parts", f"{beside}/file", header.getvalue().encode())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(hadoop_path(f"{beside}/file"), target, options)
    finally:
        files.delete(hadoop_path(beside), True)
