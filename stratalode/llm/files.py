"""Raw binary files through Spark's own writers and readers, so any Hadoop file system holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path


def write_files(frame: DataFrame, tag: str, end: bytes) -> str:
    """Writes each row (shelf long, blob binary) as one file that holds the blob and then end; returns the folder, with
    a directory for each shelf.

    Spark's text writer puts the bytes of a value and a line end: the line end here is the format's closing magic, so
    a file ends as its format demands. Files appear when Spark commits the task that wrote them.
    """
    path = new_path(frame.sparkSession, tag)
    rows = frame.select("shelf", F.col("blob").cast("string").alias("value"))
    rows.write.partitionBy("shelf").option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).text(path)
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(content) of every file below the folder; none gives no rows."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
