"""GEOEAS text files: a title, the number of columns, their names, then rows of numbers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names. The file is read by Spark's own readers, so any Hadoop file system holds it."""
    head = [r["value"] for r in spark.read.text(path).limit(2).collect()]
    if len(head) < 2 or not head[1].split() or not head[1].split()[0].isdigit():
        raise ValueError(f"{path}: the second line must begin with the number of columns")
    n = int(head[1].split()[0])
    names = [r["value"].strip() for r in spark.read.text(path).limit(n + 2).collect()[2:]]
    if len(names) < n:
        raise ValueError(f"{path}: {n} names are announced, {len(names)} are there")
    return names


def read_geoeas(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """The file as doubles with a column _row, its rows' order; rows: how many of the first are wanted.

    Lines are numbered within the file by their offset order; header lines go by number, so a file of any size is split
    and only the first lines are looked at on the driver.
    """
    names = _header(spark, path)
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_at"))
    heads = lines.orderBy("_at").limit(len(names) + 2).select("_at")
    body = lines.join(F.broadcast(heads), "_at", "left_anti").where(F.trim("value") != "")  # len(names) + 2 rows
    parts = F.split(F.trim("value"), r"\s+")
    frame = body.select(F.col("_at").alias("_row"), *(F.get(parts, F.lit(n)).cast("double").alias(c) for n, c in enumerate(names)))
    return frame.orderBy("_row").limit(rows) if rows is not None else frame


def number(x: float) -> str:
    return f"{x:.8g}"


def write_geoeas(frame: DataFrame, path: str, order: str, columns: list[str] | None = None, title: str = "saved data") -> None:
    """Writes the columns as one GEOEAS file below path, numbers with eight significant digits, rows in the order of a
    column. One file has one writer: rows stream through it, sorted beforehand by ranges."""
    columns = columns or [c for c in frame.columns if c != order]
    head = [title, str(len(columns)), *columns]

    def lines(batches):
        for batch in batches:
            values = [batch.column(1 + n).to_numpy(zero_copy_only=False).tolist() for n in range(len(columns))]  # a null is nan
            text = [" ".join(map(number, row)) for row in zip(*values, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["o", "value"])

    kind = frame.select(F.col(order).alias("o")).schema
    rows = frame.select(F.col(order).alias("o"), *(F.col(c).cast("double") for c in columns))
    body = rows.mapInArrow(lines, StructType([*kind, StructField("value", StringType())])).select(F.lit(len(head)).alias("a"), "o", "value")
    first = frame.sparkSession.createDataFrame(list(enumerate(head)), "a int, value string")
    first = first.select("a", F.lit(None).cast(kind["o"].dataType).alias("o"), "value")
    first.unionByName(body).orderBy("a", "o").select("value").coalesce(1).write.mode("overwrite").text(path)


class GeoeasReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        with open(self.path) as lines:
            for n, line in enumerate(lines):
                if n >= len(self.names) + 2 and line.strip():
                    yield tuple(map(float, line.split()))


class GeoeasSource(DataSource):
    """spark.read.format("geoeas") for a local file of a single machine; read_geoeas() is the distributed way."""

    @classmethod
    def name(cls) -> str:
        return "geoeas"

    def _names(self) -> list[str]:
        with open(self.options["path"]) as lines:
            next(lines)
            n = int(next(lines).split()[0])
            return [next(lines).strip() for _ in range(n)]

    def schema(self):
        return StructType([StructField(c, DoubleType()) for c in self._names()])

    def reader(self, schema):
        return GeoeasReader(self.options["path"], self._names())
