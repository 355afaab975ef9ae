"""What the operators share: the shared folder, staged tables, Arrow batches cut to a bounded size."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that Spark hands to Python; whole texts are in them, so few rows bound the memory.
BATCH_ROWS = 1000
#: Bytes of text that one vectorised step works on (a longer single text is one step).
SLICE_BYTES = 1 << 20

_local: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local master gets a temporary folder; a cluster is an error, as no machine-local folder would do.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="stratalode-")
    return _local[context.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/stratalode-{uuid.uuid4().hex}/{tag}"
    _written.append((spark, path.rpartition("/")[0]))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the JVM may be gone: what is left in the shared folder is temporary
            return


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path made by new_path before the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(frame: DataFrame, tag: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = frame.sparkSession
    path = new_path(spark, tag)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose frames are gone, before the next large step writes its own."""
    for _ in range(2):  # Python lets go of its frames, then the JVM of the plans behind them
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Rows of a batch that later jobs of the session hand to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A class of more than one in so many rows is looked up by broadcast; there are fewer such classes than that.
LARGE = 1000


def of_class(rows: DataFrame, classes: DataFrame, value: str) -> DataFrame:
    """rows (mark, ...) with the value of their class (mark, n, value), where n counts its rows; null without a class.

    Rows of large classes, and rows without a mark, aren't shuffled, so no task gets all of them.
    """
    total = classes.agg(F.sum("n")).first()[0] or 0
    large = classes.where(F.col("n") * LARGE > total).select(F.col("mark").alias("_mark"), F.col(value).alias("_value"))
    rows = rows.join(F.broadcast(large), F.col("mark") == F.col("_mark"), "left").drop("_mark")
    there = rows.where("_value is not null or mark is null").withColumnRenamed("_value", value)
    rest = rows.where("_value is null and mark is not null").drop("_value")
    return there.unionByName(rest.join(classes.where(F.col("n") * LARGE <= total).select("mark", value), "mark", "left"))


def only(frame: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone; a missing one is null, so clashing or extra columns of the input never matter."""
    kinds = {"text": "string", "html": "string", "url": "string"}
    return frame.select(*(F.col(f"`{c}`").cast(kinds.get(c, "long")).alias(c) if c in frame.columns else F.lit(None).cast(kinds.get(c, "long")).alias(c) for c in columns))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of whole rows with about limit bytes of text each."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield slice(row, stop), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary Arrow array over one buffer."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def rows_of(array: np.ndarray) -> pa.Array:
    """Each row of a two-dimensional array as one binary value."""
    array = np.ascontiguousarray(array)
    width = array.dtype.itemsize * array.shape[1]
    return binary_array(array.view(np.uint8).reshape(-1), np.arange(len(array) + 1, dtype=np.int64) * width)


def rows_from(values: pa.Array, dtype, width: int) -> np.ndarray:
    """The inverse of rows_of, for a column without nulls."""
    values = values.cast(pa.large_binary())
    if not len(values):
        return np.empty((0, width), dtype)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(len(values), width)
