"""What the training-data operators share: appended columns, bounded batches, the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pathloom.operators.components import shared_folder

#: Bytes of text that a Python task holds as Python objects at a time.
SLICE_BYTES = 500_000
#: Rows and bytes of an Arrow batch, unless the session has other values than Spark's own: batches of texts by Spark's
#: values take hundreds of megabytes on both sides of a worker's pipe.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let this session's Arrow batches be small (``BATCH``); values that were set on purpose stay."""
    for key, (usual, own) in BATCH.items():
        if spark.conf.get(key) == usual:
            spark.conf.set(key, own)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns of these names, in any case: an operator's own results replace them."""
    lower = {n.lower() for n in names}
    return df.select(*[df[c] for c in df.columns if c.lower() not in lower])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of ``column``; one row may be longer and comes alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def append_columns(df: DataFrame, text_col: str, fields: list[tuple[str, T.DataType]], start: Callable[[], Callable], *more: str) -> DataFrame:
    """``df`` with further columns computed from ``text_col``, and the columns ``more``, in Arrow batches.

    ``start()`` is called once a task and returns ``values, ... -> {name: list}``, which gets a bounded list of each
    column's values. Columns of the same names that ``df`` has already are replaced; all its other columns pass through.
    """
    small_batches(df.sparkSession)
    names = [n for n, _ in fields]
    base = without(df, *names)
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, t) for n, t in fields]])

    def run(batches):
        work = start()
        for batch in batches:
            for part in slices(batch, text_col):
                made = work(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in (text_col, *more)])
                arrays = [pa.array(made[n], T_ARROW[t.simpleString()]) for n, t in fields]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *names])
            batch = part = arrays = None
            pa.default_memory_pool().release_unused()  # the worker stays for later tasks, its buffers need not

    return base.mapInArrow(run, schema)


T_ARROW = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes an own folder of the shared one, through the file system that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
