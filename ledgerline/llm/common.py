"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_checkpoints(spark: SparkSession) -> None:
    """Sets a checkpoint folder where a session on one machine has none, as in tests; elsewhere one must be configured."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import re
        import tempfile

        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder and read from there."""
    own_checkpoints(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, as a path for Spark's readers and writers."""
    import uuid

    own_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder, whose size Spark knows when it plans a join with it."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder of shared_folder() that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: MB of a batch that a task turns into Python objects at once; all slices of a batch are worked on.
SLICE_MB = 2


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = max(1, int(b.num_rows * SLICE_MB * 2**20 / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends its rows to Python workers 4 MB at a time; as Spark has it, an executor and its workers hold 10,000 rows or 64 MB for each core."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "4m")
    try:
        yield
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)


def released() -> None:
    """Gives what a task has freed back to the system; workers live on, and an executor has several."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def with_arrow_column(df: DataFrame, name: str, kind: T.DataType, make: Callable[..., pa.Array], needs: list[str], end: Callable[[], None] | None = None) -> DataFrame:
    """All columns and one more, made for each Arrow batch from the columns in needs; end() frees what make keeps in a task."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in slices(batches):
                yield pa.RecordBatch.from_arrays([*b.columns, make(*(b.column(c) for c in needs))], names=[*b.schema.names, name])
        finally:  # workers live on, with later stages in them
            if end:
                end()
            released()

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 10; a null id is training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of an ASCII expression, bit by bit."""
    steps = "list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: case when d & 1 = 1 then xor(d >> 1, 3988292384) else d >> 1 end)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), lambda c, b: {steps}), 4294967295)"
