"""What the operators share: the shared folder, written tables, byte arrays of a batch.

Intermediate results that cut lineage are written as Parquet below the folder that
``spark.checkpoint.dir`` names, so they survive the loss of any executor.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, a temporary one, but only if all tasks
    run in the driver: a cluster's machines would not share it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written in the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    back = spark.read.schema(df.schema).parquet(path)
    back._scriptorium_path = path
    return back


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more;
    it learns of them only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def relax() -> None:
    """At the end of a task: what Python and Arrow hold unused goes back to the machine, as
    workers are kept for later tasks of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing lazy refers to any more."""
    for df in tables:
        path = getattr(df, "_scriptorium_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and where each begins (one more entry: the end).

    Nulls are empty. Views the Arrow buffers, so nothing is copied unless there are nulls.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    kind = pa.large_binary()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type).cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    start, end = (int(ends[0]), int(ends[-1]))
    flat = np.frombuffer(data, np.uint8, end)[start:] if data is not None and end else np.zeros(0, np.uint8)
    return flat, ends - start


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """Slices of a batch that hold about ``most_bytes`` of text each, one row at least."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    lengths = pc.binary_length(batch.column(column))
    sizes = np.asarray(pc.fill_null(lengths, 0), np.int64)
    part = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def numbered(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` with its columns numbered, but for those in ``keep``, so that no name can clash.

    ``result.select(*inner.columns).toDF(*df.columns)`` gives them back.
    """
    return df.toDF(*[c if c in keep else f"c{k}" for k, c in enumerate(df.columns)])


def schema_of(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` with the columns of a DDL string added."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(more).fields])


def carried(batch: pa.RecordBatch, schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[n] if n in columns else batch.column(n) for n in schema.names], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix finaliser)."""
    x = np.asarray(x, np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "pages.parquet"))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
