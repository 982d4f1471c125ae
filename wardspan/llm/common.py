"""What the operators share: shared-folder tables, code shipping, Arrow helpers, global ranks."""

from __future__ import annotations

import ctypes
import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: space and the control characters 9 to 13.
BLANKS = b" \t\n\x0b\x0c\r"
#: A word, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a new one where that is unset (local runs)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wardspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/wardspan/{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_wardspan_run_dir", None) != path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        spark.sparkContext._wardspan_run_dir = path
    return path


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors, fixes nondeterminism."""
    path = f"{run_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    (df.write if codec is None else df.write.option("compression", codec)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that cut() wrote in this application; frames that still read them fail afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark.sparkContext._wardspan_run_dir = None


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per session."""
    if getattr(spark.sparkContext, "_wardspan_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(top.parent))), p.read_bytes())
    name = f"wardspan-{hashlib.sha256(data.getvalue()).hexdigest()[:16]}.zip"
    path = os.path.join(tempfile.mkdtemp(prefix="wardspan-code-"), name)
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)  # the driver serves it to the executors
    spark.sparkContext._wardspan_shipped = True


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Rows of whole texts go to Python in batches of so many rows and bytes at most (one longer text is a batch of its own).

    Both are settings of the session, read when a query runs, so they stay set.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if spark.conf.get(key) != str(most):
            spark.conf.set(key, str(most))


def lean() -> None:
    """Have this worker give freed memory back: arrays of a megabyte or more are mapped one by one (glibc would raise that bound
    to 32 MB and keep what is freed below), and Arrow's pool keeps nothing that is unused."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    pa.default_memory_pool().release_unused()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups of a partition that is sorted by the key, of so many rows at least but for the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows > least:
            keys = b.column(key).to_numpy()
            at = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if at or (len(held) > 1 and held[-2].column(key)[-1].as_py() != keys[0]):
                yield pa.Table.from_batches([*held[:-1], b.slice(0, at)])
                held, rows = [b.slice(at)], b.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit keys made into others that look random."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def binary(name: str) -> Column:
    """A text's bytes, empty for null: Python then meets no invalid UTF-8."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary").alias(name)


def raw(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """All bytes of a binary or string column without nulls, and the n + 1 offsets into them."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at is not None and len(column) else np.zeros(1, np.int64)
    return (memoryview(data) if data is not None else memoryview(b"")), offsets


def eq_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys where null equals null; the left side's keys stay."""
    other = right.select([F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = c if on is None else on & c
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def free_name(taken: list[str], wanted: str) -> str:
    """wanted, or the first of _wanted, __wanted, ... that no column has (Spark's names ignore case)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted


def global_rank(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """Add each row's position, from 0, in the order of the given columns (nulls last).

    Range partitions are written once (their bounds come from samples); the only single-task step has one row per partition.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return parts.withColumn(into, within.cast("long") - 1).join(offsets, "_part").withColumn(into, F.col(into) + F.col("_before")).drop("_part", "_before")
