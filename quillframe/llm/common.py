"""What several operators share: tables, scratch tables in the shared folder, gapless ranks."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where a local session names no shared folder, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints/quillframe"
#: Bytes of an Arrow batch of texts, unless one row has more.
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or LOCAL_SCRATCH


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/quillframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of a few megabytes, so that long ones don't meet in memory.

    Plans read this session setting when they run, so it can't be put back; a value that the session has already stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def release_memory() -> None:
    """Give what a worker has freed back to the system: workers live on from task to task, and large arrays leave holes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def drop_scratch(df: DataFrame) -> None:
    """Delete the table that ``materialize`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quillframe-" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def private(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def boxed(df: DataFrame, *columns: Column) -> DataFrame:
    """The given columns beside one struct, ``row``, of all of the table's: whatever these are named, nothing clashes."""
    return df.select(*columns, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unboxed(df: DataFrame, names: Sequence[str], *columns: Column) -> DataFrame:
    """The struct's fields of these names as columns again, then the given columns."""
    return df.select(*[F.col("row")[c].alias(c) for c in names], *columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless_rank(df: DataFrame, counted: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], buckets: int, out: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, without gathering a key in one task.

    Every key is dealt into ``buckets`` by ``bucket``; the counts of (key, bucket) give each bucket its
    first number, and rows are numbered inside their bucket only. ``counted`` is the same rows, with as few columns
    as ``keys`` and ``bucket`` need. The table of first numbers has at most keys x ``buckets`` rows, which the
    caller must keep small enough to broadcast.
    """
    part, n, least = (private(df, x) for x in ("_bucket", "_n", "_first"))
    tally = counted.select(*keys, bucket.alias(part)).groupBy(*keys, part).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    first = tally.select(*keys, part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(least))
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    return (
        df.withColumn(part, bucket)
        .join(F.broadcast(first), [*keys, part])
        .withColumn(out, (F.col(least) + F.row_number().over(inside) - 1).cast("long"))
        .drop(part, least)
    )


def draw_rows(rows: DataFrame, group: str, sizes: Mapping, each: int) -> DataFrame:
    """Distinct (id, text, group) rows: of a group of ``sizes`` rows about ``each``, those with the smallest 64-bit hashes; all of a smaller group.

    The bound on the hash has 64 bits, too, so groups of any size give their share. Repeated rows count once, so they don't fill a sample.
    """
    bounds = [x for k, n in sizes.items() for x in (F.lit(k), F.lit((1 << 63) - 1 if n <= each else each * (1 << 64) // n - (1 << 63)).cast("long"))]
    drawn = rows.where(F.xxhash64("id", "text") <= F.create_map(*bounds)[F.col(group)])
    return drawn.select("id", "text", group).distinct()


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not all zeros. Never null itself."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of integers (the finalizer of SplitMix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
