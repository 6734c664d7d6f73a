"""Session-level helpers: durable intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many bytes (rough row width times row count).
BROADCAST_BYTES = 8 << 20
#: Bytes of rows that go to a Python worker at once: a batch is held by the worker and, up to twice, by the JVM.
BATCH_BYTES = 8 << 20


@functools.lru_cache(maxsize=1)
def _fallback_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sightline-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or else what setCheckpointDir() was given.

    Where neither is set, a temporary folder serves a local master (tests); any other master is an error, as executors
    don't see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (found or _fallback_dir()).rstrip("/")


def delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Have the driver delete a folder of intermediate files when it ends, if nothing did before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and survives lost executors.

    The table lasts until discard(), or else until the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind tables made by materialize() that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark._jvm
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Have Python tasks get batches of at most BATCH_BYTES, unless the session says otherwise than Spark's default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def unused(columns: Iterable[str], stem: str) -> str:
    """A column name that begins with stem and is none of columns, whatever their case."""
    taken, name = {c.lower() for c in columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the counted rows fit the limit; otherwise leave the join to shuffle.

    Counting stops one row past the limit, so the check itself stays cheap on any size.
    """
    most = max(1, limit // max(1, row_bytes))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
