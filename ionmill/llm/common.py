"""Shared pieces: shared scratch folders, file access from executors, column hygiene."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session without that setting (tests) gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(spark, "_ionmill_scratch", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="ionmill-")
            spark._ionmill_scratch = root
    return root.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder name under the shared root."""
    return f"{shared_root(spark)}/ionmill-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or scratch(spark, what)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    there = {c.lower() for c in df.columns}
    name = "_" + name
    while name.lower() in there:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that nothing refers to any more; it acts on garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Delete the folders that hold a materialised DataFrame which nothing needs any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_folder(df.sparkSession, path)


#: Arrow batches that go to Python workers, unless the session says otherwise.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def tidy() -> None:
    """Give memory that this Python worker has freed back to the system; workers outlive the operator and share the executor with others."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow in small batches, so that long texts do not add up; the worker's memory is given back at the end of each task."""
    conf = df.sparkSession.conf
    for key, value in BATCH.items():
        if conf.get(key, None) is None:
            conf.set(key, value)

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(whole, schema)


def slim(spark: SparkSession) -> None:
    """Let the executors collect garbage, too: their heaps shrink and leave memory to the Python workers of what comes next."""
    release(spark)
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def file_system(uri: str):
    """(pyarrow file system, path) of a URI, for use on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, name: str, data: bytes) -> None:
    """Write a file under a private name, then rename it: a retried or doubled task leaves a whole file."""
    fsys, base = file_system(uri)
    fsys.create_dir(base, recursive=True)
    tmp = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fsys.open_output_stream(tmp) as out:
        out.write(data)
    fsys.move(tmp, f"{base}/{name}")


def ascii_lower(col: Column | str) -> Column:
    """A-Z to a-z only; other letters stay."""
    return F.translate(F.col(col) if isinstance(col, str) else col, UPPER, LOWER)


