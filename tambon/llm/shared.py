"""Helpers shared by the operators: scratch tables, table readers, the held-out rule."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_made: dict[str, SparkSession] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: T.DataType | str) -> DataFrame:
    """The named columns with these types and no others; a missing column is null.

    Names are matched exactly first and then without case, so that extra columns whose
    names clash with ours (in another case, or twice) are left out instead of making a
    reference ambiguous. Of several equal names the first counts.
    """
    positions = {}
    for i, name in enumerate(df.columns):
        positions.setdefault(name, i)
    lowered = {}
    for name, i in positions.items():
        lowered.setdefault(name.lower(), i)
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    out = []
    for name, kind in columns.items():
        at = positions.get(name, lowered.get(name.lower()))
        value = F.lit(None) if at is None else F.col(f"_{at}")
        out.append(value.cast(kind).alias(name))
    return plain.select(*out)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names, which all executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tambon-")
        _made[base] = spark
        return f"{base}/{name}"
    path = f"{base}/tambon/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends here, and a lost executor costs nothing.

    What was shuffled for it is of no more use. Spark deletes shuffle files once the driver's JVM has collected the plan, which
    a driver with little to do puts off for long, so it is told to.
    """
    spark = df.sparkSession
    path, release = scratch_path(spark, name), spark.sparkContext._jvm.System.gc
    release()  # listeners may have held the plan before this one until now
    df.write.parquet(path)
    release()
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    for path, spark in list(_made.items()):
        if any(path.split(":", 1)[-1].lstrip("/") in file for file in df.inputFiles()[:1]):
            _delete(path, spark)
            del _made[path]


def _delete(path: str, spark: SparkSession) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        try:
            _delete(path, spark)
        except Exception:  # noqa: BLE001  the session has ended: the shared folder's owner clears it
            return


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n: the rule that holds rows out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


_worker: dict[str, object] = {}


def worker_cache(key: str, make):
    """An object that a Python worker keeps between tasks. One at a time: another key's object goes, so that stages don't add up their caches."""
    if key not in _worker:
        if _worker:
            _worker.clear()
            give_back()
        _worker[key] = make()
    return _worker[key]


def give_back() -> None:
    """Memory that a worker no longer uses goes back to the system: workers outlive stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 2 << 20) -> None:
    """Python workers get at most so many rows and bytes at a time: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 256)  # as the reader holds a batch of whole texts at once


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
