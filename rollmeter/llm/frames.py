"""Plan helpers: reading, Arrow passes, shared folder, stable input columns."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 rows and 8 MB (a longer row is a batch), for this session's passes.

    Long texts and two Python workers then fit beside an executor's heap.  The
    settings are read when a plan runs, so they stay; lower ones are kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Returns a Python worker's freed memory to the system, where the C library can, as workers live on between tasks."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_pass(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """Each Arrow batch through the function that `make` builds once a task."""
    bounded_batches(df.sparkSession)

    def run(batches):
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)
        give_back()

    return df.mapInArrow(run, schema)


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below the folder that driver and executors share (spark.checkpoint.dir).

    Only on a local master, where driver and executors are one process, may
    the session name none; a temporary folder then takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "base" not in _OWN:
            import tempfile

            _OWN["base"] = "file://" + tempfile.mkdtemp(prefix="rollmeter-")
        base = _OWN["base"]
    return f"{base.rstrip('/')}/rollmeter-{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


SMALL_ROWS = 400_000  # of ids and numbers, so some ten MB


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """df, to be broadcast if it is counted to have few rows; else a join with it shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


HOT_KEYS = 10_000


def hot_join(left: DataFrame, right: DataFrame, on: str, weight: str) -> DataFrame:
    """left joined to right (a written table, a row a key), whose column `weight` is the number of a key's rows in left.

    Keys of more than 1 in HOT_KEYS of all rows, of which there can be no more
    than HOT_KEYS, are joined by broadcast, so that no task meets all rows of
    a hot key; the rest is shuffled.  `left` is read twice.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.where(F.col(weight) > total / HOT_KEYS)
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right.where(F.col(weight) <= total / HOT_KEYS), on)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    """The tables of this module are scratch: removed when the driver ends."""
    import atexit

    def remove():
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(remove)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
