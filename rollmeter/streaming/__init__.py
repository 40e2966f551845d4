"""A training log as a stream: means by step, resume by key, and states of jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.planning import step_means
from ..schemas import TRAJECTORY


def trajectory_log(spark: SparkSession, folder: str, schema: StructType | str = TRAJECTORY, files: int = 100) -> DataFrame:
    """An append-only folder of JSON lines; new files become micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def monitor(log: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Means by step in update mode; a batch gives the steps that it changed."""
    return step_means(log).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(records: DataFrame, *keys: str) -> DataFrame:
    """Each key's first record; later ones, as after a restart, are dropped."""
    return records.dropDuplicates(list(keys))
