"""Readers of the engine's inputs; all are lazy scans that prune columns and take several paths."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.common import first_by


def jsonl(spark: SparkSession, *paths: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped.  Columns missing in a file are null."""
    return spark.read.schema(schema).json(list(paths))


def numbered_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with `line`, which orders the rows of a file by their place in it (file name, then block and row)."""
    df = spark.read.schema(schema).json(path).withColumn("line", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))
    return df


def document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def listed(doc: DataFrame, *columns: str, key: str = "problem_id", name: str = "split") -> DataFrame:
    """Arrays of a document as rows (split, item_index, key), in their order."""
    return reduce(lambda a, b: a.union(b), (doc.select(F.lit(c).alias(name), F.posexplode(c).alias("item_index", key)) for c in columns))


def parquet(spark: SparkSession, *shards: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet shards as one table; columns that only newer shards have are null in the others."""
    df = spark.read.option("mergeSchema", True).parquet(*shards)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def dataset(spark: SparkSession, root: str, split: str) -> DataFrame:
    """A folder with a sub-folder for each split; without the wanted one, the first by name."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    there = sorted(s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at) if s.isDirectory())
    return spark.read.parquet(f"{root}/{split if split in there else there[0]}")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def if_there(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame | None, dict]:
    """(rows or None, provenance)."""
    found = exists(spark, path)
    return (jsonl(spark, path, schema=schema) if found else None), {"path": path, "complete": found}


CELL_FILE = r"^(.*?)b(\d+)_(.+)_step(\d+)_(\w+)\.jsonl$"


def cells(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """Result files by glob, with prefix, shard, run, step and split from the file name."""
    df = spark.read.schema(schema).json(pattern).withColumn("_file", F.col("_metadata.file_name"))
    for i, name in enumerate(("prefix", "shard", "run", "step", "split"), 1):
        df = df.withColumn(name, F.regexp_extract("_file", CELL_FILE, i))
    return df.withColumn("shard", F.col("shard").cast("int")).withColumn("step", F.col("step").cast("int")).drop("_file")


def first_unprivileged(records: DataFrame, line: str, base=("answer_only", "key_points", "full_trace")) -> DataFrame:
    """The first record of sample 0 without a reference of each problem; any condition outside the base views counts as without."""
    return first_by(records.where(~F.coalesce(F.col("condition").isin(*base), F.lit(False)) & (F.col("sample_index") == 0)), ["problem_id"], F.col(line))


def latest(records: DataFrame, keys: list[str], line: str) -> DataFrame:
    return first_by(records, keys, F.desc(line))


def benchmark(frames: dict[str, tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Benchmarks with their own column names as (problem_id, question, verified_answer); ids get the benchmark's name."""
    parts = []
    for name, (df, fields) in frames.items():
        parts.append(df.select(F.concat(F.lit(f"{name}-"), F.col(fields["id"]).cast("string")).alias("problem_id"), F.col(fields["question"]).alias("question"), F.col(fields["answer"]).cast("string").alias("verified_answer")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def supervision(spark: SparkSession, schema: StructType | str, local: str = "SUPERVISION_JSONL", root: str | None = None, split: str = "train") -> DataFrame:
    """The local file that the environment names, or else the data set folder."""
    path = os.environ.get(local)
    return jsonl(spark, path, schema=schema) if path else dataset(spark, root, split)
