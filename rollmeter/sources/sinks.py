"""Writers: tables, documents and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def parquet(df: DataFrame, path: str, *by: str, rows_per_file: int | None = None) -> None:
    """Executors stream rows out; `by` gives a folder for each value."""
    w = df.write.mode("overwrite")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*by) if by else w).parquet(path)


def per_cell(df: DataFrame, path: str) -> None:
    """A folder for each (run, step, split)."""
    df.write.mode("overwrite").partitionBy("run", "step", "split").json(path)


def csv(df: DataFrame, path: str) -> None:
    """A table of results as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markers(profile: DataFrame, path: str) -> None:
    """Marker tokens with the source's schema, also if there are none."""
    profile.where("is_correction_marker").write.mode("overwrite").parquet(path)


def document(spark: SparkSession, value: dict | list, path: str) -> None:
    """A small JSON document, put in place in one step."""
    write_text(spark, json.dumps(value, ensure_ascii=False, indent=2, default=str), path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = to.getFileSystem(conf)
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(to, False)
    fs.rename(tmp, to)


def manifest(df: DataFrame, checks: dict[str, DataFrame] | None = None) -> dict:
    """Row count, columns, and the violations of each check."""
    return {"n_rows": df.count(), "columns": df.columns, "violations": {k: v.count() for k, v in (checks or {}).items()}}


def prompts(df: DataFrame, path: str, column: str = "prompt", n: int = 3) -> None:
    """The first prompts as text, by item_index."""
    df.orderBy("item_index").limit(n).select(F.col(column)).coalesce(1).write.mode("overwrite").text(path, lineSep="\n\n---\n\n")


def to_write(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """What an idempotent rerun still has to write."""
    return wanted.join(there, key, "left_anti")


def markdown(df: DataFrame, title: str = "") -> str:
    """A table of results as Markdown."""
    rows = df.collect()
    head = f"## {title}\n\n" if title else ""
    show = lambda x: "—" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    return head + "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"
