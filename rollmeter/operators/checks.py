"""Invariants as tables of violations; a check that holds is an empty table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_nulls(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns)))


def unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def holds(df: DataFrame, rule: Column) -> DataFrame:
    return df.where(~F.coalesce(rule, F.lit(False)))


def row_count(df: DataFrame, expected: int) -> DataFrame:
    return df.agg(F.count("*").alias("n")).where(F.col("n") != expected)


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("a")).union(b.exceptAll(a).withColumn("side", F.lit("b")))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def close(a: DataFrame, b: DataFrame, keys: list[str], column: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows of an inner join whose values differ by more than the tolerance."""
    return a.select(*keys, F.col(column).alias("_a")).join(b.select(*keys, F.col(column).alias("_b")), keys).where(F.abs(F.col("_a") - F.col("_b")) > tolerance)


def baseline_rows(profile: DataFrame) -> DataFrame:
    """Baseline rows with a divergence, a log ratio or a disagreement that is not 0."""
    return profile.where("condition = 'none'").where("log_ratio <> 0 or full_kl <> 0 or not top1_agree_with_student or entropy <> entropy_student")


def demand(*violations: DataFrame) -> None:
    """Raises with a few rows of the first check that does not hold."""
    for v in violations:
        rows = v.limit(3).collect()
        if rows:
            raise ValueError(f"check failed: {rows}")
