"""Bands of solved share, buckets, quotas and the accounting of splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.draws import order_key
from .common import ranked_by_digest


def average(cells: DataFrame, key: str, correct: Column, expected: int | None = None) -> DataFrame:
    """(key, n, avg, complete): the share of samples solved."""
    return cells.groupBy(key).agg(F.count("*").alias("n"), F.avg(correct.cast("int")).alias("avg")).withColumn("complete", F.col("n") == (expected if expected is not None else F.col("n")))


def band(avg: Column, hard: str = "hard_pool") -> Column:
    return F.when(avg >= 0.75, "easy").when(avg > 0, "frontier").when(avg == 0, hard)


def recoverable(hard: DataFrame, attempts: DataFrame, key: str, correct: Column) -> DataFrame:
    """hard ids with the number of attempts, the conditions tried, and whether any attempt succeeded; none tried counts as not."""
    tried = attempts.groupBy(key).agg(F.count("*").alias("n_attempts"), F.array_sort(F.collect_set("condition")).alias("conditions"), F.bool_or(correct).alias("any"))
    out = hard.join(tried, key, "left")
    return out.select(key, F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"), F.coalesce(F.size("conditions"), F.lit(0)).alias("n_conditions"), F.coalesce("any", F.lit(False)).alias("recoverable"))


def quota_split(items: DataFrame, key: str, group: str, quotas: dict[str, int] = K.QUOTAS, seed: int = 42, strict: bool = False) -> DataFrame:
    """items with `split`, by a seeded order in each group and cumulative quotas.

    A group that is short is cut in proportion: train and dev take
    int(n * quota / all quotas), test takes the rest; with `strict` it has no
    rows at all.
    """
    wanted = sum(quotas.values())
    train, dev, _ = quotas.values()
    order = order_key(seed, F.col(group), F.col(key))
    df = ranked_by_digest(items, order, F.col(key), name="_i", within=(group,), total="_n").withColumn("_i", F.col("_i") + 1)
    short = F.col("_n") < wanted
    n_train = F.when(short, F.floor(F.col("_n") * (train / wanted))).otherwise(train)
    n_dev = F.when(short, F.floor(F.col("_n") * (dev / wanted))).otherwise(dev)
    n_all = F.when(short, F.lit(0) if strict else F.col("_n")).otherwise(wanted)
    split = F.when(F.col("_i") <= n_train, "train").when(F.col("_i") <= n_train + n_dev, "dev").otherwise("test")
    return df.where(F.col("_i") <= n_all).withColumn("split", split).drop("_n", "_i")


def without(items: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """items whose key is in none of the others."""
    gone = reduce(lambda a, b: a.union(b), (o.select(key) for o in others)).distinct()
    return items.join(gone, key, "left_anti")


def accounting(before: DataFrame, after: DataFrame, prior: DataFrame, key: str, group: str) -> DataFrame:
    """Rows of each group before, after and removed, and how many were in the prior training set."""
    flags = before.select(key, group).join(after.select(key, F.lit(1).alias("_a")), key, "left").join(prior.select(key, F.lit(1).alias("_p")), key, "left")
    return flags.groupBy(group).agg(F.count("*").alias("before"), F.count("_a").alias("after"), (F.count("*") - F.count("_a")).alias("removed"), F.count_if(F.col("_a").isNotNull() & F.col("_p").isNotNull()).alias("in_prior"))


def set_checks(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of a, b, their union, intersection and differences, and the subset, equal and disjoint tests."""
    both = a.select(key, F.lit(1).alias("a")).distinct().join(b.select(key, F.lit(1).alias("b")).distinct(), key, "full")
    n = both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count("*").alias("n_union"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))
    return n.withColumn("only_a", F.col("n_a") - F.col("n_both")).withColumn("only_b", F.col("n_b") - F.col("n_both")).withColumn("a_in_b", F.col("n_a") == F.col("n_both")).withColumn("equal", (F.col("n_a") == F.col("n_both")) & (F.col("n_b") == F.col("n_both"))).withColumn("disjoint", F.col("n_both") == 0)
