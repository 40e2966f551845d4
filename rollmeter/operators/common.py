"""Helpers of the operators."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if a counted prefix shows the side to be small; a larger side is left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def no_nan(x: Column) -> Column:
    """NaN as null, at the border of the engine."""
    return F.nanvl(x, F.lit(None).cast("double"))


RANGES = 4  # of values for each shuffle partition


HASH_BITS = 48  # of a digest, that a double holds exactly
NUMBERS = ("short", "integer", "long", "float", "double")


def below(cuts: list[float], x: Column) -> Column:
    """How many of the sorted cuts are less than x, by binary steps."""
    bounds = F.array(*map(F.lit, cuts)).cast("array<double>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length())))).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < x, at + step).otherwise(at))


def ranked(df: DataFrame, *order: Column, name: str = "rank", within: tuple[str, ...] = (), total: str | None = None, cuts: list[float] | None = None, measured: DataFrame | None = None) -> DataFrame:
    """A rank from 0 in a total order whose first column is a number, over all rows or within facets, without a task that sorts them all.

    Rows fall into ranges of the first column, cut at approximate quantiles
    (or at the given cuts); a row's rank is its number in its range plus the
    sizes of the ranges below, which are a row for each range (and facet).  A
    value that fills whole ranges is cut once more by the second column, if
    that is a number.  The ranges are a function of the values, so a task that
    is run again gives the same ranks.  Nulls come first.  `total` names a
    column for the size of the facet; `measured` has the rows of df from a
    shorter plan, for the quantiles.
    """
    n = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, by, own = order[0].cast("double"), ["_range"], []
    if cuts is None:
        more = len(order) > 1 and df.select(order[1]).schema[0].dataType.typeName() in NUMBERS
        columns = [first, order[1].cast("double")] if more else [first]
        found = (df if measured is None else measured).agg(*(F.percentile_approx(c, [i / n for i in range(1, n)], 10_000) for c in columns)).first()
        cuts, own = found[0] or [], (found[1] if more else None) or []
    heavy = sorted(x for x, times in Counter(cuts).items() if times > 1)
    placed = df.withColumn("_range", below(sorted(set(cuts)), first))
    if heavy and own:
        part = F.when(first.isin(heavy), below(sorted(set(own)), order[1].cast("double")) + 1).otherwise(0)
        placed, by = placed.withColumn("_part", part), ["_range", "_part"]
    sizes, facet = placed.groupBy(*within, *by).agg(F.count("*").alias("_size")), Window.partitionBy(*within)
    before = sizes.select(*(F.col(c).alias(f"_of_{c}") for c in (*within, *by)), (F.sum("_size").over(facet.orderBy(*by)) - F.col("_size")).alias("_before"), *([F.sum("_size").over(facet).alias(total)] if total else []))
    numbered = placed.withColumn("_at", F.row_number().over(Window.partitionBy(*within, *by).orderBy(*order)) - 1)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*within, *by)))
    out = numbered.join(before if within else F.broadcast(before), same)
    return out.withColumn(name, F.col("_before") + F.col("_at")).drop("_at", "_before", *by, *(f"_of_{c}" for c in (*within, *by)))


def ranked_by_digest(df: DataFrame, digest: Column, *ties: Column, **named) -> DataFrame:
    """`ranked` in the order of a hexadecimal digest, whose ranges are even and need no quantiles."""
    n = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("double")
    return ranked(df, number, digest, *ties, cuts=[float((1 << HASH_BITS) * i // n) for i in range(1, n)], **named)


def numbered_values(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with a number for each value that has the values' order; a numeric column is its own number."""
    if df.schema[value].dataType.typeName() in NUMBERS:
        return df.withColumn(name, F.col(value))
    values = df.select(F.col(value).alias("_value")).distinct()
    few = values.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:  # a bounded list of values: one task numbers it
        values = F.broadcast(values.withColumn(name, F.row_number().over(Window.orderBy("_value"))))
    else:
        head = F.substring(F.encode(F.col("_value").cast("string"), "utf-8"), 1, 6)  # six bytes keep the order of texts
        values = ranked(values, F.conv(F.hex(F.rpad(head, 6, F.lit(b"\0"))), 16, 10).cast("double"), F.col("_value"), name=name)
    return df.join(values, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
