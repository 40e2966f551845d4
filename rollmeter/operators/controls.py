"""Matched controls: another problem's reference of like length, a wrong answer's reference, a truncated trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grading import canonical_answer
from ..functions.text import prefix_text
from .common import ranked


def nearest_length(items: DataFrame, key: str, length: str) -> DataFrame:
    """Each item's partner: of the two neighbours in the order (length, key) the one closer in length, the earlier on a tie.

    Ranks come from a range partitioning; a neighbour is found by an equi-join
    on the rank, so no task sorts the whole table.
    """
    own = ranked(items.select(key, length), F.col(length), F.col(key))
    before = own.select((F.col("rank") + 1).alias("rank"), F.col(key).alias("p_key"), F.col(length).alias("p_len"))
    after = own.select((F.col("rank") - 1).alias("rank"), F.col(key).alias("n_key"), F.col(length).alias("n_len"))
    df = own.join(before, "rank", "left").join(after, "rank", "left")
    prev = F.col("p_key").isNotNull() & (F.col("n_key").isNull() | (F.abs(F.col(length) - F.col("p_len")) <= F.abs(F.col("n_len") - F.col(length))))
    partner, plen = F.when(prev, F.col("p_key")).otherwise(F.col("n_key")), F.when(prev, F.col("p_len")).otherwise(F.col("n_len"))
    return df.select(key, partner.alias("paired_from"), F.col(length).alias("own_len"), plen.alias("paired_len"), F.abs(F.col(length) - plen).alias("abs_len_diff"))


def wrong_answer(items: DataFrame, key: str, length: str, answer: str) -> DataFrame:
    """Each item's partner with another answer: the item of the least rank distance, the earlier side on a tie.

    Walking outwards until the answer differs ends at the last row of the run
    of equal answers to either side, so the partner is one beyond that run:
    runs are numbered, and an equi-join on the run number finds it.
    """
    rows = items.select(key, length, answer, canonical_answer(F.col(answer)).alias("_class"))
    own = ranked(rows, F.col(length), F.col(key))
    last = own.select((F.col("rank") + 1).alias("rank"), F.col("_class").alias("_before"))
    edges = own.join(last, "rank", "left").where(F.col("_before").isNull() | (F.col("_class") != F.col("_before"))).select("rank")
    runs = ranked(edges, F.col("rank"), name="run").withColumnRenamed("rank", "first")
    after = runs.select((F.col("run") - 1).alias("run"), F.col("first").alias("next_first"))
    spans = runs.join(after, "run", "left")
    at = _in_run(own, spans)
    up, down = at["rank"] - at["first"] + 1, at["next_first"] - at["rank"]
    side = F.when(at["first"] == 0, at["next_first"]).when(at["next_first"].isNull() | (up <= down), at["first"] - 1).otherwise(at["next_first"])
    at = at.withColumn("_to", side)
    other = own.select(F.col("rank").alias("_to"), F.col(key).alias("paired_from"), F.col(answer).alias("paired_answer"))
    return at.join(other, "_to", "left").select(key, F.col(answer).alias("own_answer"), "paired_from", "paired_answer", F.abs(F.col("_to") - F.col("rank")).alias("walk_steps"))


def _in_run(own: DataFrame, spans: DataFrame) -> DataFrame:
    """own with first and next_first of its run: an as-of join on the rank, in ranges of ranks."""
    width = 4096
    last = own.agg(F.max("rank").alias("m"))
    spans = spans.crossJoin(F.broadcast(last)).withColumn("next_or_end", F.coalesce("next_first", F.col("m") + 1))
    cells = F.sequence(F.floor(F.col("first") / width), F.floor((F.col("next_or_end") - 1) / width))
    dealt = spans.select("first", "next_first", "next_or_end", F.explode(cells).alias("_cell"))
    return own.withColumn("_cell", F.floor(F.col("rank") / width)).join(dealt, "_cell").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("next_or_end")))


def truncated(items: DataFrame, key: str, text: str, target: Column) -> DataFrame:
    """A trace cut to the target's number of tokens; excluded unless it is strictly longer."""
    from ..functions.text import word_count

    full = word_count(F.col(text))
    df = items.select(key, F.col(text).alias("_text"), full.alias("full_len"), target.cast("int").alias("target_len"))
    cut = F.col("full_len") > F.col("target_len")
    return df.select(key, "full_len", "target_len", F.when(cut, F.col("target_len")).alias("truncated_to"), (~cut).alias("excluded"), F.when(cut, prefix_text(F.col("_text"), F.col("target_len"))).alias("text"))


def violations(pairs: DataFrame, key: str) -> DataFrame:
    """Pairs of an item with itself, without a partner, or with the same answer."""
    bad = F.col("paired_from").isNull() | (F.col("paired_from") == F.col(key))
    if "own_answer" in pairs.columns:
        bad = bad | (canonical_answer(F.col("own_answer")) == canonical_answer(F.col("paired_answer")))
    return pairs.where(bad)
