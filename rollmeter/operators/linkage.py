"""Record linkage of two lists of problems: exact on texts without white space, then closest text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import normalize_answer, strip_space

LEFTOVER = 200  # of a side, compared each with each; more means that the lists do not belong together


def ratio():
    """Similarity of two texts by matching blocks; row by row, as the standard library computes it, in Arrow batches."""
    @F.pandas_udf("double")
    def matching(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    return matching


def link(problems: DataFrame, anchors: DataFrame) -> DataFrame:
    """(problem_id, anchor_id, how, ratio, margin, answers_agree) for (problem_id, question, answer) and (anchor_id, problem, ground_truth).

    A unique equal text is a pair.  The others take the closest free anchor if
    it is close (LEAST_RATIO) and clear (LEAST_MARGIN); else how is `unclear`.
    """
    p = problems.select("problem_id", strip_space(F.col("question")).alias("_q"), normalize_answer(F.col("answer")).alias("_pa"))
    a = anchors.select("anchor_id", strip_space(F.col("problem")).alias("_t"), normalize_answer(F.col("ground_truth")).alias("_aa"))
    same = p.join(a, p["_q"] == a["_t"]).withColumn("_n", F.count("*").over(Window.partitionBy("problem_id"))).where("_n = 1")
    same = same.select("problem_id", "anchor_id", F.lit("exact").alias("how"), F.lit(1.0).alias("ratio"), F.lit(None).cast("double").alias("margin"), (F.col("_pa") == F.col("_aa")).alias("answers_agree"))
    left = p.join(same, "problem_id", "left_anti")
    free = a.join(same, "anchor_id", "left_anti")
    if max(left.limit(LEFTOVER + 1).count(), free.limit(LEFTOVER + 1).count()) > LEFTOVER:
        raise ValueError(f"over {LEFTOVER} problems or anchors have no equal text")
    w = Window.partitionBy("problem_id").orderBy(F.desc("ratio"), F.desc("anchor_id"))
    scored = left.join(F.broadcast(free)).withColumn("ratio", ratio()(F.col("_q"), F.col("_t"))).withColumn("_i", F.row_number().over(w)).withColumn("margin", F.col("ratio") - F.coalesce(F.lead("ratio").over(w), F.lit(0.0))).where("_i = 1")
    clear = (F.col("ratio") >= K.LEAST_RATIO) & (F.col("margin") >= K.LEAST_MARGIN)
    near = scored.select("problem_id", "anchor_id", F.when(clear, "closest").otherwise("unclear").alias("how"), "ratio", "margin", (F.col("_pa") == F.col("_aa")).alias("answers_agree"))
    return same.union(near)


def failures(links: DataFrame, problems: DataFrame) -> DataFrame:
    """Why the links are no one-to-one map with equal answers: one row for each reason, with a count."""
    twice = links.groupBy("anchor_id").count().where("count > 1").agg(F.lit("anchor used twice").alias("reason"), F.count("*").alias("n"))
    bad = links.agg(F.lit("answers differ").alias("reason"), F.count_if(~F.coalesce("answers_agree", F.lit(False))).alias("n"))
    unclear = links.agg(F.lit("unclear").alias("reason"), F.count_if(F.col("how") == "unclear").alias("n"))
    lost = problems.join(links, "problem_id", "left_anti").agg(F.lit("unpaired").alias("reason"), F.count("*").alias("n"))
    return twice.union(bad).union(unclear).union(lost).where("n > 0")
