"""Supervision rows: layouts, problems, difficulty octiles and the calibration sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.draws import order_key
from ..functions.text import reference_text
from .common import first_by

LONG = ("problem_id", "condition", "prompt", "question", "answer", "output", "target", "difficulty")


def from_wide(rows: DataFrame, conditions=K.ALL_CONDITIONS) -> DataFrame:
    """A row for each view that is not null (an empty view stays), with the teacher's text."""
    keep = [c for c in ("problem_id", "question", "answer", "difficulty") if c in rows.columns]
    long = rows.unpivot(keep, [F.col(f"supervision_{c}").alias(c) for c in conditions], "condition", "output").where(F.col("output").isNotNull())
    return long.withColumn("prompt", F.col("question")).withColumn("target", reference_text(F.col("condition"), F.col("output"), F.col("answer")))


def from_long(rows: DataFrame) -> DataFrame:
    """Fills the prompt from the question, and the target where it is missing, null or empty."""
    for name in LONG:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    target = F.when(F.coalesce("target", F.lit("")) == "", reference_text(F.col("condition"), F.col("output"), F.col("answer"))).otherwise(F.col("target"))
    return rows.withColumn("prompt", F.coalesce("prompt", "question")).withColumn("target", target)


def rows(raw: DataFrame) -> DataFrame:
    """Either layout as the long one; the layout is seen by the column `condition`."""
    return from_long(raw) if "condition" in raw.columns else from_wide(raw)


def first_wins(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    return first_by(df, keys, F.col(line))


def last_wins(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    return first_by(df, keys, F.desc(line))


def problems(long: DataFrame, line: str, override: DataFrame | None = None) -> DataFrame:
    """Problems with all base views and a difficulty: question and answer of the answer_only row, views as a map.

    Of repeated (problem, condition) rows the last counts; the difficulty is
    the override's or else the first that is not null.
    """
    views = last_wins(long, ["problem_id", "condition"], line)
    base = F.col("condition") == "answer_only"
    grouped = views.groupBy("problem_id").agg(
        F.max(F.when(base, F.coalesce("prompt", "question"))).alias("question"),
        F.max(F.when(base, F.col("answer"))).alias("verified_answer"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("condition", "target")))).alias("pi"),
    )
    first = long.where("difficulty is not null").groupBy("problem_id").agg(F.min_by("difficulty", line).alias("difficulty"))
    out = grouped.join(first, "problem_id", "left")
    if override is not None:
        out = out.join(override.select("problem_id", F.col("difficulty").alias("_own")), "problem_id", "left").withColumn("difficulty", F.coalesce("_own", "difficulty")).drop("_own")
    for c in K.CONDITIONS:
        out = out.where(F.map_contains_key("pi", F.lit(c)))
    return out.where("difficulty is not null")


def view_texts(wanted: DataFrame, problems: DataFrame, extra: DataFrame, base=("answer_only", "key_points", "full_trace")) -> DataFrame:
    """wanted (problem_id, condition) with `target`: of a base view from the problem's map `texts`, of another from extra rows (problem_id, condition, target)."""
    mapped = wanted.where(F.col("condition").isin(*base)).join(problems.select("problem_id", "texts"), "problem_id", "left").select("problem_id", "condition", F.try_element_at("texts", F.col("condition")).alias("target"))
    rest = wanted.where(~F.col("condition").isin(*base)).join(extra.select("problem_id", "condition", "target"), ["problem_id", "condition"], "left")
    return mapped.unionByName(rest)


def incomplete_views(long: DataFrame, ids: DataFrame, conditions=K.EXTRA_CONDITIONS) -> DataFrame:
    """(problem_id, condition) that a requested problem lacks."""
    wanted = ids.select("problem_id", F.explode(F.array(*map(F.lit, conditions))).alias("condition"))
    return wanted.join(long.select("problem_id", "condition"), ["problem_id", "condition"], "left_anti")


def octiles(items: DataFrame, key: str, by: str, k: int = 8) -> DataFrame:
    """items with `octile`: floor(rank * k / n) in the order (by, key), the rank counted from 0.

    The rank is counted without a one-task sort.
    """
    from .common import ranked

    n = items.count()
    return ranked(items, F.col(by), F.col(key), name="_rank").withColumn("octile", F.floor(F.col("_rank") * k / max(1, n)).cast("int")).drop("_rank")


def calibration(items: DataFrame, key: str, per_octile: int = 64, seed: int = 42) -> DataFrame:
    """A seeded sample of each octile without replacement."""
    w = Window.partitionBy("octile").orderBy(order_key(seed, F.col(key)), F.col(key))
    return items.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= per_octile)


def within_context(items: DataFrame, lengths: list[str], new_tokens: Column | int) -> DataFrame:
    """Items whose longest view leaves room for the new tokens and the margin."""
    longest = F.greatest(*lengths) if len(lengths) > 1 else F.col(lengths[0])
    return items.where(longest <= K.MAX_LENGTH - new_tokens - K.MARGIN)


def common_length(completion: Column, prompts: list[Column], horizon: Column | None = None) -> Column:
    """Tokens of a completion that fit behind every prompt (and the horizon); null below the least."""
    parts = [completion, K.MAX_LENGTH - F.greatest(*prompts) - K.MARGIN, *([horizon] if horizon is not None else [])]
    n = F.least(*parts)
    return F.when(n >= K.LEAST_COMMON, n)


def request_budget(prompt: Column, new_tokens: Column | int) -> Column:
    new = new_tokens if isinstance(new_tokens, Column) else F.lit(new_tokens)
    return F.least(new, K.MAX_LENGTH - prompt - K.MARGIN)


def needs_rescue(r: DataFrame) -> Column:
    """Cut by length, and more room is left than it had."""
    return F.col("hit_length_cap") & (F.least(K.MAX_LENGTH - F.col("input_tokens") - K.MARGIN, F.lit(K.RESCUE_CAP)) > F.col("max_new_tokens"))
