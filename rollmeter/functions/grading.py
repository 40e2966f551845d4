"""Answers: equality, budgets, and the five rules of rescued correctness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_answer(answer: Column) -> Column:
    """An answer without layout: $, blanks, \\left, \\right, thousands commas, text and display variants of \\frac."""
    x = F.lower(F.regexp_replace(answer, r"[$\s]", ""))
    x = F.regexp_replace(x, r"\\(?:left|right|,|;|!|displaystyle)", "")
    x = F.regexp_replace(x, r"\\[dt]frac", r"\\frac")
    x = F.regexp_replace(x, r"\\text\{([^{}]*)\}", "$1")
    x = F.regexp_replace(x, r"\\frac\{([+-]?\d+)\}\{([+-]?\d+)\}", "$1/$2")
    x = F.regexp_replace(x, r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    return F.regexp_replace(x, r"\.$", "")


def _ratio(x: Column) -> tuple[Column, Column]:
    """Numerator and denominator of a number, a fraction or a percentage; null for anything else."""
    one = F.lit(1).cast("decimal(18,0)")
    number = r"^([+-]?\d{1,12}(?:\.\d{1,6})?)"
    top = F.try_to_number(F.nullif(F.regexp_extract(x, number + r"(?:/\d{1,9}|\\?%)?$", 1), F.lit("")), F.lit("S999999999999D999999"))
    below = F.try_to_number(F.nullif(F.regexp_extract(x, number + r"/(\d{1,9})$", 2), F.lit("")), F.lit("999999999")).cast("decimal(18,0)")
    below = F.when(x.endswith("%"), F.lit(100).cast("decimal(18,0)")).otherwise(F.coalesce(below, one))
    return top, below


def same_answer(predicted: Column, gold: Column) -> Column:
    """Equal as text without layout, or equal as rational numbers; a null prediction is wrong."""
    a, b = canonical_answer(predicted), canonical_answer(gold)
    (ta, ba), (tb, bb) = _ratio(a), _ratio(b)
    return F.coalesce((a == b) | F.coalesce(ta * bb == tb * ba, F.lit(False)), F.lit(False))


def rescue_estimator(r: dict[str, Column]) -> Column:
    """Rescued and a rescued output is present: the rescued grade, or else the main one; null stays null."""
    used = F.coalesce(r["rescued"], F.lit(False)) & r["has_rescued_output"]
    return F.when(used, F.coalesce(r["rescued_correct"], r["correct"])).otherwise(r["correct"])


def rescue_split(r: dict[str, Column]) -> Column:
    return F.coalesce(F.when(F.coalesce(r["rescued"], F.lit(False)), r["rescued_correct"]).otherwise(r["correct"]), F.lit(False))


def rescue_value(r: dict[str, Column]) -> Column:
    """The rescued grade where there is one, whatever `rescued` says."""
    return F.coalesce(r["rescued_correct"], r["correct"])


def rescue_profile(r: dict[str, Column]) -> Column:
    return F.when(F.coalesce(r["rescued"], F.lit(False)), F.coalesce(r["rescued_correct"], F.lit(False))).otherwise(F.coalesce(r["correct"], F.lit(False)))


def final_finish(r: dict[str, Column]) -> Column:
    return F.when(F.coalesce(r["rescued"], F.lit(False)), r["rescued_finish_reason"]).otherwise(r["finish_reason"])


def truthy_first(*arrays: Column) -> Column:
    """The first array that has an element; an empty one falls through."""
    return F.coalesce(*(F.when(F.size(a) > 0, a) for a in arrays))
