"""Reduction of token-score profiles: derived columns, trajectories, position bins, regions, facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.tensor import floor_bin, logit

KEYS = ["problem_id", "sample_index", "condition"]
OPTIONAL = ("clipped_kl", "pi_length_tokens", "token_id")


def with_optional(df: DataFrame) -> DataFrame:
    """Columns of newer shards as nulls where a shard lacks them."""
    return reduce(lambda d, c: d if c in d.columns else d.withColumn(c, F.lit(None).cast("double")), OPTIONAL, df)


def derived(df: DataFrame) -> DataFrame:
    """Think and answer flags, quartile, position bin, disagreement, and the student differences of each signal."""
    out = df.withColumns({
        "is_think": F.col("token_category") == "think", "is_answer": F.col("token_category") == "answer",
        "quartile": floor_bin(F.col("normalized_position"), 4), "pos_bin": floor_bin(F.col("normalized_position"), K.POSITION_BINS),
        "disagree": (~F.col("top1_agree_with_student")).cast("int"), "entropy_delta": F.col("entropy") - F.col("entropy_student"),
    })
    for s in K.STOP_SIGNALS:
        out = out.withColumn(f"{s}_delta", F.col(s) - F.col(f"{s}_student")).withColumn(f"{s}_logit_diff", logit(F.col(s)) - logit(F.col(f"{s}_student")))
    return out


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def per_group(df: DataFrame) -> DataFrame:
    """One row for each trajectory and view, in one aggregation: masks are conditions inside the sums.

    A sum over no tokens is 0 and a mean over none is null.
    """
    has_clip = "clipped_kl" in df.columns
    d = derived(df)
    kls = ["full_kl", *(["clipped_kl"] if has_clip else [])]
    aggs: dict[str, Column] = {"correct": F.bool_or("correct"), "n_tokens": F.count("*"), "n_think_tokens": F.count_if("is_think"), "n_answer_tokens": F.count_if("is_answer")}
    if "pi_length_tokens" in df.columns:
        aggs["pi_length_tokens"] = F.max("pi_length_tokens")
    for kl in kls:
        aggs[f"{kl}_sum"] = _zero(F.sum(kl))
        for name, mask in (("think", F.col("is_think")), ("answer", F.col("is_answer")), *((f"q{q}", F.col("quartile") == q) for q in range(4))):
            aggs[f"{kl}_sum_{name}"] = _zero(F.sum(F.when(mask, F.col(kl))))
    for q in range(4):
        aggs[f"n_tokens_q{q}"] = F.count_if(F.col("quartile") == q)
    aggs |= {
        "log_ratio_sum": _zero(F.sum("log_ratio")), "log_ratio_mean": F.avg("log_ratio"), "entropy_mean": F.avg("entropy"), "entropy_student_mean": F.avg("entropy_student"),
        "top1_disagreement_rate": F.avg("disagree"), "marker_count": F.count_if("is_correction_marker"), "marker_log_ratio_sum": _zero(F.sum(F.when(F.col("is_correction_marker"), F.col("log_ratio")))),
    }
    for s in K.STOP_SIGNALS:
        for x in (s, f"{s}_student", f"{s}_delta"):
            aggs[f"{x}_mean"], aggs[f"{x}_max"] = F.avg(x), F.max(x)
    out = d.groupBy(*KEYS).agg(*(c.alias(n) for n, c in aggs.items()))
    for kl in kls:
        out = out.withColumn(f"{kl}_mean", F.col(f"{kl}_sum") / F.col("n_tokens"))
        for name in ("think", "answer", "q0", "q1", "q2", "q3"):
            n = f"n_tokens_{name}" if name[0] == "q" else f"n_{name}_tokens"
            out = out.withColumn(f"{kl}_mean_{name}", F.try_divide(F.col(f"{kl}_sum_{name}"), F.nullif(F.col(n), F.lit(0))))
    return out.withColumn("marker_log_ratio_mean", F.try_divide("marker_log_ratio_sum", F.nullif(F.col("marker_count"), F.lit(0))))


def position_profile(df: DataFrame) -> DataFrame:
    """Means by view, outcome and position bin."""
    aggs = [F.count("*").alias("n_tokens"), F.avg("full_kl").alias("mean_full_kl"), F.avg("entropy_delta").alias("mean_entropy_delta")]
    if "clipped_kl" in df.columns:
        aggs.append(F.avg("clipped_kl").alias("mean_clipped_kl"))
    for s in K.STOP_SIGNALS:
        aggs += [F.avg(x).alias(f"mean_{x}") for x in (s, f"{s}_student", f"{s}_delta", f"{s}_logit_diff")]
    return derived(df).groupBy("condition", "correct", "pos_bin").agg(*aggs).withColumn("bin_center", (F.col("pos_bin") + 0.5) / K.POSITION_BINS)


def normalized(position: Column, n: Column) -> Column:
    """0 for the first and 1 for the last of n positions; the only one is 0."""
    return position / F.greatest(n - 1, F.lit(1))


def region(position: Column, n: Column) -> Column:
    """By share of the whole length, the denominator being n."""
    return F.when(position < n * 0.25, "first25").when(position >= n * 0.75, "last25").otherwise("mid50")


def region_sums(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS, "region", "token_category").agg(F.bool_or("correct").alias("correct"), F.sum("log_ratio").alias("log_ratio_sum"), F.count("*").alias("n_tokens"))


def marker_tokens(df: DataFrame) -> DataFrame:
    return df.where("is_correction_marker")


def sanity(df: DataFrame) -> DataFrame:
    """Counts that a complete profile has, and the divergence of the baseline, which must be 0."""
    pairs = F.countDistinct(F.struct("problem_id", "sample_index"))
    return df.agg(
        F.count("*").alias("n_rows"), F.countDistinct("problem_id").alias("n_problems"), pairs.alias("n_trajectories"), F.countDistinct("condition").alias("n_conditions"),
        F.countDistinct(F.struct(*KEYS)).alias("n_groups"), F.coalesce(F.max(F.when(F.col("condition") == K.BASELINE_PROFILE, F.abs("full_kl"))), F.lit(0.0)).alias("max_baseline_kl"),
    )


def eligible(groups: DataFrame) -> DataFrame:
    """Problems with a solved and an unsolved sample, seen in one view."""
    one = groups.select("problem_id", "sample_index", "correct").groupBy("problem_id", "sample_index").agg(F.bool_or("correct").alias("correct"))
    solved = F.sum(F.col("correct").cast("int"))
    return one.groupBy("problem_id").agg(solved.alias("n_correct"), F.count("*").alias("n")).where((F.col("n_correct") >= 1) & (F.col("n_correct") < F.col("n")))


def contrast(df: DataFrame, value: str, *facet: str) -> DataFrame:
    """Per problem and facet: mean over solved less mean over unsolved rows; both must exist."""
    diff = F.avg(F.when(F.col("correct"), F.col(value))) - F.avg(F.when(~F.col("correct"), F.col(value)))
    return df.groupBy("problem_id", *facet).agg(diff.alias("difference")).where("difference is not null")


def alignment(diffs: DataFrame, *facet: str) -> DataFrame:
    return diffs.groupBy(*facet).agg(F.count("*").alias("n_problems"), F.avg("difference").alias("mean_difference"))


FORK_VALUES = ("log_ratio", "mass_diff", "entropy_delta", "disagree", "stop_shift")


def fork_columns(df: DataFrame) -> DataFrame:
    """Mass gap, entropy difference, disagreement, and the shift of the strongest stop signal, of marker tokens."""
    view, student = F.greatest(*K.STOP_SIGNALS), F.greatest(*(f"{s}_student" for s in K.STOP_SIGNALS))
    out = df.withColumn("mass_diff", F.exp("logp") - F.exp("logp_student")).withColumn("entropy_delta", F.col("entropy") - F.col("entropy_student"))
    out = out.withColumn("disagree", (~F.col("top1_agree_with_student")).cast("double")).withColumn("stop_shift", view - student)
    return out.withColumn("stop_leaning_given_disagree", F.when(F.col("disagree") == 1, (F.col("stop_shift") > 0).cast("double")))


def entropy_side(df: DataFrame) -> DataFrame:
    """df with `high_entropy`: at or above the median entropy of the baseline rows."""
    median = df.where(F.col("condition") == K.BASELINE_PROFILE).agg(F.percentile("entropy_student", 0.5).alias("_m"))
    return df.crossJoin(F.broadcast(median)).withColumn("high_entropy", F.col("entropy_student") >= F.col("_m")).drop("_m")


def fork_facets(df: DataFrame) -> DataFrame:
    """Mean over problems of problem means, for each view, entropy side and outcome, all and together, by grouping sets."""
    values = [*FORK_VALUES, "stop_leaning_given_disagree"]
    sets = [["condition"], ["high_entropy"], ["correct"], ["condition", "high_entropy", "correct"], []]
    dims = ["condition", "high_entropy", "correct"]
    cells = [[F.col(c) for c in ("problem_id", *s)] for s in sets]
    inner = df.groupingSets(cells, "problem_id", *dims).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values))
    return inner.groupBy("g", *dims).agg(F.count("*").alias("n_problems"), F.sum("n").alias("n_tokens"), *(F.avg(v).alias(f"{v}_mean") for v in values)).drop("g")


def pooled(df: DataFrame, num: Column, den: Column, *facet: str) -> DataFrame:
    """Sum of problem sums over sum of problem sums; problems without a denominator are dropped."""
    one = df.groupBy("problem_id", *facet).agg(F.sum(num).alias("_n"), F.sum(den).alias("_d")).where("_d <> 0")
    return one.groupBy(*facet).agg((F.sum("_n") / F.sum("_d")).alias("ratio"), F.count("*").alias("n_problems"))


def think_answer(groups: DataFrame, *facet: str) -> DataFrame:
    """Shares of tokens and of divergence in the answer part: pooled, and as the mean over trajectories."""
    per = F.avg(F.when(F.col("full_kl_sum") > 0, F.col("full_kl_sum_answer") / F.col("full_kl_sum")))
    whole = groups.groupBy(*facet).agg(
        F.count("*").alias("n_groups"), F.countDistinct(F.struct("problem_id", "sample_index")).alias("n_trajectories"), F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_answer_tokens") / F.greatest(F.sum("n_tokens"), F.lit(1))).alias("answer_token_share"), per.alias("mean_answer_kl_share"),
    )
    ratio = pooled(groups, F.col("full_kl_sum_answer"), F.col("full_kl_sum"), *facet).withColumnRenamed("ratio", "answer_kl_share")
    return whole.join(ratio, list(facet), "left") if facet else whole.crossJoin(ratio)


def quartiles(groups: DataFrame) -> DataFrame:
    """Token and divergence share of each quartile of positions."""
    long = groups.select("problem_id", "n_tokens", "full_kl_sum", F.posexplode(F.array(*(F.struct(F.col(f"n_tokens_q{q}").alias("n"), F.col(f"full_kl_sum_q{q}").alias("kl")) for q in range(4)))).alias("quartile", "q"))
    return long.groupBy("quartile").agg((F.sum("q.n") / F.greatest(F.sum("n_tokens"), F.lit(1))).alias("token_share"), F.try_divide(F.sum("q.kl"), F.nullif(F.sum("full_kl_sum"), F.lit(0.0))).alias("kl_share"))


def capped(groups: DataFrame, finish: DataFrame) -> DataFrame:
    """groups with `capped`, by (problem, sample); `missing` where no record tells."""
    return groups.join(finish.select("problem_id", "sample_index", F.col("capped").alias("_c")), ["problem_id", "sample_index"], "left").withColumn("missing", F.col("_c").isNull()).withColumn("capped", F.coalesce("_c", F.lit(False))).drop("_c")


def drift_matrix(alignments: DataFrame, students: list[str]) -> DataFrame:
    """A row for each view and a column for each student, of the mean differences."""
    return alignments.groupBy("condition").pivot("student", students).agg(F.first("mean_difference"))


def gate(base: DataFrame, drift: DataFrame, low: str, high: str) -> DataFrame:
    """Of two views, `low` and `high`: whether the drifted value of each lies outside its base interval and whether their order turns.

    base: (view, value, ci_lo, ci_hi); drift: (view, value).  Branch A if any
    of the three holds, else B; without both views in both tables it is not
    evaluable and has no branch.
    """
    both = base.join(drift.select("view", F.col("value").alias("drifted")), "view")
    of = lambda view, x: F.max(F.when(F.col("view") == view, x))
    out = ~F.col("drifted").between(F.col("ci_lo"), F.col("ci_hi"))
    flip = (of(low, F.col("value")) < of(high, F.col("value"))) != (of(low, F.col("drifted")) < of(high, F.col("drifted")))
    row = both.agg(of(low, out).alias("low_outside"), of(high, out).alias("high_outside"), flip.alias("order_flip"))
    any_ = F.col("low_outside") | F.col("high_outside") | F.col("order_flip")
    there = F.col("low_outside").isNotNull() & F.col("high_outside").isNotNull()
    return row.withColumn("evaluable", there).withColumn("branch", F.when(there & any_, "A").when(there, "B"))
