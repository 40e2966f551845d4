"""Queries over token profiles and logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import tensor
from ..operators import checks, profile as ops, resample
from .inputs import profile, records, with_tables
from .registry import query, read, rounded
from .statistics import weights_sql

Q = "least(greatest(floor(normalized_position * 4), 0), 3)"
_GROUP = """select problem_id, sample_index, condition, bool_or(correct) as correct, count(*) as n_tokens, count(*) filter (token_category = 'think') as n_think_tokens, count(*) filter (token_category = 'answer') as n_answer_tokens, max(pi_length_tokens) as pi_length_tokens, """ + ", ".join(
    f"coalesce(sum({k}), 0) as {k}_sum, coalesce(sum({k}) filter (token_category = 'think'), 0) as {k}_sum_think, coalesce(sum({k}) filter (token_category = 'answer'), 0) as {k}_sum_answer, " + ", ".join(f"coalesce(sum({k}) filter ({Q} = {q}), 0) as {k}_sum_q{q}" for q in range(4))
    for k in ("full_kl", "clipped_kl")
) + ", " + ", ".join(f"count(*) filter ({Q} = {q}) as n_tokens_q{q}" for q in range(4)) + """, sum(log_ratio) as log_ratio_sum, avg(log_ratio) as log_ratio_mean, avg(entropy) as entropy_mean, avg(entropy_student) as entropy_student_mean,
avg(cast(not top1_agree_with_student as int)) as top1_disagreement_rate, count(*) filter (is_correction_marker) as marker_count, coalesce(sum(log_ratio) filter (is_correction_marker), 0) as marker_log_ratio_sum, """ + ", ".join(
    f"avg({x}) as {n}_mean, max({x}) as {n}_max" for s in K.STOP_SIGNALS for x, n in ((s, s), (f"{s}_student", f"{s}_student"), (f"{s} - {s}_student", f"{s}_delta"))
) + " from profile group by 1, 2, 3"
_MEANS = ", ".join(f"{k}_sum / n_tokens as {k}_mean, " + ", ".join(f"{k}_sum_{p} / nullif({n}, 0) as {k}_mean_{p}" for p, n in (("think", "n_think_tokens"), ("answer", "n_answer_tokens"), *((f"q{q}", f"n_tokens_q{q}") for q in range(4)))) for k in ("full_kl", "clipped_kl"))
ROUND = "select columns(lambda c: c in ('problem_id', 'sample_index', 'condition', 'correct') or c like 'n_%' or c = 'marker_count'), round(columns(lambda c: not (c in ('problem_id', 'sample_index', 'condition', 'correct') or c like 'n_%' or c = 'marker_count')), 6) from "


@query(with_tables(f"with g as ({_GROUP}), m as (select *, {_MEANS}, marker_log_ratio_sum / nullif(marker_count, 0) as marker_log_ratio_mean from g) {ROUND} m"))
def profile_per_group(spark, sf_dir):
    return rounded(ops.per_group(profile(spark, sf_dir)))


def _lg(p):
    return f"ln(least(greatest({p}, 1e-7), 1 - 1e-7) / (1 - least(greatest({p}, 1e-7), 1 - 1e-7)))"


@query(with_tables("select condition, correct, cast(least(greatest(floor(normalized_position * 50), 0), 49) as int) as pos_bin, round((least(greatest(floor(normalized_position * 50), 0), 49) + 0.5) / 50, 6) as bin_center, count(*) as n_tokens, round(avg(full_kl), 6) as mean_full_kl, round(avg(entropy - entropy_student), 6) as mean_entropy_delta, round(avg(clipped_kl), 6) as mean_clipped_kl, " + ", ".join(f"round(avg({s}), 6) as mean_{s}, round(avg({s}_student), 6) as mean_{s}_student, round(avg({s} - {s}_student), 6) as mean_{s}_delta, round(avg({_lg(s)} - {_lg(s + '_student')}), 6) as mean_{s}_logit_diff" for s in K.STOP_SIGNALS) + " from profile group by 1, 2, 3, 4"))
def profile_position_bins(spark, sf_dir):
    return rounded(ops.position_profile(profile(spark, sf_dir)))


@query(with_tables("select problem_id, sample_index, condition, region, token_category, bool_or(correct) as correct, round(sum(log_ratio), 6) as log_ratio_sum, count(*) as n_tokens from profile group by 1, 2, 3, 4, 5"))
def region_category_sums(spark, sf_dir):
    return rounded(ops.region_sums(profile(spark, sf_dir)))


@query(with_tables("select *, round(logp, 6) as logp6 from (select problem_id, sample_index, condition, position, logp from profile where is_correction_marker)").replace("select *, round(logp, 6) as logp6", "select problem_id, sample_index, condition, position, round(logp, 6) as logp"))
def marker_token_rows(spark, sf_dir):
    return rounded(ops.marker_tokens(profile(spark, sf_dir)).select("problem_id", "sample_index", "condition", "position", "logp"))


@query(with_tables("select count(*) as n_rows, count(distinct problem_id) as n_problems, count(distinct (problem_id, sample_index)) as n_trajectories, count(distinct condition) as n_conditions, count(distinct (problem_id, sample_index, condition)) as n_groups, round(coalesce(max(abs(full_kl)) filter (condition = 'none'), 0), 6) as max_baseline_kl from profile"))
def profile_sanity(spark, sf_dir):
    return rounded(ops.sanity(profile(spark, sf_dir)))


@query(with_tables("select count(*) as n_violations from profile where condition = 'none' and (log_ratio <> 0 or full_kl <> 0 or not top1_agree_with_student or entropy <> entropy_student)"))
def baseline_check(spark, sf_dir):
    return checks.baseline_rows(profile(spark, sf_dir)).agg(F.count("*").alias("n_violations"))


GROUPS = "g as (select problem_id, sample_index, condition, bool_or(correct) as correct, avg(log_ratio) as m, sum(full_kl) as kl, sum(full_kl) filter (token_category = 'answer') as kla, count(*) as n, count(*) filter (token_category = 'answer') as na from profile group by 1, 2, 3)"


@query(with_tables("with s as (select problem_id, sample_index, bool_or(correct) as c from profile group by 1, 2) select problem_id, sum(cast(c as int))::bigint as n_correct, count(*) as n from s group by 1 having sum(cast(c as int)) >= 1 and sum(cast(c as int)) < count(*)"))
def eligible_mixed(spark, sf_dir):
    return ops.eligible(profile(spark, sf_dir))


@query(with_tables(f"with {GROUPS}, e as (select problem_id from (select problem_id, sample_index, bool_or(correct) as c from g group by 1, 2) group by 1 having count(distinct c) = 2), d as (select condition, problem_id, avg(m) filter (correct) - avg(m) filter (not correct) as d from g where problem_id in (select problem_id from e) and condition <> 'none' group by 1, 2) select condition, count(d) as n_problems, round(avg(d), 6) as mean_difference from d where d is not null group by 1"))
def facet_contrast(spark, sf_dir):
    g = ops.per_group(profile(spark, sf_dir))
    g = g.join(ops.eligible(g), "problem_id", "left_semi").where("condition <> 'none'")
    return rounded(ops.alignment(ops.contrast(g, "log_ratio_mean", "condition"), "condition"))


@query(with_tables("with r as (select problem_id, sample_index, condition, region, token_category, bool_or(correct) as correct, sum(log_ratio) / count(*) as m from profile where condition <> 'none' group by 1, 2, 3, 4, 5), d as (select condition, region, problem_id, avg(m) filter (correct) - avg(m) filter (not correct) as d from r group by 1, 2, 3) select condition, region, count(d) as n_problems, round(avg(d), 6) as mean_difference from d where d is not null group by 1, 2"))
def region_contrast(spark, sf_dir):
    r = ops.region_sums(profile(spark, sf_dir).where("condition <> 'none'")).withColumn("m", F.col("log_ratio_sum") / F.col("n_tokens"))
    return rounded(ops.alignment(ops.contrast(r, "m", "condition", "region"), "condition", "region"))


_V = "greatest(eos_prob, think_close_prob, answer_transition_prob) - greatest(eos_prob_student, think_close_prob_student, answer_transition_prob_student)"
_FACETS = [("condition", "null::boolean", "null::boolean"), ("null", "high_entropy", "null::boolean"), ("null", "null::boolean", "correct"), ("condition", "high_entropy", "correct"), ("null", "null::boolean", "null::boolean")]


@query(with_tables(f"""with m as (select *, entropy_student >= (select quantile_cont(entropy_student, 0.5) from profile where is_correction_marker and condition = 'none') as high_entropy from profile where is_correction_marker),
v as (select problem_id, condition, high_entropy, correct, log_ratio, exp(logp) - exp(logp_student) as mass_diff, entropy - entropy_student as entropy_delta, cast(not top1_agree_with_student as int)::double as disagree, {_V} as stop_shift, case when not top1_agree_with_student then cast(({_V}) > 0 as int)::double end as lean from m where condition <> 'none'),
u as (""" + " union all ".join(f"select {i} as g, {a} as condition, {b} as high_entropy, {c} as correct, problem_id, count(*) as n, avg(log_ratio) as a1, avg(mass_diff) as a2, avg(entropy_delta) as a3, avg(disagree) as a4, avg(stop_shift) as a5, avg(lean) as a6 from v group by all" for i, (a, b, c) in enumerate(_FACETS)) + ") select condition, high_entropy, correct, count(*) as n_problems, sum(n)::bigint as n_tokens, round(avg(a1), 6) as log_ratio_mean, round(avg(a2), 6) as mass_diff_mean, round(avg(a3), 6) as entropy_delta_mean, round(avg(a4), 6) as disagree_mean, round(avg(a5), 6) as stop_shift_mean, round(avg(a6), 6) as stop_leaning_given_disagree_mean from u group by g, condition, high_entropy, correct"))
def facet_grouping_sets(spark, sf_dir):
    m = ops.entropy_side(ops.marker_tokens(profile(spark, sf_dir)))
    return rounded(ops.fork_facets(ops.fork_columns(m.where("condition <> 'none'"))))


@query(with_tables(f"with {GROUPS}, p as (select condition, problem_id, sum(kla) as a, sum(kl) as b from g group by 1, 2 having sum(kl) <> 0) select condition, round(sum(a) / sum(b), 6) as ratio, count(*) as n_problems from p group by 1"))
def pooled_ratio(spark, sf_dir):
    g = ops.per_group(profile(spark, sf_dir))
    return rounded(ops.pooled(g, F.col("full_kl_sum_answer"), F.col("full_kl_sum"), "condition"))


@query(with_tables(f"with {GROUPS}, p as (select condition, problem_id, sum(coalesce(kla, 0)) as a, sum(kl) as b from g group by 1, 2 having sum(kl) <> 0), r as (select condition, sum(a) / sum(b) as r, count(*) as n_problems from p group by 1), w as (select condition, count(*) as n_groups, count(distinct (problem_id, sample_index)) as n_trajectories, sum(n)::bigint as n_tokens, sum(na) / greatest(sum(n), 1) as s, avg(case when kl > 0 then coalesce(kla, 0) / kl end) as q from g group by 1) select condition, n_groups, n_trajectories, n_tokens, round(s, 6) as answer_token_share, round(q, 6) as mean_answer_kl_share, round(r, 6) as answer_kl_share, n_problems from w left join r using (condition)"))
def think_answer_accounting(spark, sf_dir):
    return rounded(ops.think_answer(ops.per_group(profile(spark, sf_dir)), "condition"))


@query(with_tables(f"with t as (select {Q} as q, full_kl from profile) select cast(q as int) as quartile, round(count(*) / (select count(*) from t), 6) as token_share, round(sum(full_kl) / (select sum(full_kl) from t), 6) as kl_share from t group by 1"))
def quartile_accounting(spark, sf_dir):
    return rounded(ops.quartiles(ops.per_group(profile(spark, sf_dir))))


@query(with_tables(f"with {GROUPS}, f as (select problem_id, sample_index, bool_or(finish_reason = 'length') as c from records group by 1, 2), x as (select g.*, f.c is null as missing, coalesce(f.c, false) as capped from g left join f using (problem_id, sample_index)) select capped, missing, count(*) as n_groups, sum(n)::bigint as n_tokens, round(sum(kl), 6) as kl from x group by 1, 2"))
def capped_share(spark, sf_dir):
    finish = records(spark, sf_dir).groupBy("problem_id", "sample_index").agg(F.bool_or(F.col("finish_reason") == "length").alias("capped"))
    x = ops.capped(ops.per_group(profile(spark, sf_dir)), finish)
    return rounded(x.groupBy("capped", "missing").agg(F.count("*").alias("n_groups"), F.sum("n_tokens").alias("n_tokens"), F.sum("full_kl_sum").alias("kl")))


@query(with_tables(f"with {GROUPS}, d as (select condition, sample_index, problem_id, m from g), x as (select condition, cast(sample_index as varchar) as student, avg(m) as v from d group by 1, 2) select condition, " + ", ".join(f"round(max(v) filter (student = '{i}'), 6) as \"{i}\"" for i in range(4)) + " from x group by 1"))
def drift_matrix(spark, sf_dir):
    g = ops.per_group(profile(spark, sf_dir))
    a = g.groupBy("condition", F.col("sample_index").cast("string").alias("student")).agg(F.avg("log_ratio_mean").alias("mean_difference"))
    return rounded(ops.drift_matrix(a, [str(i) for i in range(4)]))


GATE = f"""with c as (select condition as view, problem_id % 7 as cluster, avg(full_kl) as v from profile where problem_id % 2 = 0 and condition in ('click', 'purchase') group by 1, 2),
d as (select condition as view, avg(full_kl) as v from profile where problem_id % 2 = 1 group by 1), {weights_sql('c', 'cluster', 42)}, m as (select view, replicate, sum(v * w) / sum(w) as m from c join w using (cluster) group by 1, 2),
i as (select view, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from m group by 1), b as (select z.view, z.x, i.lo, i.hi, d.v as y from (select view, avg(v) as x from c group by 1) z join i using (view) join d using (view)),
g as (select l.y not between l.lo and l.hi as low_outside, h.y not between h.lo and h.hi as high_outside, (l.x < h.x) <> (l.y < h.y) as order_flip from b l, b h where l.view = 'click' and h.view = 'purchase')
select *, true as evaluable, case when low_outside or high_outside or order_flip then 'A' else 'B' end as branch from g"""


@query(with_tables(GATE))
def gate_rule(spark, sf_dir):
    """Intervals of one half of the problems as the base, means of the other half as the drifted values."""
    p = profile(spark, sf_dir).where("condition in ('click', 'purchase')")
    cells = p.where("problem_id % 2 = 0").groupBy(F.col("condition").alias("view"), (F.col("problem_id") % 7).alias("cluster")).agg(F.avg("full_kl").alias("v"))
    base = resample.mean_interval(cells, resample.weights(cells, "cluster"), "cluster", "v", "view").withColumnRenamed("point", "value")
    return ops.gate(base, p.where("problem_id % 2 = 1").groupBy(F.col("condition").alias("view")).agg(F.avg("full_kl").alias("value")), "click", "purchase")


_LS = "list_transform(embedding, lambda x: cast(x as double) - list_max(embedding) - ln(list_sum(list_transform(embedding, lambda y: exp(cast(y as double) - list_max(embedding))))))"
LOGITS = f"l as (select vec_id, label, embedding, {_LS} as lp from embeddings)"
PAIRS = f"with {LOGITS}, k as (select a.vec_id, a.lp as p, b.lp as q from l a join l b on b.vec_id = a.vec_id + 1), z as (select vec_id, list_transform(list_zip(p, q), lambda x: exp(x[1]) * (x[1] - x[2])) as t from k) "


def _logp(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", tensor.log_softmax(F.col("embedding")).alias("lp"), "embedding")


@query(f"with {LOGITS} select vec_id, round(-list_sum(list_transform(lp, lambda x: exp(x) * x)), 6) as entropy, cast(list_position(embedding, list_max(embedding)) - 1 as bigint) as top, round(lp[label + 1], 6) as target_logp from l")
def log_softmax_entropy(spark, sf_dir):
    d = _logp(spark, sf_dir)
    return rounded(d.select("vec_id", tensor.entropy(F.col("lp")).alias("entropy"), tensor.argmax(F.col("embedding")).alias("top"), tensor.gather(F.col("lp"), F.col("label")).alias("target_logp")))


def _pairs(spark, sf_dir):
    d = _logp(spark, sf_dir)
    return d.select("vec_id", F.col("lp").alias("p")).join(d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("lp").alias("q")), "vec_id")


@query(PAIRS + "select vec_id, round(list_sum(t), 6) as kl from z")
def forward_kl(spark, sf_dir):
    return rounded(_pairs(spark, sf_dir).select("vec_id", tensor.forward_kl(F.col("p"), F.col("q")).alias("kl")))


@query(PAIRS + "select vec_id, round(list_sum(list_transform(t, lambda x: least(x, 0.0005))), 6) as kl, round(list_sum(list_filter(t, lambda x: x > 0)) / greatest(len(list_filter(t, lambda x: x > 0)), 1), 6) as masked from z")
def clipped_kl(spark, sf_dir):
    d = _pairs(spark, sf_dir).withColumn("t", F.zip_with("p", "q", lambda p, q: F.exp(p) * (p - q)))
    return rounded(d.select("vec_id", tensor.clipped_kl(F.col("p"), F.col("q"), 0.0005).alias("kl"), tensor.masked_mean(F.col("t"), F.transform("t", lambda x: x > 0)).alias("masked")))
