"""Queries over resampling, rank statistics and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample
from .inputs import graded, with_tables
from .registry import query, read, rounded

N = resample.K.BOOT_REPLICATES


def weights_sql(ids: str, key: str, seed: int, purpose: str = "", stratum: str = "'all'", name: str = "w") -> str:
    """CTEs that end in `name` (replicate, key, w)."""
    return f"""{name}_ids as (select k, s, row_number() over (partition by s order by k) - 1 as i, count(*) over (partition by s) as n from (select distinct {key} as k, cast({stratum} as varchar) as s from {ids})),
{name}_picks as (select r as replicate, s, cast(('0x' || substr(md5('{seed}:{purpose}:' || s || ':' || r || ':' || i), 1, 8)) as bigint) % n as i from {name}_ids, generate_series(0, {N - 1}) t(r)),
{name} as (select p.replicate, x.k as {key}, count(*) as w from {name}_picks p join {name}_ids x using (s, i) group by 1, 2)"""


CLUSTERS = "c as (select cluster, avg(value) as v, sum(value) as num, cast(count(*) as double) as den from graded group by 1)"


def _clusters(spark, sf_dir):
    return graded(spark, sf_dir).groupBy("cluster").agg(F.avg("value").alias("v"), F.sum("value").alias("num"), F.count("*").cast("double").alias("den"))


@query(with_tables(f"with {CLUSTERS}, {weights_sql('c', 'cluster', 42)}, b as (select replicate, sum(v * w) / sum(w) as m from c join w using (cluster) group by 1) select round((select avg(v) from c), 6) as point, (select count(*) from c) as n, round(quantile_cont(m, 0.025), 6) as ci_lo, round(quantile_cont(m, 0.975), 6) as ci_hi from b"))
def boot_mean_ci(spark, sf_dir):
    c = _clusters(spark, sf_dir)
    return rounded(resample.mean_interval(c, resample.weights(c, "cluster"), "cluster", "v"))


@query(with_tables(f"with {CLUSTERS}, {weights_sql('c', 'cluster', 42)}, b as (select replicate, sum(num * w) / sum(den * w) as m from c join w using (cluster) group by 1) select round((select sum(num) / sum(den) from c), 6) as point, (select count(*) from c) as n_clusters, round(quantile_cont(m, 0.025), 6) as ci_lo, round(quantile_cont(m, 0.975), 6) as ci_hi from b"))
def boot_ratio_ci(spark, sf_dir):
    c = _clusters(spark, sf_dir)
    return rounded(resample.ratio_interval(c, resample.weights(c, "cluster"), "cluster", "num", "den"))


STRATA = "s as (select cluster, cast(substr(cluster, 4) as int) % 3 as g, avg(value) filter (problem_id % 2 = 0) as a, avg(value) filter (problem_id % 2 = 1) as b from graded group by 1, 2)"


@query(with_tables(f"with {STRATA}, {weights_sql('s', 'cluster', 20260810, stratum='g')}, d as (select cluster, (a - b) * 100 as d from s), b as (select replicate, sum(d * w) / sum(w) as m from d join w using (cluster) group by 1), o as (select (select avg(d) from d) as delta, (select count(*) filter (d is null) from d) as n_missing, (select count(*) from d) as n, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi, least(greatest(2 * least(avg(cast(m <= 0 as int)), avg(cast(m >= 0 as int))), 1e-4), 1) as p from b) select n, n_missing, case when n_missing = 0 then round(delta, 6) end as delta, case when n_missing = 0 then round(lo, 6) end as ci_lo, case when n_missing = 0 then round(hi, 6) end as ci_hi, case when n_missing = 0 then round(p, 6) end as p, case when n_missing = 0 then lo > 0 or hi < 0 end as resolved from o"))
def boot_stratified_delta(spark, sf_dir):
    half = F.col("problem_id") % 2
    s = graded(spark, sf_dir).groupBy("cluster").agg(F.avg(F.when(half == 0, F.col("value"))).alias("a"), F.avg(F.when(half == 1, F.col("value"))).alias("b")).withColumn("g", F.substring("cluster", 4, 9).cast("int") % 3)
    w = resample.weights(s, "cluster", "g", seed=resample.K.SEED_ESTIMATOR)
    return rounded(resample.paired_delta(s.select("cluster", F.col("a").alias("x")), s.select("cluster", F.col("b").alias("x")), w, "cluster", "x"))


TWO = "x as (select cluster as ca, avg(value) as v from graded where view = 'en' group by 1), y as (select cluster as cb, avg(value) as v from graded where view <> 'en' group by 1)"


@query(with_tables(f"with {TWO}, {weights_sql('x', 'ca', 42, 'a', name='wa')}, {weights_sql('y', 'cb', 42, 'b', name='wb')}, a as (select replicate, sum(v * w) / sum(w) as m from x join wa using (ca) group by 1), b as (select replicate, sum(v * w) / sum(w) as m from y join wb using (cb) group by 1) select round((select avg(v) from x) - (select avg(v) from y), 6) as point, round(quantile_cont(a.m - b.m, 0.025), 6) as ci_lo, round(quantile_cont(a.m - b.m, 0.975), 6) as ci_hi from a join b using (replicate)"))
def boot_two_sample(spark, sf_dir):
    g = graded(spark, sf_dir)
    a = g.where("view = 'en'").groupBy("cluster").agg(F.avg("value").alias("v"))
    b = g.where("view <> 'en'").groupBy("cluster").agg(F.avg("value").alias("v"))
    return rounded(resample.two_sample(a, b, "cluster", "v"))


@query(with_tables("with r as (select view, correct, rank() over (partition by view order by score) + (count(*) over (partition by view, score) - 1) / 2e0 as r from graded) select view, count(*) filter (correct) as n_pos, count(*) filter (not correct) as n_neg, round((sum(r) filter (correct) - count(*) filter (correct) * (count(*) filter (correct) + 1) / 2e0) / nullif(count(*) filter (correct) * count(*) filter (not correct), 0), 6) as auroc from r group by 1"))
def auroc(spark, sf_dir):
    return rounded(resample.auroc(graded(spark, sf_dir), "score", F.col("correct"), "view"))


_T = "t as (select score, cluster, count(*) filter (correct) as p, count(*) filter (not correct) as q from graded group by 1, 2)"


@query(with_tables(f"with {_T}, {weights_sql('t', 'cluster', 42)}, z as (select replicate, score, sum(p * w) as p, sum(q * w) as q from t join w using (cluster) group by 1, 2), u as (select replicate, p, q, p * (coalesce(sum(q) over (partition by replicate order by score rows between unbounded preceding and 1 preceding), 0) + q / 2e0) as u from z), b as (select replicate, sum(u) / nullif(sum(p) * sum(q), 0) as m from u group by 1), z0 as (select score, sum(p) as p, sum(q) as q from t group by 1), u0 as (select p, q, p * (coalesce(sum(q) over (order by score rows between unbounded preceding and 1 preceding), 0) + q / 2e0) as u from z0) select (select sum(p) from u0)::bigint as n_pos, (select sum(q) from u0)::bigint as n_neg, round((select sum(u) / (sum(p) * sum(q)) from u0), 6) as auroc, round(quantile_cont(m, 0.025), 6) as ci_lo, round(quantile_cont(m, 0.975), 6) as ci_hi, count(*) as n_replicates from b where m is not null"))
def boot_auroc(spark, sf_dir):
    g = graded(spark, sf_dir)
    return rounded(resample.auroc_interval(g, resample.weights(g, "cluster"), "cluster", "score", F.col("correct")))


@query("with t as (select source, (abs(hash_) % 1000) / 9999e0 as p from (select source, count(*) * 37 as hash_ from documents group by 1)) select source, round(p, 6) as p, round(h, 6) as p_holm, h <= 0.05 as rejected from (select source, p, least(1, max((m - k + 1) * p) over (order by p, source rows unbounded preceding)) as h from (select source, p, count(*) over () as m, row_number() over (order by p, source) as k from t))")
def holm(spark, sf_dir):
    t = read(spark, sf_dir, "documents").groupBy("source").agg(((F.count("*") * 37 % 1000) / 9999.0).alias("p"))
    return rounded(resample.holm(t, "source", "p"))


@query("with r as (select lang, row_number() over (partition by lang order by n_chars, doc_id) as a, row_number() over (partition by lang order by source, doc_id) as b from documents) select lang, round(corr(a, b), 6) as rho, count(*) as n from r group by 1")
def spearman_ranks(spark, sf_dir):
    return rounded(resample.spearman(read(spark, sf_dir, "documents"), "n_chars", "source", "doc_id", "lang"))


@query("select doc_id, rank() over (partition by lang order by source) + (count(*) over (partition by lang, source) - 1) / 2e0 as avg_rank from documents")
def average_ranks(spark, sf_dir):
    return resample.average_rank(read(spark, sf_dir, "documents"), "source", "lang").select("doc_id", "avg_rank")


EXT = "e as (select problem_id, (a - b) * 100e0 / 12 as d from (select cast(substr(cluster, 4) as int) as problem_id, count(*) filter (correct) % 13 as a, count(*) filter (not correct) % 13 as b from graded group by 1))"


@query(with_tables(f"with {EXT}, {weights_sql('e', 'problem_id', 0, 'external')}, b as (select replicate, sum(d * w) / sum(w) as m from e join w using (problem_id) group by 1), s as (select list_sort(list(m)) as s from b) select round((select avg(d) from e), 6) as point, round(s[{int(0.025 * N) + 1}], 6) as ci_lo, round(s[{int(0.975 * N)}], 6) as ci_hi from s"))
def boot_external(spark, sf_dir):
    c = graded(spark, sf_dir).groupBy(F.substring("cluster", 4, 9).cast("int").alias("problem_id")).agg((F.count_if("correct") % 13).alias("a"), (F.count_if(~F.col("correct")) % 13).alias("b"))
    return rounded(resample.external_interval(c))


@query()
def seed_intervals(spark, sf_dir):
    """Student intervals of the share of good documents by language over four seeds."""
    v = graded(spark, sf_dir).groupBy("view", (F.col("problem_id") % 4).alias("seed")).agg(F.avg("value").alias("x"))
    return rounded(resample.seed_interval(v, "x", "view"))


@query()
def welch_interval(spark, sf_dir):
    v = graded(spark, sf_dir).groupBy("cluster", F.when(F.col("view") == "en", "a").otherwise("b").alias("side")).agg(F.avg("value").alias("x"))
    return rounded(resample.welch(v, "x", "side"))


@query()
def lopo_auroc(spark, sf_dir):
    """Grouped out-of-fold logistic predictions of quality from text length, by language, and their AUROC."""
    g = graded(spark, sf_dir).select("problem_id", "cluster", "view", F.log1p(F.col("score").cast("double")).alias("feature"), F.col("correct").cast("double").alias("y"))
    p = resample.out_of_fold(g, "feature", "y", "cluster", "view").where("predicted is not null and not isnan(predicted)")
    return rounded(resample.auroc(p, "predicted", F.col("y") == 1, "view"))


@query(with_tables("with f as (select view, correct, unnest(['length', 'toxic']) as feature, unnest([cast(score as double), cast(toxic as int)::double]) as x from graded), r as (select view, feature, correct, rank() over (partition by view, feature order by x) + (count(*) over (partition by view, feature, x) - 1) / 2e0 as r from f), a as (select view, feature, (sum(r) filter (correct) - count(*) filter (correct) * (count(*) filter (correct) + 1) / 2e0) / nullif(count(*) filter (correct) * count(*) filter (not correct), 0) as auroc from r group by 1, 2) select view, round(max(auroc) filter (feature = 'length'), 6) as length, round(max(auroc) filter (feature = 'toxic'), 6) as toxic, arg_max(feature, auroc) as best, count(*) filter (auroc = m) as n_best from (select *, max(auroc) over (partition by view) as m from a) group by 1"))
def win_table(spark, sf_dir):
    g = graded(spark, sf_dir).select("view", "correct", F.explode(F.array(F.struct(F.lit("length").alias("feature"), F.col("score").cast("double").alias("x")), F.struct(F.lit("toxic").alias("feature"), F.col("toxic").cast("int").cast("double").alias("x")))).alias("f")).select("view", "correct", "f.*")
    return rounded(resample.win_table(resample.auroc(g, "x", F.col("correct"), "view", "feature")))
