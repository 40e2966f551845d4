"""Queries over graded samples, splits, planning and training logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading, tensor
from ..operators import planning, resample, splits
from .inputs import graded, records, with_tables
from .registry import query, read, rounded

RULES = """case when coalesce(rescued, false) and has_rescued_output then coalesce(rescued_correct, correct) else correct end as estimator,
 coalesce(case when coalesce(rescued, false) then rescued_correct else correct end, false) as split, coalesce(rescued_correct, correct) as value,
 case when coalesce(rescued, false) then coalesce(rescued_correct, false) else coalesce(correct, false) end as profile, case when coalesce(rescued, false) then rescued_finish_reason else finish_reason end as final_finish"""


def _rules(df):
    r = {c: F.col(c) for c in ("rescued", "rescued_correct", "correct", "has_rescued_output", "rescued_finish_reason", "finish_reason")}
    named = {"estimator": grading.rescue_estimator, "split": grading.rescue_split, "value": grading.rescue_value, "profile": grading.rescue_profile, "final_finish": grading.final_finish}
    return df.withColumns({k: f(r) for k, f in named.items()})


@query(with_tables(f"select problem_id, sample_index, {RULES} from records"))
def rescue_rules(spark, sf_dir):
    return _rules(records(spark, sf_dir)).select("problem_id", "sample_index", "estimator", "split", "value", "profile", "final_finish")


@query(with_tables(f"select problem_id, count(*) as n, round(avg(cast(split as int)), 6) as avg, count(*) = 4 as complete from (select problem_id, {RULES} from records) group by 1"))
def avg_at_k_cell(spark, sf_dir):
    return rounded(splits.average(_rules(records(spark, sf_dir)), "problem_id", F.col("split"), 4))


@query(with_tables("select condition, count(*) as n, round(avg(cast(coalesce(correct, false) as int)), 6) as correct, round(avg(cast(hit_length_cap as int)), 6) as capped, round(avg(cast((case when rescued then rescued_finish_reason else finish_reason end) = 'length' as int)), 6) as capped_after, round(avg(cast(answer_extracted is null as int)), 6) as no_answer from records group by 1"))
def outcome_rates(spark, sf_dir):
    return rounded(planning.outcome_rates(records(spark, sf_dir), "condition"))


BANDS = "case when avg >= 0.75 then 'easy' when avg > 0 then 'frontier' when avg = 0 then 'hard_pool' end"


@query(with_tables(f"select band, count(*) as n from (select {BANDS} as band from (select problem_id, avg(cast(coalesce(correct, false) as int)) as avg from records group by 1)) group by 1"))
def bucket_by_avg(spark, sf_dir):
    avg = splits.average(records(spark, sf_dir), "problem_id", F.coalesce("correct", F.lit(False)))
    return avg.groupBy(splits.band(F.col("avg")).alias("band")).agg(F.count("*").alias("n"))


@query(with_tables("""with h as (select problem_id from records group by 1 having max(cast(coalesce(correct, false) as int)) = 0)
select problem_id, count(condition) as n_attempts, cast(count(distinct condition) as int) as n_conditions, coalesce(bool_or(rescued_correct), false) as recoverable from h left join (select problem_id, condition, coalesce(rescued_correct, false) as rescued_correct from records where condition <> 'user') using (problem_id) group by 1"""))
def hard_recoverable(spark, sf_dir):
    r = records(spark, sf_dir)
    hard = r.groupBy("problem_id").agg(F.bool_or(F.coalesce("correct", F.lit(False))).alias("any")).where("not any").select("problem_id")
    return splits.recoverable(hard, r.where("condition <> 'user'"), "problem_id", F.coalesce("rescued_correct", F.lit(False)))


SPLIT = """with s as (select doc_id, lang, count(*) over (partition by lang) as n, row_number() over (partition by lang order by md5('42:' || lang || ':' || doc_id), doc_id) as i from documents),
q as (select *, case when n < 704 then floor(n * (512e0 / 704)) else 512 end as nt, case when n < 704 then floor(n * (64e0 / 704)) else 64 end as nd from s where n < 704 or i <= 704),
cut as (select doc_id, lang, case when i <= nt then 'train' when i <= nt + nd then 'dev' else 'test' end as split from q)
"""


@query(SPLIT + "select * from cut")
def split_quota(spark, sf_dir):
    return splits.quota_split(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")


@query("select lang, count(*) as before, count(*) filter (doc_id not in (select doc_id from labels where toxic = 1)) as after, count(*) filter (doc_id in (select doc_id from labels where toxic = 1)) as removed, count(*) filter (doc_id not in (select doc_id from labels where toxic = 1) and doc_id in (select doc_id from labels)) as in_prior from documents group by 1")
def split_accounting(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels")
    kept = splits.without(docs, "doc_id", labels.where("toxic = 1"))
    return splits.accounting(docs, kept, labels.select("doc_id"), "doc_id", "lang")


@query(with_tables("select problem_id, sample_index, condition from records where (problem_id, sample_index) not in (select (problem_id, sample_index) from records where sample_index < 2)"))
def resume_anti_join(spark, sf_dir):
    r = records(spark, sf_dir).select("problem_id", "sample_index", "condition")
    return planning.remaining(r, r.where("sample_index < 2"), ["problem_id", "sample_index"])


@query("with i as (select item_id as problem_id, row_number() over (order by item_id) - 1 as item_index from benchmark) select problem_id, cast(item_index as int) as item_index, cast(s as int) as sample_index, condition, 2000000 + s * 10000 + item_index as seed from i, generate_series(0, 3) t(s), (select unnest(['none', 'gist']) as condition)")
def task_plan(spark, sf_dir):
    items = planning.item_index(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("problem_id")))
    return planning.tasks(items, 4, model_index=2, conditions=["none", "gist"])


def _adapters(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("run_"), F.lower("n_name")).alias("run"), F.explode(F.array(F.lit(25), F.lit(50))).alias("step"))


ADAPTERS = "with a as (select 'run_' || lower(n_name) as run, unnest([25, 50]) as step from nation) "


@query(ADAPTERS + "select run, step, split, sum(n * k)::bigint as n_requests from a, (values ('dev', 64, 1), ('test', 384, 4)) s(split, n, k) group by all")
def plan_counts(spark, sf_dir):
    sizes = spark.createDataFrame([("dev", 64, 1), ("test", 384, 4)], "split string, n_items bigint, samples bigint")
    return planning.plan_counts(_adapters(spark, sf_dir), sizes)


@query(ADAPTERS + "select run, step, cast(row_number() over (order by run, step) as int) as lora_id, cast((row_number() over (order by run, step) - 1) // 14 as int) as chunk from a")
def adapter_chunks(spark, sf_dir):
    return planning.chunked(_adapters(spark, sf_dir))


@query("select 'run_' || lower(n_name) as run, step from (select n_name, unnest(case when n_nationkey % 2 = 0 then [10, 20] else [50] end) as step, n_nationkey as k from nation) where not (step = 20 and k % 4 = 0)")
def adapter_steps(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withColumn("run", F.concat(F.lit("run_"), F.lower("n_name")))
    runs = n.select("run", F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit(10), F.lit(20))).otherwise(F.array().cast("array<int>")).alias("steps"))
    gone = n.where(F.col("n_nationkey") % 4 == 0).select("run", F.lit(20).alias("step"))
    return planning.missing(planning.resolve_steps(runs, [50]), gone)


QUEUE = ADAPTERS.rstrip() + """, s as (select cast(i // 16 as int) as shard, count(*) as n from (select row_number() over (order by item_id) - 1 as i from benchmark) group by 1),
o as (select *, dense_rank() over (order by run, step) - 1 as d, replace(run, '_', '-') || '-step' || step || '-th' as cell from a),
jobs as (select lpad(cast(d as varchar), 2, '0') || '_q_' || cell || '_b' || lpad(cast(shard as varchar), 3, '0') as job_id, cell, run, step, shard, n * 4 as est_requests from o, s) """


def _jobs(spark, sf_dir):
    return planning.job_queue(_adapters(spark, sf_dir), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("problem_id")))


@query(QUEUE + "select * from jobs")
def queue_shards(spark, sf_dir):
    return _jobs(spark, sf_dir)


@query(QUEUE + "select job_id, cell from jobs where step = 50 and cell = (select min(cell) from jobs where step = 50)")
def queue_next_cell(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).withColumn("state", F.when(F.col("step") == 50, "pending").otherwise("done"))
    return planning.next_cell(jobs).select("job_id", "cell")


@query(QUEUE + "select job_id, case when step = 25 and shard % 3 = 0 then 'done' when step = 25 and shard % 3 = 1 then 'pending' when step = 25 then 'claimed' else 'pending' end as state from jobs")
def queue_states(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    last = F.when(F.col("shard") % 3 == 0, "finish").when(F.col("shard") % 3 == 1, "release").otherwise("claim")
    told = F.array(F.struct(F.lit(1).alias("seq"), F.lit("claim").alias("event")), F.struct(F.lit(2).alias("seq"), last.alias("event")))
    events = jobs.where("step = 25").select("job_id", F.explode(told).alias("e")).select("job_id", "e.*")
    return planning.apply_events(jobs, events).select("job_id", "state")


@query(QUEUE + "select job_id, est_requests, case when step = 25 then est_requests else 0 end as n, case when step = 25 then 0 else 90 end as rc from jobs")
def queue_acceptance(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    rows = jobs.where("step = 25").select("job_id", F.explode(F.sequence(F.lit(1), F.col("est_requests").cast("int"))).alias("i"))
    return planning.accepted(jobs, rows)


@query(with_tables("select count(*) as n, count(*) filter (sample_index > 6) as unplanned, count(*) filter (sample_index <= 6 and problem_id % 10 = 0) as other_seed, cast(0 as bigint) as other_tokens from records"))
def verify_tasks(spark, sf_dir):
    r = records(spark, sf_dir).select("problem_id", "sample_index", (F.col("problem_id") + F.col("sample_index") * 10_000).alias("seed"), "input_tokens")
    planned = r.where("sample_index <= 6").withColumn("seed", F.when(F.col("problem_id") % 10 == 0, -1).otherwise(F.col("seed")))
    return planning.regenerated(planned, r)


@query("with o as (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as p, count(*) over () as n from documents) select cast(i as bigint) as i, cast(i // n as bigint) as epoch, cast(p as int) as position, doc_id, cast(i + 300000000 as bigint) as sample_seed from generate_series(0, 4999) t(i) join o on i % n = p")
def train_stream(spark, sf_dir):
    return planning.train_stream(read(spark, sf_dir, "documents"), "doc_id", 5000, seed=39, offset=3)


@query("select 'local' as protocol, 1.0::double as temperature, 0.95::double as top_p, 20 as top_k, 1.0::double as repetition_penalty union all select 'official', 1.0, 0.95, -1, 1.0")
def sampling_profiles(spark, sf_dir):
    return planning.sampling(spark)


@query("""with c as (select doc_id, cast(n_chars as int) as n from documents), w as (select doc_id, n, greatest(cast(round_even(f * n, 0) as int) - 16, 0) as lo, least(cast(round_even(f * n, 0) as int) + 16, n) as hi from c, (select unnest([0.25, 0.5, 0.75]) as f)),
p as (select distinct doc_id, unnest(generate_series(lo, hi - 1)) as p from w where lo < hi), g as (select doc_id, p, p - row_number() over (partition by doc_id order by p) as k from p)
select doc_id, count(*) as n_support, count(distinct k) as n_windows from g group by 1""")
def loss_windows(spark, sf_dir):
    return _loss_windows(spark, sf_dir, F.col("n_chars"))


def _loss_windows(spark, sf_dir, length):
    docs = read(spark, sf_dir, "documents").select("doc_id", length.cast("int").alias("n"))
    d = docs.select("doc_id", tensor.loss_windows(F.col("n"), (0.25, 0.5, 0.75), 32).alias("p")).where("size(p) > 0")
    return d.select("doc_id", F.size("p").cast("bigint").alias("n_support"), F.size(tensor.windows_of(F.col("p"))).cast("bigint").alias("n_windows"))


@query(with_tables("select problem_id, round(sum(full_kl) / greatest(count(*), 1), 6) as off, round(sum(case when is_correction_marker then 0 else full_kl end) / greatest(count(*) filter (not is_correction_marker), 1), 6) as exclude, round(sum(case when is_correction_marker then 0.1e0 else 1e0 end * full_kl) / greatest(count(*), 1), 6) as downweight from profile group by 1"))
def fork_mask_losses(spark, sf_dir):
    from .inputs import profile

    m, kl = F.col("is_correction_marker"), F.col("full_kl")
    df = profile(spark, sf_dir).groupBy("problem_id").agg(
        *((F.sum(tensor.fork_weight(m, mode) * kl) / F.greatest(F.count_if(~m) if mode == "exclude" else F.count("*"), F.lit(1))).alias(mode) for mode in ("off", "exclude", "downweight"))
    )
    return rounded(df)


@query("""with t as (select vec_id, list_transform(embedding, lambda x: cast(floor(abs(x) * 50) as int)) as ids from embeddings), s as (select vec_id, ids, list_min(list_filter([list_position(ids, 3), list_position(ids, 7)], lambda x: x > 0)) as k from t)
select vec_id, cast(len(case when k is null then ids else ids[1:k] end) as int) as n, case when k is null then 'length' else 'stop' end as reason, cast(len(case when k is null then ids else ids[1:k] end) as int) + case when k is not null and ids[k] <> 3 then 1 else 0 end as n_eos from s""")
def stop_truncation(spark, sf_dir):
    return _stop_truncation(spark, sf_dir, F.col("embedding"))


def _stop_truncation(spark, sf_dir, values):
    ids = F.transform(values, lambda x: F.floor(F.abs(x) * 50).cast("int"))
    df = read(spark, sf_dir, "embeddings").select("vec_id", ids.alias("ids"))
    cut, reason = tensor.until_stop(F.col("ids"), (3, 7))
    df = df.select("vec_id", cut.alias("cut"), reason.alias("reason"))
    return df.select("vec_id", F.size("cut").alias("n"), "reason", F.size(tensor.with_eos(F.col("cut"), F.col("reason"), 3)).alias("n_eos"))


@query(with_tables("select sample_index as step, count(*) as n, round(avg(generated_tokens / 7e0), 6) as loss, round(avg(generated_tokens / 9e0), 6) as mean_token_kl, round(avg(generated_tokens), 6) as completion_tokens, round(avg(cast(correct as int)), 6) as correct, round(avg(cast(finish_reason = 'length' as int)), 6) as capped, round(greatest(0, 1 - sample_index / 8e0) * 5e-2, 6) as rate from records group by 1"))
def training_steps(spark, sf_dir):
    log = records(spark, sf_dir).select(F.col("sample_index").alias("step"), (F.col("generated_tokens") / 7).alias("loss"), (F.col("generated_tokens") / 9).alias("mean_token_kl"), F.col("generated_tokens").alias("completion_tokens"), F.col("correct").alias("correct_before_update"), "finish_reason")
    return rounded(planning.step_means(log).withColumn("rate", tensor.linear_decay(F.col("step"), 8, 5e-2)))


@query(with_tables("with c as (select problem_id, sample_index % 3 as seed, avg(cast(coalesce(correct, false) as int)) as v from records group by 1, 2) select problem_id, round(avg(v), 6) as value from c group by 1 having count(*) = 3"))
def seed_aware(spark, sf_dir):
    cells = records(spark, sf_dir).groupBy("problem_id", (F.col("sample_index") % 3).alias("seed")).agg(F.avg(F.coalesce("correct", F.lit(False)).cast("int")).alias("value"))
    return rounded(resample.seed_aware(cells))


@query(with_tables("select problem_id, sum(cast(coalesce(correct, false) as int))::bigint as num_correct, count(*) as n, count(*) = 8 as complete from records group by 1"))
def external_counts(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.groupBy("problem_id").agg(F.sum(F.coalesce("correct", F.lit(False)).cast("bigint")).alias("num_correct"), F.count("*").alias("n")).withColumn("complete", F.col("n") == 8)


@query(with_tables("select problem_id, sample_index, least(400, 32768 - input_tokens - 256) as budget, hit_length_cap and least(32768 - input_tokens - 256, 32512) > max_new_tokens as needs_rescue from records"))
def request_budgets(spark, sf_dir):
    from ..operators import normalize

    r = records(spark, sf_dir)
    return r.select("problem_id", "sample_index", normalize.request_budget(F.col("input_tokens"), 400).alias("budget"), normalize.needs_rescue(r).alias("needs_rescue"))


@query(r"""with w as (select conv_id, turn, regexp_extract_all(text, '\S+') as w from conversations) select conv_id, turn, """ + ", ".join(rf"coalesce(len(w) >= 2 and w[least({k}, len(w))] like '%a%', false) as correct_at_{k}" for k in (4, 8, 16)) + " from w")
def budget_grades(spark, sf_dir):
    from ..functions.text import prefix_text

    c = read(spark, sf_dir, "conversations")
    # the answer of a prefix is its last word; right if it has an "a"
    last = lambda k: F.regexp_extract(prefix_text(F.col("text"), F.lit(k)), r"\S+ (\S+)$", 1).contains("a")
    return c.select("conv_id", "turn", *(last(k).alias(f"correct_at_{k}") for k in (4, 8, 16)))


@query(with_tables("select problem_id as item, cluster, coalesce(correct, false) as correct from (select problem_id, cluster, correct from graded) where cluster in (select cluster from graded group by 1 having count(distinct correct) = 2)"))
def mixed_clusters(spark, sf_dir):
    g = graded(spark, sf_dir)
    mixed = g.groupBy("cluster").agg(F.countDistinct("correct").alias("n")).where("n = 2")
    return g.join(mixed, "cluster", "left_semi").select(F.col("problem_id").alias("item"), "cluster", F.coalesce("correct", F.lit(False)).alias("correct"))
