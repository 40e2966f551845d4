"""Queries over single rules: boundaries, shares, filters, lookups, and the round trip through each format."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..functions import grading, tensor
from ..operators import checks, contamination, normalize, planning, profile as ops
from ..sources import scratch, sinks
from .inputs import graded, profile, records, with_tables
from .profiles import LOGITS
from .records import QUEUE, _jobs
from .registry import query, read, rounded

_IDS = "t as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(abs(x) * 50) as int)) as ids from embeddings)"


def _ids(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(F.abs(x) * 50).cast("int")).alias("ids"))


@query(f"""with {_IDS}, k as (select vec_id, ids, coalesce(list_min(list_filter([list_position(ids, 3), list_position(ids, 7)], lambda x: x > 0)), len(ids) + 1) as k from t)
select vec_id, k - 1 as n_think, len(ids) - k + 1 as n_answer, case when k > 1 then 'think' else 'answer' end as first_label from k""")
def token_categories(spark, sf_dir):
    d = _ids(spark, sf_dir).select("vec_id", tensor.categories(F.col("ids"), (3, 7)).alias("c"))
    n = lambda x: F.size(F.filter("c", lambda y: y == x)).cast("bigint")
    return d.select("vec_id", n("think").alias("n_think"), n("answer").alias("n_answer"), F.col("c")[0].alias("first_label"))


@query("""with c as (select doc_id, n_chars as n, cast(floor(n_chars * 0.8e0) as int) as r from documents), w as (select doc_id, n, r, greatest(cast(round_even(f * r, 0) as int) - 16, 0) as lo, least(cast(round_even(f * r, 0) as int) + 16, n) as hi from c, (select unnest([0.25e0, 0.5e0, 1e0]) as f)),
p as (select distinct doc_id, n, r, unnest(generate_series(lo, hi - 1)) as p from w where lo < hi) select doc_id, count(*) as n_support, round(count(*) / any_value(n)::double, 6) as coverage, max(p) >= any_value(r) as reaches_answer from p group by 1""")
def support_coverage(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("int").alias("n")).withColumn("r", F.floor(F.col("n") * 0.8).cast("int"))
    places = F.array_sort(F.filter(F.array_distinct(F.flatten(F.array(*(_window(f) for f in (0.25, 0.5, 1.0))))), lambda x: x.isNotNull()))
    d = d.withColumn("p", places).where("size(p) > 0")
    return rounded(d.select("doc_id", F.size("p").cast("bigint").alias("n_support"), tensor.coverage(F.col("p"), F.col("n")).alias("coverage"), tensor.reaches_answer(F.col("p"), F.col("r")).alias("reaches_answer")))


def _window(fraction: float):
    """The support around a share of the reasoning, cut to the whole completion."""
    center = F.bround(F.lit(fraction) * F.col("r"), 0).cast("int")
    lo, hi = F.greatest(center - 16, F.lit(0)), F.least(center + 16, F.col("n"))
    return F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))


@query("select item_id as problem_id, cast(row_number() over (order by item_id) - 1 as int) as item_index from benchmark qualify item_index < 10")
def first_items(spark, sf_dir):
    return planning.first_items(planning.item_index(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("problem_id"))), 10)


@query(with_tables("select view, round(avg(score), 6) as mean_reference_length, round(avg(cast(correct as int)), 6) as teacher_accuracy, count(*) as n from graded group by 1"))
def reference_by_view(spark, sf_dir):
    return rounded(graded(spark, sf_dir).groupBy("view").agg(F.avg("score").alias("mean_reference_length"), F.avg(F.col("correct").cast("int")).alias("teacher_accuracy"), F.count("*").alias("n")))


@query(with_tables("select region, count(*) as n, round(sum(normalized_position), 4) as positions, round(sum(log_ratio), 4) as log_ratios from profile group by 1"))
def regions_of_positions(spark, sf_dir):
    """Regions, normalized positions and log ratios by the engine's own rules."""
    p = profile(spark, sf_dir).withColumn("n", F.max("position").over(_trajectory()) + 1)
    p = p.select(ops.region(F.col("position"), F.col("n")).alias("region"), ops.normalized(F.col("position"), F.col("n")).alias("x"), F.when(F.col("condition") == "none", 0.0).otherwise(F.col("logp") - F.col("logp_student")).alias("r"))
    return p.groupBy("region").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("positions"), F.round(F.sum("r"), 4).alias("log_ratios"))


def _trajectory():
    from pyspark.sql import Window

    return Window.partitionBy("problem_id", "sample_index", "condition")


@query("with " + LOGITS.replace("from embeddings", "from (select vec_id, label, list_transform(embedding, lambda x: cast(x as double) / 2) as embedding from embeddings)") + " select vec_id, round(-list_sum(list_transform(lp, lambda x: exp(x) * x)), 6) as entropy from l")
def scaled_softmax(spark, sf_dir):
    lp = tensor.log_softmax(F.col("embedding"), 2.0)
    return rounded(read(spark, sf_dir, "embeddings").select("vec_id", tensor.entropy(lp).alias("entropy")))


@query(f"with {_IDS} select vec_id, len(ids[1:16]) as n, cast(list_sum(ids[1:16]) as bigint) as total from t")
def horizon_slices(spark, sf_dir):
    h = tensor.loss_horizon(F.col("ids"), 16)
    return _ids(spark, sf_dir).select("vec_id", F.size(h).cast("bigint").alias("n"), F.aggregate(h, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("select c_nationkey, count(*) as n from customer group by 1 having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return contamination.duplicate_ids(read(spark, sf_dir, "customer"), "c_nationkey")


@query("with i as (select c_custkey, cast(row_number() over (order by c_custkey) - 1 as int) as item_index from customer) select c_custkey, item_index from i where item_index % 2 = 1 and item_index % 3 = 0")
def id_shards(spark, sf_dir):
    return planning.shard_slice(planning.half(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 1), 0, 3)


@query("select doc_id, source, lang from documents where lang in ('en', 'de') and starts_with(source, 'src1')")
def value_and_prefix_filters(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source", "lang").where(F.col("lang").isin("en", "de") & F.col("source").startswith("src1"))


@query(f"with {_IDS}, c as (select vec_id, case when label % 3 = 0 then ids[1:2] when label % 3 = 1 then [] end as a, case when label % 2 = 0 then ids[1:5] end as b, ids from t) select vec_id, cast(len(case when len(a) > 0 then a when len(b) > 0 then b else ids end) as int) as n from c")
def completion_choice(spark, sf_dir):
    third = F.col("label") % 3
    rescued = F.when(third == 0, F.slice("ids", 1, 2)).when(third == 1, F.array().cast("array<int>"))
    main = F.when(F.col("label") % 2 == 0, F.slice("ids", 1, 5))
    return _ids(spark, sf_dir).select("vec_id", F.size(grading.truthy_first(rescued, main, F.col("ids"))).alias("n"))


_SIX = "select conv_id % 40 as problem_id, role as condition, turn % 2 as sample_index, conv_id * 100 + turn as line from conversations"


@query(f"select problem_id, condition, line from (select *, row_number() over (partition by problem_id order by line) as i from ({_SIX}) where condition not in ('assistant') and sample_index = 0) where i = 1")
def first_unprivileged(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id") % 40).alias("problem_id"), F.col("role").alias("condition"), (F.col("turn") % 2).alias("sample_index"), (F.col("conv_id") * 100 + F.col("turn")).alias("line"))
    return sources.first_unprivileged(c, "line", ("assistant",)).select("problem_id", "condition", "line")


@query("select o_custkey as k, count(*) as _a, count(*) + (o_custkey % 5 = 0)::int as _b from orders group by 1 having o_custkey % 5 = 0")
def cross_check(spark, sf_dir):
    a = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return checks.close(a, a.withColumn("n", F.col("n") + (F.col("k") % 5 == 0).cast("int")), ["k"], "n", 0.5)


@query("with i as (select item_id, cast(row_number() over (order by item_id desc) - 1 as int) as item_index from benchmark) select item_id as problem_id, item_index, length(text) as n_chars from i left join (select * from benchmark where item_id % 4 <> 0) b using (item_id)")
def ordered_lookup(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "problem_id")
    ids = planning.item_index(b.select("problem_id", (-F.col("problem_id")).alias("_o")), "problem_id", "_o")
    return planning.in_order(ids, b.where("problem_id % 4 <> 0").select("problem_id", F.length("text").alias("n_chars")))


@query("""select n_nationkey as problem_id, c as condition, case when c = 'gist' then case when n_nationkey % 2 = 0 then upper(n_name) end when c = 'key_points' then n_name end as target from nation, (select unnest(['gist', 'key_points', 'full_trace']) as c)""")
def view_texts(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "problem_id")
    wanted = n.select("problem_id", F.explode(F.array(*map(F.lit, ("gist", "key_points", "full_trace")))).alias("condition"))
    problems = n.select("problem_id", F.create_map(F.lit("key_points"), F.col("n_name")).alias("texts"))
    return normalize.view_texts(wanted, problems, n.where("problem_id % 2 = 0").select("problem_id", F.lit("gist").alias("condition"), F.upper("n_name").alias("target")))


@query("select n_nationkey as problem_id, c as condition from nation, (select unnest(['gist', 'summary']) as c) where c = 'gist' and n_regionkey = 1 or c = 'summary' and n_regionkey > 2")
def incomplete_views(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("problem_id"), "n_regionkey")
    there = n.where("n_regionkey <> 1").select("problem_id", F.lit("gist").alias("condition")).union(n.where("n_regionkey <= 2").select("problem_id", F.lit("summary")))
    return normalize.incomplete_views(there, n, ("gist", "summary"))


@query("""with e as (select user_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k, value from events) select event_type, count(*) as n, sum(k)::bigint as total, round(avg(value), 4) as mean4 from e group by 1""")
def json_properties(spark, sf_dir):
    """Properties parsed as JSON; means at the four decimals of the reports."""
    e = read(spark, sf_dir, "events")
    k = F.element_at(F.map_values(F.from_json("props", "map<string,string>")), 1).cast("int")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.round(F.avg("value"), 4).alias("mean4"))


_OCT = "o as (select distinct problem_id, cast((dense_rank() over (order by problem_id) - 1) * 8 // (select count(distinct problem_id) from profile) as int) as octile from profile)"


@query(with_tables(f"with {_OCT}, d as (select problem_id, avg(log_ratio) filter (correct) - avg(log_ratio) filter (not correct) as d from profile where condition <> 'none' group by 1) select octile, count(d) as n_problems, round(avg(d), 6) as mean_difference from d join o using (problem_id) where d is not null group by 1"))
def octile_alignment(spark, sf_dir):
    p = profile(spark, sf_dir)
    octile = normalize.octiles(p.select("problem_id").distinct().withColumn("by", F.col("problem_id")), "problem_id", "by").select("problem_id", "octile")
    d = ops.contrast(p.where("condition <> 'none'"), "log_ratio").join(octile, "problem_id")
    return rounded(ops.alignment(d, "octile"))


@query(QUEUE + ", l as (select job_id, cell, case when shard % 2 = 0 then 'a' else 'b' end as lane, est_requests * 0.5e0 as seconds, case when shard % 5 = 0 then 90 else 0 end as rc from jobs) select cell, lane, count(*) as n_jobs, count(*) filter (rc <> 0) as n_failed, round(sum(seconds), 6) as seconds, round(max(seconds), 6) as longest from l group by 1, 2")
def job_timings(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    even = F.col("shard") % 2 == 0
    log = jobs.select("job_id", F.when(even, "a").otherwise("b").alias("lane"), (F.col("est_requests") * 0.5).alias("seconds"), F.when(F.col("shard") % 5 == 0, 90).otherwise(0).alias("rc"))
    return rounded(planning.timings(jobs, log))


_SEEN = "select problem_id, sample_index, condition, generated_tokens from records"


def _log(spark, sf_dir):
    return records(spark, sf_dir).select("problem_id", "sample_index", "condition", F.col("generated_tokens").cast("int").alias("generated_tokens"))


@query(with_tables(_SEEN))
def jsonl_round_trip(spark, sf_dir):
    """A log written in two appended parts and read back."""
    at, rows = scratch.folder(spark), _log(spark, sf_dir)
    sinks.jsonl(rows.where("sample_index < 2"), at)
    sinks.jsonl(rows.where("sample_index >= 2"), at, append=True)
    return sources.jsonl(spark, at, schema=rows.schema)


@query(with_tables(_SEEN))
def csv_round_trip(spark, sf_dir):
    at, rows = scratch.folder(spark), _log(spark, sf_dir)
    sinks.csv(rows, at)
    return sources.csv(spark, at, rows.schema)


@query(with_tables("select problem_id, condition, case when sample_index < 2 then generated_tokens end as generated_tokens from records"))
def parquet_shards(spark, sf_dir):
    """Two shards, the later without a column, read as one table and cut to three columns."""
    at, rows = scratch.folder(spark), _log(spark, sf_dir)
    sinks.parquet(rows.where("sample_index < 2"), f"{at}/a", rows_per_file=500)
    sinks.parquet(rows.where("sample_index >= 2").drop("generated_tokens"), f"{at}/b")
    return sources.parquet(spark, f"{at}/a", f"{at}/b", columns=["problem_id", "condition", "generated_tokens"])


@query("select 'run' || n_regionkey as run, n_nationkey % 2 as step, 'dev' as split, count(*) as n from nation group by all")
def cell_folders(spark, sf_dir):
    """A folder for each run, step and split, read back with its names."""
    at, n = scratch.folder(spark), read(spark, sf_dir, "nation")
    sinks.per_cell(n.select(F.concat(F.lit("run"), "n_regionkey").alias("run"), (F.col("n_nationkey") % 2).cast("int").alias("step"), F.lit("dev").alias("split"), "n_name"), at)
    return spark.read.schema("n_name string, run string, step int, split string").json(at).groupBy("run", "step", "split").agg(F.count("*").alias("n"))


@query("select case when r_regionkey % 2 = 0 then 'even' else 'odd' end as split, cast(row_number() over (partition by r_regionkey % 2 order by r_regionkey) - 1 as int) as item_index, r_name as problem_id from region")
def split_document(spark, sf_dir):
    """A JSON document of two id lists, put in place in one step and read as rows."""
    at = scratch.folder(spark) + ".json"
    rows = read(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # five regions
    sinks.document(spark, {"even": [r.r_name for r in rows if r.r_regionkey % 2 == 0], "odd": [r.r_name for r in rows if r.r_regionkey % 2]}, at)
    return sources.listed(sources.document(spark, at, "even array<string>, odd array<string>"), "even", "odd")
