"""Evaluation tasks, adapters, shards and the job queue as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.draws import order_key, sample_seed
from ..functions.text import cell_name, padded, split_name
from .common import BROADCAST_ROWS, ranked_by_digest


def item_index(ids: DataFrame, key: str = "problem_id", order: str | None = None, shard: int | None = None) -> DataFrame:
    """ids numbered from 0 in their order: absolute, or within shards of a size."""
    i = F.row_number().over(Window.orderBy(order or key)) - 1
    return ids.withColumn("item_index", i if shard is None else i % shard)


def tasks(items: DataFrame, samples: int, model_index: int = 0, conditions: list[str] | None = None) -> DataFrame:
    """A row for each item, sample (and condition) with its seed."""
    df = items.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    if conditions:
        df = df.withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))
    return df.withColumn("seed", sample_seed(model_index, F.col("sample_index"), F.col("item_index")))


def plan_counts(adapters: DataFrame, sizes: DataFrame) -> DataFrame:
    """Requests for each (run, step, split): sizes has (split, n_items, samples)."""
    return adapters.crossJoin(F.broadcast(sizes)).groupBy("run", "step", "split").agg(F.sum(F.col("n_items") * F.col("samples")).alias("n_requests"))


def resolve_steps(runs: DataFrame, default: list[int]) -> DataFrame:
    """(run, step): a run's own steps, or else the default ones."""
    steps = F.when(F.size("steps") > 0, F.col("steps")).otherwise(F.array(*map(F.lit, default)))
    return runs.select("run", F.explode(steps).alias("step"))


def missing(wanted: DataFrame, there: DataFrame) -> DataFrame:
    return wanted.join(there, ["run", "step"], "left_anti")


def chunked(adapters: DataFrame, size: int = 14) -> DataFrame:
    """Adapters with a permanent id from 1 in the order (run, step), and the engine that holds at most `size` of them."""
    at = F.row_number().over(Window.orderBy("run", "step"))
    return adapters.withColumn("lora_id", at).withColumn("chunk", F.floor((F.col("lora_id") - 1) / size).cast("int"))


def job_queue(adapters: DataFrame, items: DataFrame, size: int = 16, samples: int = 4, mode: str = "th") -> DataFrame:
    """A job for each adapter and shard of items: name, cell, priority and the requests it should make."""
    shards = item_index(items).groupBy(F.floor(F.col("item_index") / size).cast("int").alias("shard")).agg(F.count("*").alias("n_items"))
    cells = adapters.withColumn("cell", cell_name(F.col("run"), F.col("step"), mode)).withColumn("ordinal", F.dense_rank().over(Window.orderBy("run", "step")) - 1)
    jobs = cells.crossJoin(F.broadcast(shards))
    name = F.concat_ws("_", padded(F.col("ordinal"), 2), F.lit("q"), F.col("cell"), F.concat(F.lit("b"), padded(F.col("shard"))))
    return jobs.select(name.alias("job_id"), "cell", "run", "step", "shard", (F.col("n_items") * samples).alias("est_requests"))


def next_cell(queue: DataFrame) -> DataFrame:
    """The cell of the first pending job by name, with all its pending jobs."""
    pending = queue.where("state = 'pending'")
    first = pending.agg(F.min("job_id").alias("_m")).select(split_name(F.col("_m"), 2).alias("_cell"))
    return pending.join(F.broadcast(first), split_name(F.col("job_id"), 2) == F.col("_cell"), "left_semi").orderBy("job_id")


TRANSITIONS = {("pending", "claim"): "claimed", ("claimed", "finish"): "done", ("claimed", "fail"): "failed", ("claimed", "release"): "pending"}


def apply_events(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """State of each job after its events (job_id, seq, event), in order of seq; an event that does not fit the state changes nothing."""
    step = F.map_from_arrays(F.array(*(F.lit(f"{a}:{b}") for a, b in TRANSITIONS)), F.array(*map(F.lit, TRANSITIONS.values())))
    told = events.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda e: e["event"]).alias("_e"))
    state = F.aggregate(F.coalesce("_e", F.array().cast("array<string>")), F.lit("pending"), lambda s, e: F.coalesce(F.element_at(step, F.concat(s, F.lit(":"), e)), s))
    return jobs.join(told, "job_id", "left").withColumn("state", state).drop("_e")


def accepted(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs with their row counts; rc 90 where these are not the planned requests."""
    n = results.groupBy("job_id").agg(F.count("*").alias("n"))
    return jobs.join(n, "job_id", "left").select("job_id", "est_requests", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) == F.col("est_requests"), 0).otherwise(90).alias("rc"))


def regenerated(planned: DataFrame, found: DataFrame) -> DataFrame:
    """Mismatches of seed or input length between regenerated tasks and rows on disk, by (problem, sample)."""
    keys = ["problem_id", "sample_index"]
    both = found.join(planned.select(*keys, F.col("seed").alias("_seed"), F.col("input_tokens").alias("_tokens")), keys, "left")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("_seed").isNull()).alias("unplanned"), F.count_if(F.col("seed") != F.col("_seed")).alias("other_seed"), F.count_if(F.col("input_tokens") != F.col("_tokens")).alias("other_tokens"))


def remaining(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: what has not been written yet."""
    return planned.join(done.select(*keys), keys, "left_anti")


def half(ids: DataFrame, key: str, i: int, n: int = 2) -> DataFrame:
    """Every n-th id in sorted order, from the i-th on."""
    return item_index(ids, key).where(F.col("item_index") % n == i)


def shard_slice(items: DataFrame, i: int, n: int) -> DataFrame:
    """A slice of numbered items that keeps their absolute numbers."""
    return items.where(F.col("item_index") % n == i)


def train_stream(items: DataFrame, key: str, examples: int, seed: int = 42, offset: int = 0) -> DataFrame:
    """(i, epoch, position, key): the shuffled training items, over and over."""
    by = order_key(seed + offset, F.col(key))
    order = ranked_by_digest(items.select(key), by, F.col(key), name="position").withColumn("position", F.col("position").cast("int"))
    n = max(1, items.count())
    order = F.broadcast(order) if n <= BROADCAST_ROWS else order
    at = items.sparkSession.range(examples).select(F.col("id").alias("i"), F.floor(F.col("id") / n).alias("epoch"), (F.col("id") % n).cast("int").alias("position"))
    return at.join(order, "position").withColumn("sample_seed", F.col("i") + offset * 100_000_000)


def sampling(spark, protocol: Column | None = None) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in K.SAMPLING.items()], "protocol string, temperature double, top_p double, top_k int, repetition_penalty double")


def first_items(items: DataFrame, n: int) -> DataFrame:
    """The first n numbered items, for a trial run."""
    return items.where(F.col("item_index") < n)


def timings(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Jobs, failures and seconds by cell and lane, from a log (job_id, lane, seconds, rc)."""
    both = log.join(jobs.select("job_id", "cell"), "job_id")
    return both.groupBy("cell", "lane").agg(F.count("*").alias("n_jobs"), F.count_if(F.col("rc") != 0).alias("n_failed"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("longest"))


def in_order(ids: DataFrame, rows: DataFrame, key: str = "problem_id") -> DataFrame:
    """rows of the listed ids with their item_index; an id without a row keeps nulls, so that it can be seen."""
    return ids.select(key, "item_index").join(rows, key, "left")


def outcome_rates(records: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of correct, capped, still capped after rescue, and unanswered samples."""
    after = F.when(F.coalesce("rescued", F.lit(False)), F.col("rescued_finish_reason")).otherwise(F.col("finish_reason")) == "length"
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return records.groupBy(*by).agg(F.count("*").alias("n"), rate(F.col("correct")).alias("correct"), rate(F.col("hit_length_cap")).alias("capped"), rate(after).alias("capped_after"), rate(F.col("answer_extracted").isNull()).alias("no_answer"))


def step_means(log: DataFrame) -> DataFrame:
    """Means of a training log by step."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return log.groupBy("step").agg(F.count("*").alias("n"), F.avg("loss").alias("loss"), F.avg("mean_token_kl").alias("mean_token_kl"), F.avg("completion_tokens").alias("completion_tokens"), rate("correct_before_update").alias("correct"), F.avg((F.col("finish_reason") == "length").cast("int")).alias("capped"))
