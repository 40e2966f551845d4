"""The engine's input tables from the benchmark tables at hand, as SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import read

PROFILE = """
select problem_id, sample_index, condition, correct, position, position / greatest(n - 1, 1) as normalized_position,
       case when k < 70 then 'think' else 'answer' end as token_category,
       case when position < n * 0.25e0 then 'first25' when position >= n * 0.75e0 then 'last25' else 'mid50' end as region,
       logp, case when condition = 'none' then logp else logp_student end as logp_student,
       case when condition = 'none' then 0e0 else logp - logp_student end as log_ratio,
       entropy, case when condition = 'none' then entropy else entropy_student end as entropy_student,
       condition = 'none' or k % 3 <> 0 as top1_agree_with_student, k % 11 = 0 as is_correction_marker,
       (k % 13) / 13e0 as eos_prob, (k % 17) / 17e0 as eos_prob_student, (k % 19) / 19e0 as think_close_prob, (k % 7) / 7e0 as think_close_prob_student,
       (k % 5) / 5.3e0 as answer_transition_prob, (k % 3) / 3e0 as answer_transition_prob_student,
       case when condition = 'none' then 0e0 else value / 97e0 end as full_kl,
       case when condition = 'none' then 0e0 else least(value / 97e0, 0.05e0) end as clipped_kl,
       length(condition) * 10e0 as pi_length_tokens
from (
  select cast(floor(user_id / 4) as bigint) as problem_id, user_id % 4 as sample_index, user_id % 3 <> 0 as correct, value,
         case when event_type = 'view' then 'none' else event_type end as condition,
         cast(row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as bigint) as position,
         count(*) over (partition by user_id, event_type) as n, k,
         -(k % 50) / 7e0 - 0.01e0 as logp, -(k % 37) / 7e0 - 0.01e0 as logp_student, (k % 23) / 7e0 as entropy, (k % 29) / 7e0 as entropy_student
  from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from {events}) e
) t
"""

RECORD = """
select conv_id as problem_id, turn as sample_index, role as condition, text as output, length(text) as generated_tokens, length(text) > 400 as hit_length_cap,
       case when length(text) > 400 then 'length' else 'stop' end as finish_reason, case when conv_id % 5 = 0 then null else turn % 2 = 0 end as correct,
       length(text) > 400 and conv_id % 2 = 0 as rescued, case when conv_id % 3 = 0 then null else conv_id % 3 = 1 end as rescued_correct,
       case when length(text) > 900 then 'length' else 'stop' end as rescued_finish_reason, conv_id % 4 <> 0 as has_rescued_output,
       case when conv_id % 7 = 0 then null else cast(conv_id as varchar(20)) end as answer_extracted, (conv_id * 13) % 30000 as input_tokens, 400 as max_new_tokens
from {conversations}
"""

GRADED = """
select d.doc_id as problem_id, d.source as cluster, d.lang as view, d.n_chars as score, l.quality = 1 as correct, l.toxic = 1 as toxic, cast(l.quality as double) as value
from {documents} d join {labels} l on d.doc_id = l.doc_id
"""


def _sql(spark: SparkSession, text: str, sf_dir: str, *tables: str) -> DataFrame:
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in tables})


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, PROFILE, sf_dir, "events")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, RECORD, sf_dir, "conversations")


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, GRADED, sf_dir, "documents", "labels")


def with_tables(sql: str) -> str:
    """An oracle over the named inputs."""
    parts = {"profile": PROFILE.replace("{events}", "events"), "records": RECORD.replace("{conversations}", "conversations"), "graded": GRADED.replace("{documents}", "documents").replace("{labels}", "labels")}
    used = [f"{k} as ({v})" for k, v in parts.items() if k in sql]
    sql = sql.strip()
    return "with " + ", ".join(used) + (", " + sql[5:] if sql.lower().startswith("with ") else " " + sql)
