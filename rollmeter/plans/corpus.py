"""Queries over texts: contamination, layouts, octiles, text functions, controls, linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading, text
from ..operators import contamination, controls, linkage, normalize
from .registry import query, read, rounded

SHINGLES = r"""
with bw as (select item_id, text, regexp_extract_all(translate(lower(text), '$\', ''), '[a-z0-9]+') as w from benchmark),
dw as (select doc_id, regexp_extract_all(translate(lower(text), '$\', ''), '[a-z0-9]+') as w from documents),
bs as (select distinct item_id, array_to_string(w[i:i+7], ' ') as s from (select item_id, w, unnest(generate_series(1, len(w) - 7)) as i from bw where len(w) >= 8)),
ds as (select distinct doc_id, array_to_string(w[i:i+7], ' ') as s from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) as i from dw where len(w) >= 8)),
bn as (select item_id, count(*) as n from bs group by 1), dn as (select doc_id, count(*) as n from ds group by 1),
pairs as (select item_id, doc_id, count(*) as common, min(struct_pack(l := -length(s), s := s)).s as example from bs join ds using (s) group by 1, 2),
scored as (select p.*, common / (bn.n + dn.n - common) as jaccard, common / bn.n as containment from pairs p join bn using (item_id) join dn using (doc_id)),
bx as (select item_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as x from benchmark), dx as (select doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as x from documents),
ex as (select item_id, count(*) as n_exact from bx join dx using (x) where x <> '' group by 1),
best as (select item_id, count(*) as n_candidates, max(jaccard) as bj, max(containment) as bc,
  arg_min(doc_id, struct_pack(a := -jaccard, b := doc_id)) as bjd, arg_min(doc_id, struct_pack(a := -containment, b := doc_id)) as bcd, arg_min(example, struct_pack(a := -containment, b := doc_id)) as e from scored group by 1),
report as (select bw.item_id, replace(substring(text, 1, 120), chr(10), ' ') as question_preview, cast(len(w) as int) as n_tokens, cast(coalesce(bn.n, 0) as int) as n_shingles,
  coalesce(n_candidates, 0) as n_candidates, coalesce(n_exact, 0) as n_exact, round(coalesce(bj, 0), 6) as best_jaccard, bjd as best_jaccard_doc, round(coalesce(bc, 0), 6) as best_containment, bcd as best_containment_doc,
  coalesce(n_exact, 0) > 0 as exact_match, coalesce(n_exact, 0) > 0 or coalesce(bc, 0) >= 0.5 as flagged, e as example_shared
  from bw left join bn using (item_id) left join best using (item_id) left join ex using (item_id))
"""


def _report(spark, sf_dir):
    return rounded(contamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


@query(SHINGLES + "select * from report")
def decontam_full(spark, sf_dir):
    return _report(spark, sf_dir)


@query(SHINGLES + "select count(*) as n_items, count(*) filter (exact_match) as n_exact, count(*) filter (flagged) as n_flagged, max(best_jaccard) as max_jaccard, max(best_containment) as max_containment, 'benchmark' as benchmark from report")
def decontam_summary(spark, sf_dir):
    return contamination.summary(_report(spark, sf_dir))


@query(SHINGLES + "select item_id, best_jaccard, best_jaccard_doc from report order by best_jaccard desc, item_id limit 5")
def decontam_top5(spark, sf_dir):
    return contamination.closest(_report(spark, sf_dir)).select("item_id", "best_jaccard", "best_jaccard_doc")


@query("with x as (select doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as x from documents) select a.doc_id as item_id, count(*) as n_docs, min(b.doc_id) as first_doc from x a join x b using (x) where a.x <> '' group by 1")
def exact_overlap(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    return contamination.exact(docs, items).withColumnsRenamed({"n_exact": "n_docs", "first_exact": "first_doc"})


@query(SHINGLES + "select doc_id, cast(len(w) as int) as n_tokens, cast(coalesce(n, 0) as int) as n_shingles from dw left join dn using (doc_id)")
def shingle_stats(spark, sf_dir):
    return contamination._sets(read(spark, sf_dir, "documents"), "doc_id", "text", 8).select("doc_id", "n_tokens", F.size("set").alias("n_shingles"))


def _wide(spark, sf_dir, trace):
    b, lit = read(spark, sf_dir, "documents"), F.lit(None).cast("string")
    return b.select(
        F.col("doc_id").alias("problem_id"), F.col("lang").alias("question"), F.col("source").alias("answer"), F.col("n_chars").cast("double").alias("difficulty"),
        lit.alias("supervision_answer_only"), F.when(F.col("doc_id") % 2 == 0, "").alias("supervision_key_points"), trace.alias("supervision_full_trace"),
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("supervision_gist"), lit.alias("supervision_summary"), lit.alias("supervision_clean_solution"),
    )


@query(r"""with v as (select doc_id as problem_id, lang as question, source as answer, cast(n_chars as double) as difficulty, unnest(['key_points', 'full_trace', 'gist']) as condition,
  unnest([case when doc_id % 2 = 0 then '' end, text, case when doc_id % 3 = 0 then lang end]) as output from documents)
select *, question as prompt, output || chr(10) || chr(10) || 'The final answer is \boxed{' || answer || '}.' as target from v where output is not null""")
def normalize_unpivot(spark, sf_dir):
    return normalize.rows(_wide(spark, sf_dir, F.col("text")))


@query(r"""select doc_id as problem_id, condition, prompt, question, answer, output, case when coalesce(target, '') = '' then case when condition = 'answer_only' then '' else output || chr(10) || chr(10) end || 'The final answer is \boxed{' || answer || '}.' else target end as target, difficulty
from (select doc_id, case when doc_id % 2 = 0 then 'answer_only' else 'gist' end as condition, lang as prompt, lang as question, source as answer, text as output, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then '' else 'given' end as target, cast(n_chars as double) as difficulty from documents)""")
def long_layout(spark, sf_dir):
    return _long(spark, sf_dir, F.col("text"))


def _long(spark, sf_dir, output):
    third = F.col("doc_id") % 3
    raw = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("problem_id"), F.when(F.col("doc_id") % 2 == 0, "answer_only").otherwise("gist").alias("condition"), F.col("lang").alias("question"), F.col("source").alias("answer"),
        output.alias("output"), F.when(third == 1, "").when(third == 2, "given").alias("target"), F.col("n_chars").cast("double").alias("difficulty"),
    )
    return normalize.rows(raw).select(*normalize.LONG)


@query("select source, lang, min_by(doc_id, doc_id) as first_id, max_by(doc_id, doc_id) as last_id from documents group by 1, 2")
def dedup_first_last(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    keys = ["source", "lang"]
    first = normalize.first_wins(docs, keys, "doc_id").withColumnRenamed("doc_id", "first_id")
    return first.join(normalize.last_wins(docs, keys, "doc_id").withColumnRenamed("doc_id", "last_id"), keys)


@query("""with r as (select conv_id as problem_id, turn, case turn % 3 when 0 then 'answer_only' when 1 then 'key_points' else 'full_trace' end as condition, role, case when turn < 1 then null else cast(length(text) as double) end as difficulty from conversations),
d as (select problem_id, arg_min(difficulty, turn) as difficulty from r where difficulty is not null group by 1)
select problem_id, d.difficulty, count(distinct condition) as n_views, arg_max(role, turn) filter (condition = 'answer_only') as question from r join d using (problem_id) group by 1, 2 having count(distinct condition) = 3""")
def problem_assembly(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    third = F.col("turn") % 3
    long = c.select(F.col("conv_id").alias("problem_id"), F.col("turn").alias("line"), F.when(third == 0, "answer_only").when(third == 1, "key_points").otherwise("full_trace").alias("condition"), F.col("role").alias("prompt"), F.col("role").alias("question"), F.lit("a").alias("answer"), F.col("text").alias("target"), F.when(F.col("turn") >= 1, F.length("text").cast("double")).alias("difficulty"))
    return normalize.problems(long, "line").select("problem_id", "difficulty", F.size("pi").cast("bigint").alias("n_views"), "question")


@query("select o_orderkey, cast((row_number() over (order by o_totalprice, o_orderkey) - 1) * 8 // (select count(*) from orders) as int) as octile from orders")
def octiles(spark, sf_dir):
    return normalize.octiles(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice").select("o_orderkey", "octile")


@query("""with o as (select o_orderkey, cast((row_number() over (order by o_totalprice, o_orderkey) - 1) * 8 // (select count(*) from orders) as int) as octile from orders)
select * from (select o_orderkey, octile, cast(row_number() over (partition by octile order by md5('42:' || o_orderkey), o_orderkey) as int) as pick from o) where pick <= 64""")
def calibration_sample(spark, sf_dir):
    items = normalize.octiles(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice")
    return normalize.calibration(items, "o_orderkey").select("o_orderkey", "octile", "pick")


@query(r"""select doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) as exact, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) as question, md5(regexp_replace(text, '\s+', '', 'g')) as bare,
  cast(len(regexp_extract_all(text, '\S+')) as int) as n_words, replace(substring(text, 1, 120), chr(10), ' ') as preview, lpad(cast(doc_id as varchar), 5, '0') as padded, split_part('a_b_' || source || '_d', '_', 3) as part,
  'Problem: ' || lang || chr(10) || chr(10) || 'Please reason step by step, and put your final answer within \boxed{}.' as prompt, replace(source || '_x', '_', '-') || '-step' || doc_id || '-th' as cell, printf('%+.2f', n_chars / 7e0) as shown from documents""")
def text_functions(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.normalize_exact(t)).alias("exact"), F.md5(text.normalize_question(t)).alias("question"), F.md5(text.strip_space(t)).alias("bare"), text.word_count(t).alias("n_words"), text.preview(t).alias("preview"),
        F.lpad(F.col("doc_id").cast("string"), 5, "0").alias("padded"), text.split_name(F.concat(F.lit("a_b_"), "source", F.lit("_d")), 2).alias("part"), text.student_prompt(F.col("lang"), official=True).alias("prompt"),
        text.cell_name(F.concat("source", F.lit("_x")), F.col("doc_id"), "th").alias("cell"), text.signed(F.col("n_chars") / 7).alias("shown"),
    )


@query(" union all ".join(f"select '{c}' as kind, doc_id, md5({e}) as digest from documents" for c, e in (
    ("student", r"'Solve the following math problem. Reason step by step, and put the final answer in \boxed{}.' || chr(10) || chr(10) || 'Problem:' || chr(10) || lang"),
    ("evaluator", r"lang || chr(10) || chr(10) || 'Please reason step by step, and put your final answer within \boxed{}.'"),
    ("teacher", r"'Solve the following math problem. Reason step by step, and put the final answer in \boxed{}.' || chr(10) || chr(10) || 'Problem:' || chr(10) || lang || chr(10) || chr(10) || 'Privileged reference available only to the teacher:' || chr(10) || '<reference>' || chr(10) || source || chr(10) || '</reference>' || chr(10) || chr(10) || 'Use the reference to help solve or evaluate the problem, but do not mention that a reference was provided.'"),
)))
def prompt_texts(spark, sf_dir):
    q, r = F.col("lang"), F.col("source")
    kinds = F.create_map(F.lit("student"), text.student_prompt(q), F.lit("evaluator"), text.evaluator_prompt(q), F.lit("teacher"), text.teacher_prompt(q, r))
    return read(spark, sf_dir, "documents").select(F.explode(kinds).alias("kind", "value"), "doc_id").select("kind", "doc_id", F.md5("value").alias("digest"))


@query(r"select doc_id, cast(len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x in ('the', 'de', 'in'))) as int) as n from documents")
def marker_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.marker_count(F.col("text"), ("the", "de", "in")).alias("n"))


@query("select doc_id, regexp_matches(lower(replace(replace(text, 'Ġ', ' '), '▁', ' ')), 'wait|but|however|maybe|actually|recheck|check|verify|reconsider|mistake|instead') as has_marker from documents")
def marker_flags(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.has_marker(F.col("text")).alias("has_marker"))


@query(r"""select item_id, case item_id % 4 when 0 then cast(item_id as varchar) when 1 then 'x{' || item_id || '}' when 2 then null else null end as boxed from benchmark""")
def boxed_answers(spark, sf_dir):
    i = F.col("item_id").cast("string")
    k = F.col("item_id") % 4
    made = F.when(k == 0, F.concat(F.lit("so \\boxed{1} or \\boxed{ "), i, F.lit(" }."))).when(k == 1, F.concat(F.lit("\\boxed{x{"), i, F.lit("}} end}"))).when(k == 2, F.concat(F.lit("\\boxed{"), i)).otherwise(F.concat(F.lit("\\boxed {"), i, F.lit("}")))
    return read(spark, sf_dir, "benchmark").select("item_id", text.extract_boxed(made).alias("boxed"))


@query()
def grade_answers(spark, sf_dir):
    i = F.col("item_id")
    gold = F.concat(F.lit("\\frac{"), i.cast("string"), F.lit("}{2}"))
    given = F.when(i % 3 == 0, F.concat(F.lit("$"), (i / 2).cast("string"), F.lit("$"))).when(i % 3 == 1, F.concat(i.cast("string"), F.lit(" / 2")))
    return read(spark, sf_dir, "benchmark").select("item_id", grading.same_answer(given, gold).alias("correct"))


@query("""with o as (select doc_id, n_chars, lag(doc_id) over w as p, lag(n_chars) over w as pl, lead(doc_id) over w as n, lead(n_chars) over w as nl from documents window w as (order by n_chars, doc_id))
select doc_id, case when p is not null and (n is null or n_chars - pl <= nl - n_chars) then p else n end as paired_from, n_chars as own_len, case when p is not null and (n is null or n_chars - pl <= nl - n_chars) then pl else nl end as paired_len,
  abs(n_chars - case when p is not null and (n is null or n_chars - pl <= nl - n_chars) then pl else nl end) as abs_len_diff from o""")
def length_matched_pairs(spark, sf_dir):
    return controls.nearest_length(read(spark, sf_dir, "documents"), "doc_id", "n_chars")


@query("""with o as (select doc_id, lang, row_number() over (order by n_chars, doc_id) - 1 as r from documents),
u as (select a.doc_id, max(b.r) as r from o a join o b on b.r < a.r and b.lang <> a.lang group by 1), d as (select a.doc_id, min(b.r) as r from o a join o b on b.r > a.r and b.lang <> a.lang group by 1),
c as (select o.doc_id, o.lang, o.r, case when u.r is null then d.r when d.r is null or o.r - u.r <= d.r - o.r then u.r else d.r end as t from o left join u using (doc_id) left join d using (doc_id))
select c.doc_id, c.lang as own_answer, x.doc_id as paired_from, x.lang as paired_answer, abs(c.t - c.r) as walk_steps from c left join o x on x.r = c.t""")
def wrong_answer_walk(spark, sf_dir):
    return controls.wrong_answer(read(spark, sf_dir, "documents"), "doc_id", "n_chars", "lang")


@query(r"""with w as (select doc_id, regexp_extract_all(text, '\S+') as w, 50 as t from documents)
select doc_id, cast(len(w) as int) as full_len, t as target_len, case when len(w) > t then t end as truncated_to, len(w) <= t as excluded, case when len(w) > t then md5(array_to_string(w[1:t], ' ')) end as digest from w""")
def truncated_control(spark, sf_dir):
    return controls.truncated(read(spark, sf_dir, "documents"), "doc_id", "text", F.lit(50)).withColumn("digest", F.md5("text")).drop("text")


@query("""select problem_id, budget, common from (select doc_id as problem_id, least(16384, 32768 - n_chars - 256) as budget, case when least(n_chars * 3, 32768 - greatest(n_chars, 2 * n_chars) - 256) >= 512 then least(n_chars * 3, 32768 - greatest(n_chars, 2 * n_chars) - 256) end as common, n_chars from documents) where n_chars <= 32768 - 16384 - 256""")
def context_budget(spark, sf_dir):
    docs = normalize.within_context(read(spark, sf_dir, "documents"), ["n_chars"], 16384)
    n = F.col("n_chars")
    return docs.select(F.col("doc_id").alias("problem_id"), normalize.request_budget(n, 16384).alias("budget"), normalize.common_length(n * 3, [n, n * 2]).alias("common"))


@query("""with c as (select least(n_chars * 3, 32768 - n_chars - 256) as a, least(n_chars * 3, 32768 - 2 * n_chars - 256) as b from documents)
select count(*) as n, round(avg(a - b), 6) as mean_shrink, round(quantile_cont(cast(a - b as double), 0.5), 6) as median_shrink, max(a - b) as max_shrink, count(*) filter (a <> b) as n_shrunk from c""")
def budget_shrink(spark, sf_dir):
    n = F.col("n_chars")
    a, b = F.least(n * 3, 32768 - n - 256), F.least(n * 3, 32768 - 2 * n - 256)
    d = read(spark, sf_dir, "documents").select((a - b).alias("d"))
    return rounded(d.agg(F.count("*").alias("n"), F.avg("d").alias("mean_shrink"), F.percentile("d", 0.5).alias("median_shrink"), F.max("d").alias("max_shrink"), F.count_if(F.col("d") != 0).alias("n_shrunk")))


@query("select 'a-' || item_id as problem_id, text as question, cast(item_id as varchar) as verified_answer from benchmark union all select 'b-' || item_id, text, cast(item_id * 2 as varchar) from benchmark")
def benchmark_sources(spark, sf_dir):
    from ..sources import benchmark

    b = read(spark, sf_dir, "benchmark")
    return benchmark({"a": (b.withColumn("key", F.col("item_id")), {"id": "item_id", "question": "text", "answer": "key"}), "b": (b.withColumn("key", F.col("item_id") * 2), {"id": "item_id", "question": "text", "answer": "key"})})


@query()
def fuzzy_id_map(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    changed = F.when(F.col("item_id") % 5 == 0, F.concat(F.col("text"), F.lit(" and a few more words"))).otherwise(F.replace("text", F.lit(" "), F.lit("  ")))
    problems = b.select(F.col("item_id").alias("problem_id"), F.col("text").alias("question"), F.lpad(F.col("item_id").cast("string"), 3, "0").alias("answer"))
    anchors = b.select((F.col("item_id") + 1000).alias("anchor_id"), changed.alias("problem"), F.col("item_id").cast("string").alias("ground_truth"))
    return linkage.link(problems, anchors)


@query("select count(*) as n_a, count(*) filter (b) as n_b, count(*) as n_union, count(*) filter (b) as n_both, count(*) - count(*) filter (b) as only_a, cast(0 as bigint) as only_b, count(*) = count(*) filter (b) as a_in_b, count(*) = count(*) filter (b) as equal, count(*) filter (b) = 0 as disjoint from (select doc_id, doc_id in (select doc_id from labels) as b from documents)")
def id_set_checks(spark, sf_dir):
    from ..operators.splits import set_checks

    return set_checks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")
