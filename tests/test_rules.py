"""Rules on rows made by hand."""

import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from rollmeter import schemas, sources, streaming
from rollmeter.functions import grading, student_t, tensor, text
from rollmeter.operators import checks, controls, linkage, normalize, planning, profile, resample, splits
from rollmeter.operators.common import numbered_values, ranked
from rollmeter.sources import sinks


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(spark, values, f, kind="string"):
    return [r.y for r in col(spark, values, kind).select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_boxed(spark):
    cases = {
        r"a \boxed{1} b \boxed{ \frac{1}{2} } c": r"\frac{1}{2}", r"\boxed{x": None, r"\boxed {1}": None, "none": None, r"\boxed{}": "", None: None,
        r"\boxed{a{b}c}}": "a{b}c", "x\n\\boxed{1\n}": "1",
    }
    assert apply(spark, list(cases), text.extract_boxed) == list(cases.values())


def test_answers(spark):
    rows = [("1/2", r"\frac{1}{2}", True), ("0.5", r"\dfrac{1}{2}", True), ("50\\%", "0.5", True), ("1,000", "1000", True), ("x+1", " X + 1 ", True), ("2", "3", False), (None, "3", False), ("007", "7", True), ("a", "b", False)]
    got = spark.createDataFrame(rows, "p string, g string, want boolean").select("want", grading.same_answer(F.col("p"), F.col("g")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_normalised_texts(spark):
    assert apply(spark, ["$A\\b c!é1$", None], text.normalize_exact) == ["abc1", None]
    assert apply(spark, ["café $x$\\y 12"], text.tokens) == [["caf", "xy", "12"]]
    assert apply(spark, ["a  b\n C "], text.normalize_question) == ["a b c"]
    assert apply(spark, [" 023", "$23$", "x", "+5"], text.normalize_answer) == ["23", "23", "x", "5"]
    assert apply(spark, ["a b c d e f g h i", "a b c d e f g"], lambda c: F.size(text.shingles(text.tokens(c)))) == [2, 0]
    assert apply(spark, ["Wait, but button. BUT"], text.marker_count) == [3]
    assert apply(spark, ["Ġbutton", "cat"], text.has_marker) == [True, False]
    assert apply(spark, [1.25, None], lambda c: text.signed(c, 1), "double") == ["+1.3", "—"]
    assert apply(spark, [0.0001, 0.25, None], text.p_text, "double") == ["<0.001", "0.250", "—"]


def test_five_rescue_rules_differ(spark):
    rows = [(a, b, c, d) for a, b, c, d in itertools.product((True, False, None), repeat=4) if d is not None]
    df = spark.createDataFrame(rows, "rescued boolean, rescued_correct boolean, correct boolean, has_rescued_output boolean")
    r = {c: F.col(c) for c in df.columns}
    got = df.select("*", grading.rescue_estimator(r).alias("e"), grading.rescue_split(r).alias("s"), grading.rescue_value(r).alias("v"), grading.rescue_profile(r).alias("p")).collect()
    for x in got:
        assert x.e == ((x.rescued_correct if x.rescued_correct is not None else x.correct) if x.rescued and x.has_rescued_output else x.correct)
        assert x.s == bool(x.rescued_correct if x.rescued else x.correct)
        assert x.v == (x.rescued_correct if x.rescued_correct is not None else x.correct)
        assert x.p == bool(x.rescued_correct if x.rescued else x.correct)


def test_tensors(spark):
    rows = [([1.0, 2.0, 3.0], [3.0, 2.0, 1.0]), ([0.5, 0.5, 0.1], [0.5, 0.5, 0.1])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>").select("a", "b", tensor.log_softmax(F.col("a")).alias("p"), tensor.log_softmax(F.col("b")).alias("q"))
    got = df.select("a", "b", "p", tensor.forward_kl(F.col("p"), F.col("q")).alias("kl"), tensor.clipped_kl(F.col("p"), F.col("q")).alias("ck"), tensor.entropy(F.col("p")).alias("h"), tensor.argmax(F.col("a")).alias("top")).collect()
    for r in got:
        soft = lambda v: [math.exp(x) / sum(map(math.exp, v)) for x in v]
        p, q = soft(r.a), soft(r.b)
        parts = [x * math.log(x / y) for x, y in zip(p, q)]
        assert r.kl == pytest.approx(sum(parts)) and r.ck == pytest.approx(sum(min(x, 0.05) for x in parts)) and r.ck <= r.kl + 1e-12
        assert r.h == pytest.approx(-sum(x * math.log(x) for x in p)) and 0 <= r.h <= math.log(3)
    assert got[1].kl == pytest.approx(0) and got[1].top == 0 and got[0].top == 2


def test_loss_windows_and_stops(spark):
    assert apply(spark, [10], lambda n: tensor.loss_windows(n, (0.25, 0.5), 4), "int") == [[0, 1, 2, 3, 4, 5, 6]]
    assert [[tuple(w) for w in x] for x in apply(spark, [[0, 1, 4, 5, 9]], tensor.windows_of, "array<int>")] == [[(0, 2), (4, 6), (9, 10)]]
    assert apply(spark, [[5, 9, 7, 9], [5], []], lambda a: tensor.until_stop(a, (9, 7))[0], "array<int>") == [[5, 9], [5], []]
    assert apply(spark, [[5, 9], [5]], lambda a: tensor.until_stop(a, (9,))[1], "array<int>") == ["stop", "length"]
    assert apply(spark, [0.0, 0.25, 1.0], lambda x: tensor.floor_bin(x, 4), "double") == [0, 1, 3]
    assert apply(spark, [0.0, 1.0], lambda p: F.round(tensor.logit(p), 3), "double") == [-16.118, 16.118]


def test_regions_use_the_whole_length(spark):
    got = spark.range(8).select(profile.region(F.col("id"), F.lit(8)).alias("r")).collect()
    assert [r.r for r in got] == ["first25"] * 2 + ["mid50"] * 4 + ["last25"] * 2


def test_student_quantiles():
    table = {(0.975, 1): 12.7062047, (0.975, 3): 3.18244631, (0.975, 10): 2.22813885, (0.95, 30): 1.69726089, (0.975, 200): 1.97189622}
    for (p, df), want in table.items():
        assert student_t.quantile(p, df) == pytest.approx(want, abs=1e-6)


def test_holm_and_auroc_properties(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    got = {r.i: r.p_holm for r in resample.holm(col(spark, p, "double"), "i", "x").collect()}
    assert [round(got[i], 6) for i in range(4)] == [0.03, 0.06, 0.06, 0.02]
    df = spark.createDataFrame([(0.1, False), (0.4, False), (0.35, True), (0.8, True), (0.4, True)], "s double, y boolean")
    a = resample.auroc(df, "s", F.col("y")).first().auroc
    b = resample.auroc(df.withColumn("s", -F.col("s")), "s", F.col("y")).first().auroc
    assert a == pytest.approx(4.5 / 6) and a + b == pytest.approx(1)
    assert resample.auroc(df.where("y"), "s", F.col("y")).first().auroc is None


def test_bootstrap_weights(spark):
    ids = spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, g int")
    w = resample.weights(ids, "id", "g", n_boot=50)
    per = w.join(ids, "id").groupBy("replicate", "g").agg(F.sum("w").alias("n")).collect()
    assert len(per) == 100 and {r.n for r in per} == {5}
    a = ids.select("id", F.col("id").cast("double").alias("v"))
    d = resample.paired_delta(a, a.withColumn("v", F.col("v") - 1), w, "id", "v").first()
    assert d.delta == pytest.approx(100) and d.ci_lo == pytest.approx(100) and d.resolved
    gap = resample.paired_delta(a, a.where("id > 0"), w, "id", "v").first()
    assert gap.delta is None and gap.n_missing == 1
    m = resample.mean_interval(a, w, "id", "v").first()
    assert m.ci_lo <= m.point <= m.ci_hi


def test_octiles_are_not_ntiles(spark):
    got = normalize.octiles(spark.range(10).withColumn("d", F.col("id") % 10), "id", "d").orderBy("id").collect()
    assert [r.octile for r in got] == [i * 8 // 10 for i in range(10)]


def test_problems_need_all_views_and_a_difficulty(spark):
    rows = [(1, c, "q", "a", f"{c}-{k}", 2.0 if k else None, k) for k in (0, 1) for c in ("answer_only", "key_points", "full_trace")] + [(2, "answer_only", "q", "a", "t", 1.0, 9)]
    df = spark.createDataFrame(rows, "problem_id int, condition string, prompt string, answer string, target string, difficulty double, line int").withColumn("question", F.col("prompt"))
    got = normalize.problems(df, "line").collect()
    assert [r.problem_id for r in got] == [1] and got[0].pi["key_points"] == "key_points-1" and got[0].difficulty == 2.0
    assert normalize.incomplete_views(df, df.select("problem_id").distinct()).count() == 6


def test_wide_rows_keep_empty_views(spark):
    row = {"problem_id": "p", "answer": "7", "supervision_gist": "", "supervision_answer_only": "x"}
    got = {r.condition: r.target for r in normalize.rows(spark.createDataFrame([row], schemas.WIDE)).collect()}
    assert got == {"answer_only": r"The final answer is \boxed{7}.", "gist": "\n\nThe final answer is \\boxed{7}."}


def test_splits_of_short_groups(spark):
    items = spark.createDataFrame([(i, "a") for i in range(10)] + [(i, "b") for i in range(100, 104)], "id int, g string")
    got = splits.quota_split(items, "id", "g", {"train": 4, "dev": 2, "test": 2}).groupBy("g", "split").count().collect()
    assert {(r.g, r.split): r["count"] for r in got} == {("a", "train"): 4, ("a", "dev"): 2, ("a", "test"): 2, ("b", "train"): 2, ("b", "dev"): 1, ("b", "test"): 1}
    assert splits.quota_split(items, "id", "g", {"train": 4, "dev": 2, "test": 2}, strict=True).where("g = 'b'").count() == 0


def test_partners(spark):
    items = spark.createDataFrame([(1, 10, "x"), (2, 12, "x"), (3, 14, "y"), (4, 20, "x")], "id int, n int, a string")
    got = {r.id: r.paired_from for r in controls.nearest_length(items, "id", "n").collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: 3}
    walk = controls.wrong_answer(items, "id", "n", "a")
    assert {r.id: (r.paired_from, r.walk_steps) for r in walk.collect()} == {1: (3, 2), 2: (3, 1), 3: (2, 1), 4: (3, 1)}
    assert controls.violations(walk, "id").count() == 0
    same = controls.wrong_answer(items.withColumn("a", F.lit("x")), "id", "n", "a")
    assert controls.violations(same, "id").count() == 4


def test_linkage_and_failures(spark):
    p = spark.createDataFrame([(1, "What is 1 + 1?", "02"), (2, "Find the area of the circle", "9"), (3, "zzz", "1")], "problem_id int, question string, answer string")
    a = spark.createDataFrame([(10, "What is 1+1?", "2"), (20, "Find the area of that circle", "8"), (30, "qqqq", "1")], "anchor_id int, problem string, ground_truth string")
    links = linkage.link(p, a)
    got = {r.problem_id: (r.anchor_id, r.how, r.answers_agree) for r in links.collect()}
    assert got[1] == (10, "exact", True) and got[2] == (20, "closest", False) and got[3][1] == "unclear"
    assert {r.reason for r in linkage.failures(links, p).collect()} >= {"answers differ", "unclear"}


def test_profile_invariants(spark, sf):
    from rollmeter.plans.inputs import profile as table

    df = table(spark, sf)
    groups = profile.per_group(df)
    assert checks.unique(groups, *profile.KEYS).count() == 0
    markers = profile.marker_tokens(df).groupBy(*profile.KEYS).agg(F.avg("log_ratio").alias("marker_log_ratio_mean"))
    assert checks.close(groups, markers, profile.KEYS, "marker_log_ratio_mean").count() == 0
    assert groups.where("n_think_tokens + n_answer_tokens <> n_tokens or n_tokens_q0 + n_tokens_q1 + n_tokens_q2 + n_tokens_q3 <> n_tokens").count() == 0
    assert checks.baseline_rows(df).count() == 0
    old = profile.per_group(df.drop("clipped_kl", "pi_length_tokens"))
    assert "clipped_kl_sum" not in old.columns and old.count() == groups.count()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "xb003_run_a_step50_test.jsonl").write_text('{"problem_id":"p","sample_index":0,"correct":true}\n\n{"problem_id":"q","sample_index":1}\n')
    df = sources.cells(spark, f"{tmp_path}/*.jsonl", schemas.RECORD)
    r = df.select("prefix", "shard", "run", "step", "split").first()
    assert df.count() == 2 and tuple(r) == ("x", 3, "run_a", 50, "test")
    (tmp_path / "s.json").write_text(json.dumps({"train": ["b", "a"], "test": ["c"]}))
    rows = sources.listed(sources.document(spark, f"{tmp_path}/s.json", schemas.SPLITS), "train", "test").collect()
    assert [(x.split, x.item_index, x.problem_id) for x in rows] == [("train", 0, "b"), ("train", 1, "a"), ("test", 0, "c")]
    sinks.per_cell(df.select("run", "step", "split", "problem_id"), f"{tmp_path}/out")
    assert (tmp_path / "out" / "run=run_a" / "step=50" / "split=test").exists()
    sinks.document(spark, {"a": 1}, f"{tmp_path}/d.json")
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": 1}
    sinks.csv(df.select("problem_id"), f"{tmp_path}/c")
    assert sources.csv(spark, f"{tmp_path}/c", df.select("problem_id").schema).count() == 2
    assert sources.if_there(spark, f"{tmp_path}/no", schemas.RECORD) == (None, {"path": f"{tmp_path}/no", "complete": False})
    assert "| problem_id |" in sinks.markdown(df.select("problem_id"), "T")
    sinks.parquet(df, f"{tmp_path}/ds/train")
    assert sources.dataset(spark, f"{tmp_path}/ds", "validation").count() == 2


def test_first_and_latest_records(spark):
    rows = [("p", "none", 0, 3), ("p", "none", 0, 1), ("p", "gist", 0, 0), ("p", "full_trace", 0, -1), ("q", "none", 1, 0)]
    df = spark.createDataFrame(rows, "problem_id string, condition string, sample_index int, line int")
    assert [(r.problem_id, r.line) for r in sources.first_unprivileged(df, "line").collect()] == [("p", 0)]
    assert {(r.condition, r.line) for r in sources.latest(df, ["problem_id", "condition"], "line").collect()} == {("none", 3), ("gist", 0), ("full_trace", -1), ("none", 0)}


def test_trajectory_stream(spark, tmp_path):
    log, seen = tmp_path / "log", {}
    log.mkdir()

    def sink(batch, _):
        seen.update({r.step: (r.n, r.loss) for r in batch.collect()})

    for k in range(2):
        (log / f"{k}.json").write_text("".join(json.dumps({"step": s, "loss": float(s + k), "finish_reason": "stop"}) + "\n" for s in (1, 2)))
        streaming.monitor(streaming.trajectory_log(spark, str(log)), sink, f"{tmp_path}/ck").awaitTermination()
    assert seen == {1: (2, 1.5), 2: (2, 2.5)}


def test_checks_raise(spark):
    checks.demand(checks.row_count(spark.range(3), 3), checks.no_nulls(spark.range(3), "id"))
    with pytest.raises(ValueError):
        checks.demand(checks.row_count(spark.range(3), 4))
    assert checks.same_sets(spark.range(3), spark.range(1, 4)).count() == 2
    assert planning.half(spark.range(5), "id", 1).count() == 2


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_ranks_within_facets_with_a_hot_value_and_nulls(spark, monkeypatch, most):
    monkeypatch.setattr("rollmeter.operators.common.BROADCAST_ROWS", most)
    rows = [(i, None if i % 11 == 0 else "ab"[i % 2], 5 if i % 3 else i // 7, None if i % 13 == 0 else f"{'x' * (i % 9)}{i % 4}é") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v int, s string")
    for value in ("v", "s"):
        got = ranked(numbered_values(df, value, "_x"), F.col("_x"), F.col("id"), name="r", within=("g",))
        want = df.selectExpr("id", f"row_number() over (partition by g order by {value}, id) - 1 as r")
        assert sorted((r.id, r.r) for r in got.collect()) == sorted(map(tuple, want.collect()))
        mean = df.selectExpr("id", f"rank() over (partition by g order by {value}) + (count(*) over (partition by g, {value}) - 1) / 2 as r")
        assert sorted((r.id, r.avg_rank) for r in resample.average_rank(df, value, "g").collect()) == sorted(map(tuple, mean.collect()))
    assert ranked(df.limit(0), F.col("v"), F.col("id"), within=("g",)).count() == 0


def test_out_of_fold_equals_a_plain_fit(spark):
    import numpy as np

    rows = [(g, i // 3, None if i == 50 else (i * 37 % 101) / 9 * (1 if g else 1000), float((i * 37 % 101) + (i * 53 % 40) > 70)) for g in (0, 1, None) for i in range(120)] + [(2, 0, 1.0, 1.0), (2, 0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, c int, x double, y double")
    got = [(r.g, r.fold, r.x, r.y, r.predicted) for r in resample.out_of_fold(df, "x", "y", "c", "g", folds=4).collect()]
    assert len(got) == len(rows) - 3
    for g in {r[0] for r in got}:
        own = [r for r in got if r[0] == g]
        for k in {r[1] for r in own}:
            x, y = (np.array([r[i] for r in own if r[1] != k]) for i in (2, 3))
            if not len(x):
                assert all(r[4] is None for r in own)
                continue
            z, beta = np.c_[np.ones(len(x)), (x - x.mean()) / x.std()], np.zeros(2)
            for _ in range(40):
                p = 1 / (1 + np.exp(-z @ beta))
                beta = beta + np.linalg.inv(z.T * (p * (1 - p)) @ z + np.eye(2)) @ (z.T @ (y - p) - beta)
            for r in own:
                if r[1] == k:
                    assert math.isclose(r[4], 1 / (1 + math.exp(-beta[0] - beta[1] * (r[2] - x.mean()) / x.std())), abs_tol=1e-9)
