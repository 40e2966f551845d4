"""Bootstrap of the AUROC against brute force and SQL, on rows made by hand, and the rows that its plan makes."""

import duckdb
import numpy as np
import pytest

from rollmeter.catalog import ORACLES, QUERIES
from rollmeter.operators import resample

SCHEMA = "cluster string, score long, correct boolean"


def area(rows, times):
    """Pairs won by weight, a tie being half a pair; null scores are the greatest, null labels in no class."""
    at = lambda x: (x is None, x or 0)
    p = [(at(s), times(c)) for c, s, y in rows if y and times(c)]
    q = [(at(s), times(c)) for c, s, y in rows if y is False and times(c)]
    pairs = sum(v for _, v in p) * sum(v for _, v in q)
    return sum(v * w * ((x > y) + (x == y) / 2) for x, v in p for y, w in q) / pairs if pairs else None


def made(n, clusters, scores):
    rows = [(f"c{i * 31 % clusters}", i * i * 7 % scores, i * 13 % 5 > 1) for i in range(n)]
    return [*rows, ("c0", None, True), ("c1", None, False), ("c1", None, False), (None, 1, True), (None, 2, False), ("c0", 1, None)]


@pytest.mark.parametrize("clusters, scores", [(3, 1000), (3, 4), (40, 1000), (40, 4), (40, 1)])
@pytest.mark.parametrize("piece", [16, 1 << 14])
def test_auroc_interval_is_brute_force(spark, monkeypatch, clusters, scores, piece):
    monkeypatch.setattr(resample, "PIECE", piece)  # pieces with few ids and with many, scores that fill several pieces
    rows = made(200, clusters, scores)
    df = spark.createDataFrame(rows, SCHEMA)
    w = resample.weights(df, "cluster", n_boot=40)
    (got,) = resample.auroc_interval(df, w, "cluster", "score", df.correct).collect()
    drawn = {(r.replicate, r.cluster): r.w for r in w.collect()}
    boot = [area(rows, lambda c, r=r: c is not None and drawn.get((r, c), 0)) for r in range(40)]
    boot = [x for x in boot if x is not None]
    assert (got.n_pos, got.n_neg, got.n_replicates) == (sum(y is True for *_, y in rows), sum(y is False for *_, y in rows), len(boot))
    assert [got.auroc, got.ci_lo, got.ci_hi] == pytest.approx([area(rows, lambda c: 1), *np.percentile(boot, [2.5, 97.5])], abs=1e-12)


def test_no_classes_no_rows(spark):
    for rows, want in (([], (None, None, None, None, None, 0)), ([("a", 1, True), ("b", 2, True)], (2, 0, None, None, None, 0))):
        df = spark.createDataFrame(rows, SCHEMA)
        assert [tuple(r) for r in resample.auroc_interval(df, resample.weights(df, "cluster", n_boot=5), "cluster", "score", df.correct).collect()] == [want]


def test_boot_auroc_with_nulls_is_its_sql(spark, tmp_path):
    docs = [(i, "", ("web", "book", "chat", None)[i % 4], "en", None if i % 7 == 0 else i * 5 % 11) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, (0, 1, None)[i * i % 3 + (i % 5 == 0)], 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES["boot_auroc"](spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == con.sql(f"select {', '.join(df.columns)} from ({ORACLES['boot_auroc']}) q").fetchall()


def most_rows(plan):
    """The most rows that an operator of an executed plan gave out."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    found = plan.metrics().get("numOutputRows")
    return max([found.get().value() if found.isDefined() else 0, *map(most_rows, below)])


def test_rows_of_the_plan_are_not_replicates_times_scores(spark):
    df = spark.createDataFrame([(f"c{i % 8}", i, i % 3 == 0) for i in range(3000)], SCHEMA)
    out = resample.auroc_interval(df, resample.weights(df, "cluster", n_boot=400), "cluster", "score", df.correct)
    assert out.collect()[0].n_replicates == 400
    assert 3000 <= most_rows(out._jdf.queryExecution().executedPlan()) <= 100_000  # of 400 * 3000 pairs
