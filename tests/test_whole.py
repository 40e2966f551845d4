"""Queries over whole texts, lengths, arrays and tables, on long rows made by hand."""

import pytest

from rollmeter import constants as K
from rollmeter.catalog import QUERIES

TEXTS = ["a" * 15, "b" * 30, "word " * 800]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    docs = [(i, t, "es" if i == 1 else "en", "web", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    vectors = [(0, [0.5] * 40 + [0.07] + [0.5] * 23), (1, [0.5] * 64)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


def test_layouts_hold_whole_texts(spark, made):
    got = QUERIES["normalize_unpivot"](spark, made).where("condition = 'full_trace'").collect()
    assert {r.problem_id: r.output for r in got} == dict(enumerate(TEXTS))
    assert all(r.target.startswith(r.output) for r in got)
    assert {r.problem_id: r.output for r in QUERIES["long_layout"](spark, made).collect()} == dict(enumerate(TEXTS))


def test_windows_lie_in_whole_lengths(spark, made):
    got = {r.doc_id: (r.n_support, r.n_windows) for r in QUERIES["loss_windows"](spark, made).collect()}
    assert got == {0: (15, 1), 1: (30, 1), 2: (96, 3)}  # 4000 is 0 modulo 2000


def test_stops_late_in_an_array(spark, made):
    got = {r.vec_id: tuple(r)[1:] for r in QUERIES["stop_truncation"](spark, made).select("vec_id", "n", "reason", "n_eos").collect()}
    assert got == {0: (41, "stop", 41), 1: (64, "length", 64)}


def test_stream_of_the_whole_table(spark, made):
    rows = QUERIES["train_stream"](spark, made).collect()
    assert len(rows) == 5000 and {r.doc_id for r in rows[:3]} == {0, 1, 2} and max(r.epoch for r in rows) == 1666


def test_auroc_of_all_replicates(spark, sf):
    (row,) = QUERIES["boot_auroc"](spark, sf).collect()
    assert 9_900 < row.n_replicates <= K.BOOT_REPLICATES == 10_000  # those of one class only have no AUROC
    assert row.ci_lo < row.auroc < row.ci_hi
