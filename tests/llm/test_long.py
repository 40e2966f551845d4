"""Texts of two million characters through the queries: whole, not by prefixes."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from rollmeter.llm import bpe, html
from rollmeter.llm.queries import QUERIES

LONG, COPY = 900_000, 900_001


@pytest.fixture(scope="module")
def long_sf(spark, sf, tmp_path_factory):
    """The tables of sf, with a long text that ends in a benchmark item and a near copy of it without the item."""
    folder = str(tmp_path_factory.mktemp("long"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(290_000)]
    item = bench.orderBy("item_id").first()
    texts = [" ".join(words) + ". " + item.text, " ".join(["changed", *words[1:]])]
    assert min(map(len, texts)) > 1_900_000
    rows = [(i, t, "en", "long", len(t)) for i, t in zip((LONG, COPY), texts)]
    docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, item, len(words)


def rows_of(spark, long_sf, name):
    return {r.doc_id: r for r in QUERIES[name](spark, long_sf[0]).where(f"doc_id in ({LONG}, {COPY})").collect()}


def test_encoding_equals_the_library(spark, long_sf):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(path).ranks, special_tokens={})
    got = rows_of(spark, long_sf, "op2_byte_bpe")
    for i, text in zip((LONG, COPY), long_sf[1]):
        ids = library.encode_ordinary(text)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_near_copies_are_linked(spark, long_sf):
    got = rows_of(spark, long_sf, "op4_ngram_join")
    assert got[LONG].class_id == got[COPY].class_id and got[LONG].n_links == got[COPY].n_links == 1


def test_an_item_at_the_very_end_is_found(spark, long_sf):
    _, _, item, n = long_sf
    found = QUERIES["op7_decontamination"](spark, long_sf[0]).where(f"doc_id in ({LONG}, {COPY})").collect()
    assert [(r.doc_id, r.item_id, r.first_word) for r in found] == [(LONG, item.item_id, n)] and found[0].similarity == 1


def test_fingerprints_of_whole_texts(spark, long_sf):
    got = rows_of(spark, long_sf, "op5_fingerprints")
    assert [got[i].n_chars for i in (LONG, COPY)] == [len(t) for t in long_sf[1]]
    assert got[LONG].near_next > 0.9 and 0 <= got[LONG].near_edited <= 1 and got[LONG].fingerprint != got[COPY].fingerprint


@pytest.mark.parametrize("name", ["op1_toxicity", "op6_language_id", "op9_quality"])
def test_scores(spark, long_sf, name):
    got = rows_of(spark, long_sf, name)
    assert set(got) == {LONG, COPY} and all(0 <= r.score <= 1 for r in got.values())


def test_pages(spark, long_sf):
    body = long_sf[1][1]
    page = f"<html><body><nav><a href=x>menu</a></nav><article><p>{body}.</p></article></body></html>"
    assert html.main_text(page) == body + "."
