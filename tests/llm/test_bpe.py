import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from rollmeter.llm import bpe
from rollmeter.llm.textcore import Codes

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    own = bpe.load(PATH)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_perfect_hash_is_minimal(pair):
    h = pair[0].hash
    assert sorted(h.index(pair[0].slot_name).tolist()) == list(range(h.n))


def test_equals_the_library_on_awkward_texts(pair):
    own, library = pair
    r = random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice("ab'sstmdrevl  \n\t é9٣!.'’中𝒳\x1c") for _ in range(r.randint(0, 14)))
        assert own.encode(text) == library.encode_ordinary(text), repr(text)
    for text in ("", " ", "\n\n", "x" * 5000, "!" * 3000 + "?", "'s", " 's", "''s", "don't", "é" * 50, "<|endoftext|>"):
        assert own.encode(text) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_frame_keeps_columns_and_handles_nulls(spark, pair):
    rows = [(1, "a b's", "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "zz " * 4000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t, _ in rows)
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.digests(df.limit(0), PATH).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


def test_words_whose_power_sums_cancel_have_own_names_and_ids(pair):
    own, library = pair
    for n in (8, 16, 32, 64, 1024, 2048, 4096):
        one, other = thue_morse(n), thue_morse(n, "b", "a")
        codes = Codes([one, other])
        assert len(set(codes.names(codes.starts, codes.ends).tolist())) == 2
        for text in (one, other, one + " " + other):
            assert own.encode(text) == library.encode_ordinary(text) and own.decode(own.encode(text)) == text.encode()


def test_equal_names_of_different_words_do_no_harm(pair, monkeypatch):
    own, library = bpe.ByteBPE(pair[0].ranks), pair[1]
    true = Codes.names
    monkeypatch.setattr(Codes, "names", lambda self, a, b: true(self, a, b) & np.uint64(7) | np.uint64(8))
    r = random.Random(5)
    for _ in range(200):
        text = " ".join("".join(r.choice("abcxyz") for _ in range(r.randint(1, 9))) for _ in range(20))
        assert own.encode(text) == library.encode_ordinary(text)


def test_clashing_columns_repeated_rows_and_a_long_text(spark, pair):
    long = "word " * 400_000
    df = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a b", "x", "y"), (2, long, "x", "y")], "doc_id long, text string, ids string, decoded string")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert [r.decoded.decode() for r in sorted(got, key=lambda r: r.doc_id)] == ["a b", "a b", long]
    assert got[0].asDict().keys() == {"doc_id", "n_tokens", "ids", "decoded"}
