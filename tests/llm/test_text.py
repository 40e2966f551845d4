import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from rollmeter.llm.textcore import NameSet, Words, distinct, shingles

TEXTS = st.lists(st.text(alphabet="aAéÉß1 \n.,-中٣İ", max_size=30), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_runs_of_letters_and_digits(texts):
    words = Words(texts)
    for d, t in enumerate(texts):
        spans = [m.span() for m in regex.finditer(r"[\p{L}\p{N}]+", t)]
        a, b = words.first[d], words.first[d + 1]
        base = words.codes.starts[d]
        assert list(zip(words.start[a:b] - base, words.end[a:b] - base)) == spans


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_names_follow_content(texts):
    words = Words(texts)
    seen = {}
    for i, name in enumerate(words.name.tolist()):
        a, b = int(words.start[i]), int(words.end[i])
        spelling = "".join(chr(c) for c in words.codes.cp[a:b])
        assert seen.setdefault(name, spelling) == spelling
    assert len(seen) == len(set(seen.values()))


def test_shingles_of_short_and_long_texts():
    name, doc, _ = shingles(Words(["", "a b", "a b c d e f", "B a", "x a b c d e"]))
    assert doc.tolist() == [1, 2, 2, 3, 4, 4]
    assert name[1] == name[5] and name[0] != name[3]
    sets, first = distinct(name, doc, 5)
    assert np.diff(first).tolist() == [0, 1, 2, 1, 2] and len(sets) == 6


def test_name_set_finds_members_only():
    known = NameSet(np.array([5, 9, 1 << 63], np.uint64))
    at, entry = known.find(np.array([1 << 63, 4, 5, 5], np.uint64))
    assert at.tolist() == [0, 2, 3] and known.names[entry].tolist() == [1 << 63, 5, 5]
