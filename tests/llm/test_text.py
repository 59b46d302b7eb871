import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from akin.llm import text as T


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9 \n\té\x0b-", max_size=60), min_size=1, max_size=6))
def test_words_equal_pattern(texts):
    import re

    raw = [t.encode() for t in texts]
    w = T.words_of(raw)
    got = [[w.data[a:b] for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in raw]
    same = {}
    for i in range(len(w)):
        assert same.setdefault(int(w.hash[i]), w.data[w.start[i] : w.end[i]]) == w.data[w.start[i] : w.end[i]]


def test_pieces_do_not_matter(monkeypatch):
    data = [(b"alpha beta gamma " * 50) + b"x" * 9000 + b" end", b"second text"]
    whole = T.words_of(data)
    monkeypatch.setattr(T, "PIECE", 64)
    T._powers.clear()
    parts = T.words_of(data)
    T._powers.clear()
    assert (whole.start == parts.start).all() and (whole.hash == parts.hash).all() and (whole.first == parts.first).all()


def test_rolling_equals_tuples():
    values = np.array([1, 2, 3, 1, 2, 3, 4, 1, 2], np.uint64)
    h = T.rolling(values, 3)
    for i in range(len(h)):
        for j in range(len(h)):
            assert (h[i] == h[j]) == (tuple(values[i : i + 3]) == tuple(values[j : j + 3]))


def test_beginnings():
    w = T.words_of(["größe groß abcdef".encode()], beginnings=(4,))
    index, value = w.beginnings[0]
    assert index.tolist() == [0, 2] and value[0] != value[1]  # "groß" is no longer than four characters
