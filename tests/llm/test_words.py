import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import words as W

TEXTS = st.lists(st.text(alphabet="ab Z\t\né,1", max_size=30), max_size=6)


def packed(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


@given(TEXTS)
def test_words_and_their_hashes(texts):
    raw, offsets = packed(texts)
    start, end, of = W.spans(raw, offsets, W.white_space())
    got = [(int(i), raw[a:b].tobytes()) for a, b, i in zip(start, end, of)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0d]+", t.encode())]
    for fold in (True, False):
        h = W.hashes(raw, start, end, fold)
        by = {}
        for (_, w), x in zip(got, h):
            assert by.setdefault(w.lower() if fold else w, x) == x
        assert len(set(by.values())) == len(by)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_complementary_patterns_stay_apart():
    """A polynomial modulo a power of two gives such a word and its complement one hash, whatever the base."""
    word = thue_morse(2048)
    raw, offsets = packed([word, word.translate(str.maketrans("ab", "ba"))])
    start, end, _ = W.spans(raw, offsets, W.white_space())
    assert len(set(W.hashes(raw, start, end).tolist())) == 2
    code = raw.astype(np.int64)
    assert len(set(W.symbol_hashes(code, start, end).tolist())) == 2


@given(st.lists(st.integers(0, 5), max_size=12), st.integers(1, 12))
def test_symbol_hashes(codes, n):
    code = np.array(codes, np.int64)
    spans = [(a, b) for a in range(len(codes)) for b in range(a + 1, min(len(codes), a + n) + 1)]
    start, end = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    by = {}
    for (a, b), h in zip(spans, W.symbol_hashes(code, start, end).tolist()):
        assert by.setdefault(tuple(codes[a:b]), h) == h
    assert len(set(by.values())) == len(by)


@given(TEXTS, st.integers(1, 4))
def test_grams_stay_in_a_text(texts, k):
    raw, offsets = packed(texts)
    start, end, of = W.spans(raw, offsets, W.white_space())
    gram, at = W.grams(W.hashes(raw, start, end), of, k)
    counts = [len(re.findall(rb"[^\x20\x09-\x0d]+", t.encode())) for t in texts]
    assert len(gram) == sum(max(0, n - k + 1) for n in counts)


def test_hashes_in_several_spans(monkeypatch):
    raw, offsets = packed(["abc def " * 50, "x" * 400 + " abc"])
    start, end, of = W.spans(raw, offsets, W.white_space())
    whole = W.hashes(raw, start, end)
    monkeypatch.setattr(W, "SPAN", 16)
    assert (W.hashes(raw, start, end) == whole).all()


def test_ragged():
    assert W.ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
